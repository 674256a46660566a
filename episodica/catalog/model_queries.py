"""Queries for logistic models, propensity scores and matching."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from episodica.catalog.registry import Sample, register
from episodica.catalog.stats_queries import chi2_tail_sql, rounded
from episodica.catalog.views import GROUPS, STAYS_SQL, stays
from episodica.operators.matching import match_nearest, matched_rows
from episodica.operators.models import Design, LogisticFit, fit_logistic, propensity_score

# With group dummies alone the maximum likelihood estimates are log odds of counts.
SATURATED_SQL = f"""
    WITH c AS (SELECT grp, CAST(sum(outcome) AS DOUBLE) AS yes, CAST(count(*) - sum(outcome) AS DOUBLE) AS no
               FROM ({STAYS_SQL}) GROUP BY grp),
    r AS (SELECT * FROM c WHERE grp = '3-MEDIUM'),
    e AS (SELECT 'grp=' || c.grp AS term, ln(c.yes / c.no) - ln(r.yes / r.no) AS estimate,
                 sqrt(1 / c.yes + 1 / c.no + 1 / r.yes + 1 / r.no) AS std_error
          FROM c, r WHERE c.grp <> '3-MEDIUM'
          UNION ALL SELECT '(Intercept)', ln(yes / no), sqrt(1 / yes + 1 / no) FROM r)
"""


def _saturated(s: Sample) -> LogisticFit:
    return fit_logistic(stays(s), "outcome", Design(factors={"grp": (GROUPS, "3-MEDIUM")}), collapse=True)


@register("logit_fit", SATURATED_SQL + f"""
    SELECT term, round(estimate, 6) AS estimate, round(std_error, 6) AS std_error,
           round(estimate / std_error, 5) AS z,
           round({chi2_tail_sql('(estimate / std_error * (estimate / std_error))', '1')}, 5) AS p FROM e
""")
def logit_fit(s: Sample) -> DataFrame:
    out = rounded(_saturated(s).coefficients(), "estimate", "std_error")
    return rounded(out, "z", "p", digits=5)


@register("odds_ratio", SATURATED_SQL + """
    SELECT term, round(exp(estimate), 6) AS odds_ratio,
           round(exp(estimate - 1.959963984540054 * std_error), 6) AS low_95,
           round(exp(estimate + 1.959963984540054 * std_error), 6) AS high_95 FROM e
""")
def odds_ratio(s: Sample) -> DataFrame:
    return rounded(_saturated(s).odds_ratios(), "odds_ratio", "low_95", "high_95")


CASES_SQL = """
    SELECT o_orderkey AS stay, CAST(o_custkey % 40 AS DOUBLE) / 10 AS visits, o_totalprice / 100000 AS cost,
           CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 1 ELSE 0 END AS treated,
           CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS outcome
    FROM orders
"""


def _cases(s: Sample) -> DataFrame:
    priority, status = F.col("o_orderpriority"), F.col("o_orderstatus")
    return s.table("orders").select(
        F.col("o_orderkey").alias("stay"), ((F.col("o_custkey") % 40).cast("double") / 10).alias("visits"),
        (F.col("o_totalprice") / 100000).alias("cost"),
        F.when(priority.isin("1-URGENT", "2-HIGH"), 1).otherwise(0).alias("treated"),
        F.when(status == "F", 1).otherwise(0).alias("outcome"),
    )


def newton_sql(y: str) -> str:
    """Eight Newton steps of a two-covariate logistic model, by cofactors of the 3x3 information."""
    return f"""
    WITH RECURSIVE x AS MATERIALIZED (SELECT {y} AS y, cost AS a, visits AS b FROM ({CASES_SQL})),
    it(i, b0, b1, b2, c00, c11, c22) AS (
      SELECT 0, CAST(0 AS DOUBLE), CAST(0 AS DOUBLE), CAST(0 AS DOUBLE), CAST(0 AS DOUBLE), CAST(0 AS DOUBLE), CAST(0 AS DOUBLE)
      UNION ALL
      SELECT i + 1,
        b0 + ((sbb * saa - sab * sab) * g0 + (sb * sab - s1a * sbb) * g1 + (s1a * sab - sb * saa) * g2) / det,
        b1 + ((sb * sab - s1a * sbb) * g0 + (s11 * sbb - sb * sb) * g1 + (s1a * sb - s11 * sab) * g2) / det,
        b2 + ((s1a * sab - sb * saa) * g0 + (s1a * sb - s11 * sab) * g1 + (s11 * saa - s1a * s1a) * g2) / det,
        (sbb * saa - sab * sab) / det, (s11 * sbb - sb * sb) / det, (s11 * saa - s1a * s1a) / det
      FROM (SELECT *, s11 * (saa * sbb - sab * sab) - s1a * (s1a * sbb - sab * sb) + sb * (s1a * sab - saa * sb) AS det
            FROM (SELECT i, b0, b1, b2, sum(w) AS s11, sum(w * a) AS s1a, sum(w * b) AS sb, sum(w * a * a) AS saa,
                         sum(w * a * b) AS sab, sum(w * b * b) AS sbb, sum(y - m) AS g0, sum((y - m) * a) AS g1,
                         sum((y - m) * b) AS g2
                  FROM (SELECT i, b0, b1, b2, y, a, b, m, m * (1 - m) AS w
                        FROM (SELECT it.*, x.*, 1 / (1 + exp(-(b0 + b1 * a + b2 * b))) AS m FROM it, x WHERE i < 8))
                  GROUP BY i, b0, b1, b2))),
    fit AS (SELECT * FROM it WHERE i = 8)
    """


@register("logit_adjusted", newton_sql("outcome") + """
    SELECT '(Intercept)' AS term, round(b0, 6) AS estimate, round(sqrt(c00), 6) AS std_error FROM fit
    UNION ALL SELECT 'cost', round(b1, 6), round(sqrt(c11), 6) FROM fit
    UNION ALL SELECT 'visits', round(b2, 6), round(sqrt(c22), 6) FROM fit
""")
def logit_adjusted(s: Sample) -> DataFrame:
    fit = fit_logistic(_cases(s), "outcome", Design(numeric=("cost", "visits")))
    return rounded(fit.coefficients().select("term", "estimate", "std_error"), "estimate", "std_error")


@register("logit_statistics", newton_sql("outcome") + f"""
    , m AS (SELECT x.outcome AS y, 1 / (1 + exp(-(b0 + b1 * cost + b2 * visits))) AS m FROM ({CASES_SQL}) x, fit),
    g AS (SELECT count(*) AS n, -2 * sum(CASE WHEN y = 1 THEN ln(m) ELSE ln(1 - m) END) AS deviance, CAST(sum(y) AS DOUBLE) AS yes FROM m)
    SELECT n, round(deviance, 4) AS deviance, round(-2 * (yes * ln(yes / n) + (n - yes) * ln((n - yes) / n)), 4) AS null_deviance,
           n - 3 AS df_residual, n - 1 AS df_null, round(deviance + 6, 4) AS aic FROM g
""")
def logit_statistics(s: Sample) -> DataFrame:
    fit = fit_logistic(_cases(s), "outcome", Design(numeric=("cost", "visits")))
    return rounded(fit.statistics(_cases(s), "outcome"), "deviance", "null_deviance", "aic", digits=4)


def _scored(s: Sample) -> DataFrame:
    return propensity_score(_cases(s), "treated", Design(numeric=("cost", "visits")), collapse=False)


@register("propensity_score", newton_sql("treated") + f"""
    SELECT stay, treated, round(1 / (1 + exp(-(b0 + b1 * cost + b2 * visits))), 6) AS distance
    FROM ({CASES_SQL}), fit
""")
def propensity(s: Sample) -> DataFrame:
    return rounded(_scored(s).select("stay", "treated", "distance"), "distance")


@register("match_nearest")
def match(s: Sample) -> DataFrame:
    return rounded(match_nearest(_scored(s), "stay", "treated"), "treated_score", "control_score", "gap", digits=9)


@register("matched_data")
def matched(s: Sample) -> DataFrame:
    scored = _scored(s)
    return rounded(matched_rows(scored, match_nearest(scored, "stay", "treated"), "stay"), "distance", digits=9)
