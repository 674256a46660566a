"""Queries for tables, tests and survival."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from episodica.catalog.registry import Sample, register
from episodica.catalog.views import FOLLOW_UP_SQL, GROUPS, STAYS_SQL, follow_up, stays
from episodica.functions.normal import normal_quantile_sql
from episodica.operators import hypothesis, summary, survival


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


def chi2_tail_sql(x: str, df: str) -> str:
    """Chi-square tail by the series of the incomplete gamma function; 0 where it is below 1e-100."""
    return (
        f"CASE WHEN {x} > 700 THEN 0 ELSE greatest(0, 1 - list_sum([exp(({df} / 2.0 + k) * ln(greatest({x}, 1e-300) / 2.0) - {x} / 2.0 "
        f"- lgamma({df} / 2.0 + k + 1)) for k in range(0, 800)])) END"
    )


def t_tail_sql(t: str, df: str) -> str:
    """Two-sided t tail by the series of the incomplete beta function; 0 for extreme t."""
    x = f"(({t}) * ({t}) / ({df} + ({t}) * ({t})))"
    return (
        f"CASE WHEN abs({t}) > 26 AND {df} > 1000 THEN 0 ELSE greatest(0, 1 - list_sum([exp((0.5 + k) * ln(greatest({x}, 1e-300)) + {df} / 2.0 * ln(1 - {x}) "
        f"+ lgamma({df} / 2.0 + 0.5 + k) - lgamma({df} / 2.0) - lgamma(1.5 + k)) for k in range(0, 800)])) END"
    )


# --- tables -------------------------------------------------------------------
@register("crosstab_counts", f"""
    SELECT g.grp, v.status, CAST(count(s.stay) AS BIGINT) AS n
    FROM (SELECT DISTINCT grp FROM ({STAYS_SQL})) g
    CROSS JOIN (VALUES ('F'), ('O'), ('P'), ('X')) v(status)
    LEFT JOIN ({STAYS_SQL}) s ON s.grp = g.grp AND s.status = v.status GROUP BY 1, 2
""")
def crosstab_counts(s: Sample) -> DataFrame:
    return summary.crosstab(stays(s), "grp", "status", GROUPS, ["F", "O", "P", "X"])


NUMERIC_BASE = """
    SELECT o_orderpriority AS grp, o_totalprice AS price,
           CASE WHEN o_totalprice BETWEEN 20000 AND 400000 THEN round(o_totalprice / 1000) END AS score,
           CAST(o_custkey % 40 AS DOUBLE) AS visits, o_orderkey
    FROM orders
"""


def _numeric_base(s: Sample) -> DataFrame:
    price = F.col("o_totalprice")
    return s.table("orders").select(
        F.col("o_orderpriority").alias("grp"), price.alias("price"),
        F.when(price.between(20000, 400000), F.round(price / 1000)).alias("score"),
        (F.col("o_custkey") % 40).cast("double").alias("visits"), "o_orderkey",
    )


NUMERIC_VARIABLES = ["price", "score", "visits"]


def numeric_sql(variable: str, base: str = NUMERIC_BASE, grp: str = "grp") -> str:
    stats = (
        f"'{variable}' AS variable, CAST(count({variable}) AS BIGINT) AS n, "
        f"CAST(count(*) - count({variable}) AS BIGINT) AS missing, "
        f"round(avg({variable}), 4) AS mean, round(stddev_samp({variable}), 4) AS sd, "
        f"round(quantile_cont({variable}, 0.25), 4) AS q1, round(quantile_cont({variable}, 0.5), 4) AS median, "
        f"round(quantile_cont({variable}, 0.75), 4) AS q3"
    )
    return (
        f"SELECT coalesce(CAST({grp} AS VARCHAR), 'Total') AS stratum, {stats} FROM ({base}) "
        f"WHERE {grp} IS NOT NULL GROUP BY GROUPING SETS (({grp}), ())"
    )


@register("table_numeric", " UNION ALL ".join(numeric_sql(v) for v in NUMERIC_VARIABLES))
def table_numeric(s: Sample) -> DataFrame:
    out = summary.numeric_table(_numeric_base(s), "grp", NUMERIC_VARIABLES)
    return rounded(out, "mean", "sd", "q1", "median", "q3", digits=4)


@register("table_categorical", f"""
    WITH b AS (SELECT grp, 'status' AS variable, nullif(status, 'P') AS level FROM ({STAYS_SQL})
               UNION ALL SELECT grp, 'outcome', CAST(outcome AS VARCHAR) FROM ({STAYS_SQL})),
    t AS (SELECT grp, variable, level FROM b WHERE grp IS NOT NULL UNION ALL SELECT 'Total', variable, level FROM b WHERE grp IS NOT NULL),
    cells AS (SELECT * FROM (SELECT DISTINCT variable, grp FROM t) JOIN (SELECT DISTINCT variable, level FROM t WHERE level IS NOT NULL) USING (variable))
    SELECT c.variable, c.level, c.grp AS stratum, count(*) FILTER (t.level = c.level) AS n,
           round(count(*) FILTER (t.level = c.level) * 100.0 / nullif(count(t.level), 0), 6) AS pct,
           count(*) FILTER (t.level IS NULL) AS missing
    FROM cells c JOIN t ON t.variable = c.variable AND t.grp = c.grp GROUP BY 1, 2, 3
""")
def table_categorical(s: Sample) -> DataFrame:
    rows = stays(s).withColumn("status", F.nullif("status", F.lit("P")))
    return rounded(summary.categorical_table(rows, "grp", ["status", "outcome"]), "pct")


# --- tests --------------------------------------------------------------------
def chi_square_sql(base: str, row: str, col: str) -> str:
    return f"""
    WITH c AS (SELECT r.{row} AS r, k.{col} AS k, count(b.{row}) AS o
               FROM (SELECT DISTINCT {row} FROM ({base})) r CROSS JOIN (SELECT DISTINCT {col} FROM ({base})) k
               LEFT JOIN ({base}) b ON b.{row} = r.{row} AND b.{col} = k.{col} GROUP BY 1, 2),
    e AS (SELECT *, sum(o) OVER (PARTITION BY r) * 1.0 * sum(o) OVER (PARTITION BY k) / sum(o) OVER () AS x FROM c),
    s AS (SELECT sum((o - x) * (o - x) / x) AS plain, sum(pow(greatest(abs(o - x) - 0.5, 0), 2) / x) AS corrected,
                 count(DISTINCT r) AS nr, count(DISTINCT k) AS nk, sum(o) AS total FROM e)
    """


@register("chisq_stat", chi_square_sql(STAYS_SQL, "grp", "status") + f"""
    SELECT 'status' AS variable, round(plain, 6) AS statistic, CAST((nr - 1) * (nk - 1) AS INTEGER) AS df,
           CAST(total AS BIGINT) AS total, round({chi2_tail_sql('plain', '8')}, 6) AS p FROM s
""")
def chisq_stat(s: Sample) -> DataFrame:
    return rounded(summary.categorical_tests(stays(s), "grp", ["status"]), "statistic", "p")


@register("chisq_yates", chi_square_sql(STAYS_SQL, "treated", "outcome") + f"""
    SELECT 'treated x outcome' AS test, round(corrected, 6) AS statistic, CAST(1 AS INTEGER) AS df,
           CAST(total AS BIGINT) AS total, round({chi2_tail_sql('corrected', '1')}, 6) AS p FROM s
""")
def chisq_yates(s: Sample) -> DataFrame:
    return rounded(hypothesis.independence(stays(s), "treated", "outcome"), "statistic", "p")


def kruskal_sql(variable: str, base: str = NUMERIC_BASE, grp: str = "grp") -> str:
    return f"""
    SELECT '{variable}' AS variable, round(h, 6) AS statistic, CAST(df AS INTEGER) AS df,
           round({chi2_tail_sql('h', 'df')}, 6) AS p
    FROM (SELECT k - 1 AS df, (12 / (n * (n + 1)) * w - 3 * (n + 1)) / (1 - ties / (n * n * n - n)) AS h
          FROM (SELECT sum(rs * rs / sz) AS w, sum(sz) AS n, sum(ts) AS ties, count(*) AS k
                FROM (SELECT {grp}, sum(mid) AS rs, CAST(count(*) AS DOUBLE) AS sz, sum(t * t - 1) AS ts
                      FROM (SELECT {grp}, CAST(t AS DOUBLE) AS t, rk + (t - 1) / 2.0 AS mid
                            FROM (SELECT {grp}, rank() OVER (ORDER BY {variable}) AS rk,
                                         count(*) OVER (PARTITION BY {variable}) AS t
                                  FROM ({base}) WHERE {variable} IS NOT NULL AND {grp} IS NOT NULL))
                      GROUP BY {grp})))
    """


@register("kruskal_h", " UNION ALL ".join(f"({kruskal_sql(v)})" for v in NUMERIC_VARIABLES))
def kruskal_h(s: Sample) -> DataFrame:
    return rounded(hypothesis.kruskal(_numeric_base(s), "grp", NUMERIC_VARIABLES), "statistic", "p")


def pairwise_t_sql(base: str, value: str, grp: str) -> str:
    """CTEs g to h of the t tests of all level pairs."""
    return f"""
    g AS (SELECT {grp} AS grp, count({value}) AS n, avg({value}) AS m, var_samp({value}) AS v
          FROM ({base}) WHERE {value} IS NOT NULL AND {grp} IS NOT NULL GROUP BY {grp}),
    k AS (SELECT sum(n - 1) AS dof, sum((n - 1) * v) / sum(n - 1) AS pooled FROM g),
    t AS (SELECT a.grp AS level_a, b.grp AS level_b, CAST(dof AS BIGINT) AS df,
                 (b.m - a.m) / (sqrt(pooled) * sqrt(1.0 / a.n + 1.0 / b.n)) AS statistic
          FROM g a JOIN g b ON a.grp < b.grp, k),
    p AS (SELECT *, {t_tail_sql('statistic', 'df')} AS p FROM t),
    r AS (SELECT *, row_number() OVER (ORDER BY p) AS i, count(*) OVER () AS m FROM p),
    h AS (SELECT *, least(1, max((m - i + 1) * p) OVER (ORDER BY i)) AS p_adjusted FROM r)
    SELECT '{value}' AS test, level_a, level_b, df, round(statistic, 6) AS statistic, round(p, 6) AS p,
           round(p_adjusted, 6) AS p_adjusted FROM h
    """


@register("pairwise_t", "WITH " + pairwise_t_sql(NUMERIC_BASE, "score", "grp"))
def pairwise_t(s: Sample) -> DataFrame:
    return rounded(hypothesis.pairwise_t(_numeric_base(s), "score", "grp"), "statistic", "p", "p_adjusted")


def pairwise_chisq_sql(base: str, outcome: str, grp: str) -> str:
    """CTEs c to r of the corrected 2x2 tests of all level pairs."""
    return f"""
    c AS (SELECT {grp} AS grp, {outcome} AS outcome, CAST(count(*) AS DOUBLE) AS o FROM ({base}) GROUP BY 1, 2),
    l AS (SELECT grp, max(o) FILTER (outcome = 1) AS yes, max(o) FILTER (outcome = 0) AS no FROM c GROUP BY 1),
    t AS (SELECT a.grp AS level_a, b.grp AS level_b, a.yes + a.no + b.yes + b.no AS n,
                 abs(a.yes * b.no - a.no * b.yes) AS cross_gap,
                 (a.yes + a.no) * (b.yes + b.no) * (a.yes + b.yes) * (a.no + b.no) AS margins
          FROM l a JOIN l b ON a.grp < b.grp),
    x AS (SELECT *, n * pow(greatest(cross_gap - n / 2, 0), 2) / margins AS statistic FROM t),
    p AS (SELECT *, {chi2_tail_sql('statistic', '1')} AS p FROM x),
    r AS (SELECT *, row_number() OVER (ORDER BY p) AS i, count(*) OVER () AS m FROM p)
    SELECT '{outcome}' AS test, level_a, level_b, round(statistic, 6) AS statistic, CAST(1 AS INTEGER) AS df,
           CAST(n AS BIGINT) AS total, round(p, 6) AS p,
           round(least(1, min(p * m / i) OVER (ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 6)
             AS p_adjusted
    FROM r
    """


@register("pairwise_chisq", "WITH " + pairwise_chisq_sql(STAYS_SQL, "outcome", "grp"))
def pairwise_chisq(s: Sample) -> DataFrame:
    return rounded(hypothesis.pairwise_chi_square(stays(s), "grp", "outcome"), "statistic", "p", "p_adjusted")


@register("qq_points", f"""
    WITH r AS (SELECT score, row_number() OVER (ORDER BY score) AS i, count(*) OVER () AS n
               FROM ({NUMERIC_BASE}) WHERE score IS NOT NULL),
    p AS (SELECT score AS sample, CAST(i AS BIGINT) AS rank, (i - 0.5) / n AS share FROM r)
    SELECT 'score' AS variable, rank, round(share, 9) AS share, sample,
           round({normal_quantile_sql('share')}, 6) AS theoretical FROM p
""")
def qq_points(s: Sample) -> DataFrame:
    out = hypothesis.qq_points(_numeric_base(s), ["score"])
    return rounded(rounded(out, "theoretical"), "share", digits=9)


# --- survival -----------------------------------------------------------------
def km_sql(base: str) -> str:
    """Curve of a frame with columns grp, days and outcome."""
    steps = f"""
    SELECT grp, days, sum(m) OVER (PARTITION BY grp ORDER BY days DESC) AS n_risk, d AS n_event, m - d AS n_censor
    FROM (SELECT grp, days, count(*) AS m, sum(outcome) AS d FROM ({base}) GROUP BY grp, days)
    """
    return f"""
    SELECT grp AS "group", days AS time, CAST(n_risk AS BIGINT) AS n_risk, CAST(n_event AS BIGINT) AS n_event,
           CAST(n_censor AS BIGINT) AS n_censor,
           round(100 * CASE WHEN max(CASE WHEN n_event = n_risk THEN 1 ELSE 0 END) OVER w = 1 THEN 0
                ELSE exp(sum(CASE WHEN n_event = n_risk THEN 0 ELSE ln(1 - n_event * 1.0 / n_risk) END) OVER w) END, 6)
             AS survival_pct
    FROM ({steps}) WINDOW w AS (PARTITION BY grp ORDER BY days)
    """


@register("km_curve", km_sql(FOLLOW_UP_SQL))
def km_curve(s: Sample) -> DataFrame:
    return rounded(survival.km_curve(follow_up(s), "days", "outcome", "grp"), "survival_pct")


@register("risk_table", f"""
    SELECT f.grp AS "group", CAST(g.x AS DOUBLE) AS time, CAST(sum(CASE WHEN f.days >= g.x THEN 1 ELSE 0 END) AS BIGINT) AS n_risk
    FROM ({FOLLOW_UP_SQL}) f CROSS JOIN (VALUES (0), (7), (14), (21), (28)) g(x) GROUP BY 1, 2
""")
def risk_table(s: Sample) -> DataFrame:
    return survival.risk_table(follow_up(s), "days", "outcome", "grp", [0, 7, 14, 21, 28])


# Every group at every distinct time, with the number at risk and the events then.
AT_RISK_SQL = f"""
    SELECT t.days, g.grp, sum(CASE WHEN f.days >= t.days THEN 1.0 ELSE 0 END) AS n_g,
           sum(CASE WHEN f.days = t.days THEN f.outcome ELSE 0 END) AS d_g
    FROM (SELECT DISTINCT days FROM ({FOLLOW_UP_SQL})) t
    CROSS JOIN (SELECT DISTINCT grp FROM ({FOLLOW_UP_SQL})) g
    JOIN ({FOLLOW_UP_SQL}) f ON f.grp = g.grp GROUP BY 1, 2
"""


@register("logrank_terms", f"""
    WITH a AS ({AT_RISK_SQL}),
    b AS (SELECT *, sum(n_g) OVER (PARTITION BY days) AS n, sum(d_g) OVER (PARTITION BY days) AS d FROM a)
    SELECT b.grp AS "group", CAST(max(z.n) AS BIGINT) AS n, CAST(sum(d_g) AS DOUBLE) AS observed,
           round(sum(CASE WHEN b.n > 0 THEN d * n_g / b.n END), 6) AS expected,
           round(sum(CASE WHEN b.n > 1 THEN d * (b.n - d) / (b.n - 1) * n_g * (b.n - n_g) / (b.n * b.n) ELSE 0 END), 6)
             AS variance
    FROM b JOIN (SELECT grp, count(*) AS n FROM ({FOLLOW_UP_SQL}) GROUP BY 1) z ON b.grp = z.grp GROUP BY b.grp
""")
def logrank_terms(s: Sample) -> DataFrame:
    return rounded(survival.logrank_terms(follow_up(s), "days", "outcome", "grp", GROUPS), "expected", "variance")


def logrank_pairs_sql(base: str = FOLLOW_UP_SQL) -> str:
    """CTEs a to p of the log-rank tests of all group pairs; frames have grp, days and outcome."""
    at_risk = AT_RISK_SQL.replace(FOLLOW_UP_SQL, base)
    return f"""
    a AS MATERIALIZED ({at_risk}),
    j AS (SELECT x.grp AS level_a, y.grp AS level_b, x.d_g AS da, x.n_g AS na, y.n_g AS nb,
                 x.d_g + y.d_g AS d, x.n_g + y.n_g AS n
          FROM a x JOIN a y ON x.days = y.days AND x.grp < y.grp),
    s AS (SELECT level_a, level_b, sum(da - CASE WHEN n > 0 THEN d * na / n ELSE 0 END) AS gap,
                 sum(CASE WHEN n > 1 THEN d * (n - d) / (n - 1) * na * nb / (n * n) ELSE 0 END) AS v
          FROM j GROUP BY 1, 2),
    q AS (SELECT level_a, level_b, gap * gap / v AS statistic FROM s),
    p AS (SELECT *, {chi2_tail_sql('statistic', '1')} AS p FROM q)
    """


ADJUSTED_PAIRS_SQL = """,
    r AS (SELECT *, row_number() OVER (ORDER BY p) AS i, count(*) OVER () AS m FROM p)
    SELECT level_a, level_b, round(statistic, 6) AS statistic, round(p, 6) AS p,
           round(least(1, min(p * m / i) OVER (ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 6)
             AS p_adjusted
    FROM r
"""


@register("pairwise_logrank", "WITH " + logrank_pairs_sql() + ADJUSTED_PAIRS_SQL)
def pairwise_logrank(s: Sample) -> DataFrame:
    out = survival.pairwise_logrank(follow_up(s), "days", "outcome", "grp", GROUPS)
    return rounded(out, "statistic", "p", "p_adjusted")


TWO_GROUPS = f"""
    SELECT stay, CASE WHEN grp IN ('1-URGENT', '2-HIGH') THEN 'early' ELSE 'late' END AS grp, outcome, days
    FROM ({FOLLOW_UP_SQL})
"""


@register("logrank_test", "WITH " + logrank_pairs_sql(TWO_GROUPS) + """
    SELECT round(statistic, 6) AS statistic, CAST(1 AS INTEGER) AS df, round(p, 6) AS p FROM p
""")
def logrank_test(s: Sample) -> DataFrame:
    early = F.when(F.col("grp").isin("1-URGENT", "2-HIGH"), "early").otherwise("late")
    rows = follow_up(s).withColumn("grp", early)
    return rounded(survival.logrank_test(rows, "days", "outcome", "grp", ["early", "late"]), "statistic", "p")


def logrank_sql(base: str, groups: int) -> str:
    """CTEs of the test over at most ``groups`` groups of a frame with grp, days and outcome, and the test as its last, q.

    The quadratic form is what elimination of the covariances leaves of a matrix that has the gaps as its last row and column.
    """
    at_risk = AT_RISK_SQL.replace(FOLLOW_UP_SQL, base)
    steps = ", ".join(
        f"m{k} AS MATERIALIZED (SELECT m.i, m.j, m.v - coalesce(r.v * c.v / p.v, 0) AS v FROM m{k - 1} m LEFT JOIN m{k - 1} r ON r.i = {k} AND r.j = m.j "
        f"LEFT JOIN m{k - 1} c ON c.j = {k} AND c.i = m.i LEFT JOIN m{k - 1} p ON p.i = {k} AND p.j = {k} WHERE m.i > {k} AND m.j > {k})"
        for k in range(1, groups)
    )
    return f"""
    a AS MATERIALIZED (SELECT *, dense_rank() OVER (ORDER BY grp) AS i FROM ({at_risk})),
    b AS (SELECT *, sum(n_g) OVER (PARTITION BY days) AS n, sum(d_g) OVER (PARTITION BY days) AS d FROM a),
    gap AS (SELECT i, sum(d_g - d * n_g / n) AS z FROM b GROUP BY 1),
    cov AS (SELECT x.i, y.i AS j, sum(CASE WHEN x.n > 1 THEN x.d * (x.n - x.d) / (x.n - 1) / (x.n * x.n)
                                      * (CASE WHEN x.i = y.i THEN x.n_g * (x.n - x.n_g) ELSE -x.n_g * y.n_g END) ELSE 0 END) AS v
            FROM b x JOIN b y ON x.days = y.days GROUP BY 1, 2),
    k AS (SELECT max(i) AS k FROM gap),
    m0 AS MATERIALIZED (SELECT i, j, v FROM cov, k WHERE i < k AND j < k UNION ALL SELECT i, {groups}, z FROM gap, k WHERE i < k
           UNION ALL SELECT {groups}, i, z FROM gap, k WHERE i < k UNION ALL SELECT {groups}, {groups}, 0.0),
    {steps},
    q AS (SELECT -v AS statistic, k - 1 AS df FROM m{groups - 1}, k)
    """


def logrank_all_sql(base: str = FOLLOW_UP_SQL, groups: int = 5) -> str:
    return logrank_sql(base, groups) + f"""
    SELECT round(statistic, 6) AS statistic, CAST(df AS INTEGER) AS df, round({chi2_tail_sql('statistic', 'df')}, 6) AS p FROM q
    """


@register("logrank_all_groups", "WITH " + logrank_all_sql())
def logrank_all_groups(s: Sample) -> DataFrame:
    return rounded(survival.logrank_test(follow_up(s), "days", "outcome", "grp", GROUPS), "statistic", "p")
