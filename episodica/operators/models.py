"""Logistic regression, odds ratios and propensity scores on Spark ML."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import (
    GeneralizedLinearRegression,
    GeneralizedLinearRegressionModel,
)
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

INTERCEPT = "(Intercept)"
Z_95 = 1.959963984540054


@dataclass(frozen=True)
class Design:
    """Numeric terms and factors coded against an explicit reference level."""

    numeric: tuple[str, ...] = ()
    factors: Mapping[str, tuple[Sequence[str], str]] | None = None

    def terms(self) -> dict[str, Column]:
        out = {n: F.col(n).cast("double") for n in self.numeric}
        for name, (levels, reference) in (self.factors or {}).items():
            if reference not in levels:
                raise ValueError(f"{reference!r} is not a level of {name}")
            for level in levels:
                if level != reference:
                    out[f"{name}={level}"] = (F.col(name) == level).cast("double")
        return out

    def complete(self, df: DataFrame) -> DataFrame:
        """Rows without a missing or unlisted value in any term."""
        ok = F.lit(True)
        for n in self.numeric:
            ok = ok & F.col(n).isNotNull()
        for name, (levels, _) in (self.factors or {}).items():
            ok = ok & F.col(name).isin(list(levels))
        return df.where(ok)


@dataclass(frozen=True)
class LogisticFit:
    """Terms that are constant among the cases have no estimate (None)."""

    names: list[str]
    estimates: list[float | None]
    errors: list[float | None]
    z: list[float | None]
    p: list[float | None]
    design: Design
    model: GeneralizedLinearRegressionModel
    spark: SparkSession

    def coefficients(self) -> DataFrame:
        """Estimate, standard error, z and p of each term, intercept first."""
        rows = list(zip(self.names, self.estimates, self.errors, self.z, self.p))
        return self.spark.createDataFrame(
            rows, "term string, estimate double, std_error double, z double, p double"
        )

    def odds_ratios(self) -> DataFrame:
        """Odds ratio with Wald 95 % limits of each term, including the intercept."""
        e, half = F.col("estimate"), F.lit(Z_95) * F.col("std_error")
        return self.coefficients().select(
            "term", F.exp(e).alias("odds_ratio"), F.exp(e - half).alias("low_95"), F.exp(e + half).alias("high_95")
        )

    def statistics(self, df: DataFrame, outcome: str) -> DataFrame:
        """Cases, residual and null deviance with their degrees of freedom, and AIC, over the complete cases of a frame."""
        y = F.col(outcome).cast("double")
        cases = self.score(self.design.complete(df).where(F.col(outcome).isNotNull()), "_m")
        likely = F.when(y > 0, F.log("_m")).otherwise(F.log1p(-F.col("_m")))
        sums = cases.agg(F.count(F.lit(1)).alias("n"), F.sum(y).alias("yes"), (-2 * F.sum(likely)).alias("deviance"))
        n, yes, k = F.col("n").cast("double"), F.col("yes"), sum(e is not None for e in self.estimates)
        share = lambda part: F.when(part > 0, part * F.log(part / n)).otherwise(0.0)
        return sums.select(
            "n", "deviance", (-2 * (share(yes) + share(n - yes))).alias("null_deviance"),
            (F.col("n") - k).alias("df_residual"), (F.col("n") - 1).alias("df_null"), (F.col("deviance") + 2 * k).alias("aic"),
        )

    def score(self, df: DataFrame, out: str = "distance") -> DataFrame:
        """Adds the fitted probability as a plain column expression."""
        eta = F.lit(self.estimates[0])
        for (_, term), b in zip(self.design.terms().items(), self.estimates[1:]):
            if b is not None:
                eta = eta + F.lit(b) * term
        return df.withColumn(out, F.lit(1.0) / (F.lit(1.0) + F.exp(-eta)))


def fit_logistic(
    df: DataFrame, outcome: str, design: Design, collapse: bool = False,
    max_iter: int = 50, tol: float = 1e-10,
) -> LogisticFit:
    """Maximum likelihood by iteratively reweighted least squares, complete cases.

    ``collapse`` first merges equal covariate patterns into one row with the share
    of events, weighted by its number of persons. With discrete covariates (age,
    sex, integer scores) every iteration then reads the patterns instead of the
    persons; the estimates are the same.
    """
    terms = design.terms()
    cases = design.complete(df).where(F.col(outcome).isNotNull())
    rows = cases.select(
        F.col(outcome).cast("double").alias("_label"),
        *[c.alias(f"_x{i}") for i, c in enumerate(terms.values())],
    )
    columns = [f"_x{i}" for i in range(len(terms))]
    if collapse:
        rows = rows.groupBy(*columns).agg(
            F.avg("_label").alias("_label"), F.count(F.lit(1)).cast("double").alias("_weight")
        )
    else:
        rows = rows.withColumn("_weight", F.lit(1.0))
    # Every iteration reads these few columns again; spills to disk if large.
    rows = rows.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        # A level nobody has gives a constant column, which no model can estimate.
        spread = rows.agg(*[(F.max(c) > F.min(c)).alias(c) for c in columns]).first()
        used = [c for c in columns if spread[c]]
        train = VectorAssembler(inputCols=used, outputCol="_features").transform(rows)
        model = GeneralizedLinearRegression(
            family="binomial", link="logit", solver="irls", maxIter=max_iter, tol=tol,
            labelCol="_label", weightCol="_weight", featuresCol="_features",
        ).fit(train)
        summary = model.summary
        # Spark lists the intercept last in the summary arrays.
        arrays = [list(model.coefficients) + [model.intercept]] + [
            list(x) for x in (summary.coefficientStandardErrors, summary.tValues, summary.pValues)
        ]
    finally:
        rows.unpersist()
    place = {c: i for i, c in enumerate([*used, INTERCEPT])}
    estimates, errors, z, p = (
        [float(values[place[c]]) if c in place else None for c in [INTERCEPT, *columns]] for values in arrays
    )
    return LogisticFit([INTERCEPT, *terms], estimates, errors, z, p, design, model, df.sparkSession)


def propensity_score(
    df: DataFrame, treatment: str, design: Design, out: str = "distance", collapse: bool = True
) -> DataFrame:
    """Complete cases with the fitted probability of treatment."""
    fit = fit_logistic(df, treatment, design, collapse)
    return fit.score(design.complete(df).where(F.col(treatment).isNotNull()), out)
