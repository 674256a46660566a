"""Kaplan-Meier curves, risk tables and log-rank tests.

The log-rank tests keep groups as rows. Rows of (time, group) are cut into range
partitions of time; each partition starts from what leaves later of every
group, goes backwards through its times with the number at risk of all groups as
one vector, and adds up outer products of these vectors. Only a k x k matrix leaves
a partition, also as rows, and meets one task where its system is solved.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from episodica.functions.pvalues import chi2_p
from episodica.operators.episodes import bounded
from episodica.operators.hypothesis import adjust_p
from episodica.operators.ranks import PART, ordered, running_totals, with_group_totals
from episodica.sources.tables import checkpointed

#: Numbers in a block of risk vectors that a task holds.
BLOCK = 1 << 20


def _timed(df: DataFrame, time: str, event: str, group: str) -> DataFrame:
    """Complete cases as (group, time, event)."""
    return df.select(
        F.col(group).alias("group"), F.col(time).cast("double").alias("time"), F.col(event).cast("int").alias("event")
    ).na.drop(subset=["group", "time", "event"])


def _steps(df: DataFrame, time: str, event: str, group: str) -> DataFrame:
    """Subjects and events of every group at each of its times."""
    return _timed(df, time, event, group).groupBy("group", "time").agg(
        F.count(F.lit(1)).alias("n"), F.sum("event").alias("n_event")
    )


def km_curve(df: DataFrame, time: str, event: str, group: str) -> DataFrame:
    """Product-limit estimate at every observed time of each group, in percent."""
    steps = with_group_totals(_steps(df, time, event, group), ["group"], {"n": "n"})
    seen = running_totals(ordered(steps, ["group"], ["time"]), ["group"], {"n": "n"})
    seen = seen.withColumn("n_risk", F.col("n_all") - F.col("n_upto") + F.col("n"))
    all_die = F.col("n_event") == F.col("n_risk")
    log_step = F.when(~all_die, F.log1p(-F.col("n_event") / F.col("n_risk"))).otherwise(0.0)
    zero = F.when(all_die, 1).otherwise(0).cast("bigint")
    curve = running_totals(seen, ["group"], {"log": log_step, "zero": zero})
    survival = F.when(F.col("zero_upto") > 0, 0.0).otherwise(F.exp("log_upto")) * 100
    return curve.select(
        "group", "time", "n_risk", "n_event", (F.col("n") - F.col("n_event")).alias("n_censor"), survival.alias("survival_pct")
    )


def risk_table(df: DataFrame, time: str, event: str, group: str, grid: Sequence[float]) -> DataFrame:
    """Number still at risk at each grid time, in one aggregation."""
    rows = df.where(F.col(time).isNotNull() & F.col(event).isNotNull() & F.col(group).isNotNull())
    wide = rows.groupBy(F.col(group).alias("group")).agg(
        *[F.count_if(F.col(time) >= F.lit(x)).alias(f"_{i}") for i, x in enumerate(grid)]
    )
    cells = F.array(*[
        F.struct(F.lit(float(x)).alias("time"), F.col(f"_{i}").alias("n_risk")) for i, x in enumerate(grid)
    ])
    return wide.select("group", F.inline(cells))


def _numbered(steps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The groups with numbers from 0 in their order, and the steps with them."""
    sizes = steps.groupBy("group").agg(F.sum("n").alias("n"), F.sum("n_event").alias("observed"))
    levels = running_totals(ordered(sizes, [], ["group"]), [], {"g": F.lit(1).cast("bigint")})
    levels = levels.select("group", (F.col("g_upto") - 1).alias("g"), F.col("n").alias("size"), "observed")
    few = bounded(levels.select("group", "g"))
    return levels, steps.join(few if few is not None else levels.select("group", "g"), "group")


def _suffixes(parts: int):
    """Of one group: what leaves after each partition of times, from what leaves in each."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            g, part, n = [], [], []
            for group, at, count in zip(*(c.to_pylist() for c in batch.columns)):
                leaving = np.zeros(parts, np.int64)
                leaving[at] = count
                later = leaving[::-1].cumsum()[::-1] - leaving
                some = np.flatnonzero(later)
                g += [group] * len(some)
                part += some.tolist()
                n += later[some].tolist()
            yield pa.RecordBatch.from_arrays([pa.array(g, pa.int64()), pa.array(part, pa.int32()), pa.array(n, pa.int64())], ["g", PART, "n"])

    return task


def _risk_blocks(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks of (at risk, events) by distinct time and group, of rows sorted by partition, start first, and falling time."""
    part, risk = None, np.zeros(k, np.int64)
    times: list[float] = []
    cells: list[tuple[np.ndarray, ...]] = []

    def flush():
        nonlocal risk, times, cells
        if not times:
            return None
        row, g, n, d = (np.concatenate(c) for c in zip(*cells))
        leaving, events = np.zeros((len(times), k), np.int64), np.zeros((len(times), k), np.int64)
        np.add.at(leaving, (row, g), n)
        np.add.at(events, (row, g), d)
        at_risk = leaving.cumsum(0) + risk
        risk, times, cells = at_risk[-1].copy(), [], []
        return at_risk, events

    for batch in batches:
        parts, start, time, g, n, d = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
        cuts = [0, *(np.flatnonzero(np.diff(parts) | (np.diff(start.astype(np.int8)) != 0)) + 1).tolist(), len(parts)]
        for lo, hi in zip(cuts, cuts[1:]):
            if hi == lo:
                continue
            if parts[lo] != part:
                if (block := flush()) is not None:
                    yield block
                part, risk = parts[lo], np.zeros(k, np.int64)
            if start[lo]:
                np.add.at(risk, g[lo:hi], n[lo:hi])
                continue
            while lo < hi:
                # as many rows as distinct times may be held; equal times stay in one block
                new = np.flatnonzero(np.diff(time[lo:hi], prepend=times[-1] if times else np.nan) != 0)
                room = max(1, BLOCK // k) - len(times)
                end = hi if len(new) <= room else lo + int(new[room])
                fresh = time[lo:end]
                opens = np.diff(fresh, prepend=times[-1] if times else np.nan) != 0
                row = len(times) - 1 + np.cumsum(opens)
                times += fresh[opens].tolist()
                cells.append((row, g[lo:end], n[lo:end], d[lo:end]))
                lo = end
                if lo < hi and (block := flush()) is not None:
                    yield block
    if (block := flush()) is not None:
        yield block


def _scale(d: np.ndarray, r: np.ndarray) -> np.ndarray:
    """d (r - d) / (r - 1) / r^2, and 0 where a single subject is left."""
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(r > 1, d * (r - d) / (r - 1) / (r * r), 0.0)


def _together(k: int):
    """Expected events (j = -1) and covariances (j >= i) of all groups."""

    def task(batches):
        expected, cov = np.zeros(k), np.zeros((k, k))
        for at_risk, events in _risk_blocks(batches, k):
            d, r = events.sum(1).astype(float), at_risk.sum(1).astype(float)
            live = d > 0
            risk, d, r = at_risk[live].astype(float), d[live], r[live]
            scale = _scale(d, r)
            expected += (d / r) @ risk
            cov -= risk.T @ (risk * scale[:, None])
            cov[np.diag_indices(k)] += (scale * r) @ risk
        i, j = np.triu_indices(k)
        yield _cells([np.arange(k), i], [np.full(k, -1), j], [expected, cov[i, j]], [np.zeros(k), np.zeros(len(i))])

    return task


def _by_pairs(k: int):
    """Observed minus expected events of the first group, and its variance, of every pair i < j."""

    def task(batches):
        gap, var = np.zeros((k, k)), np.zeros((k, k))
        for at_risk, events in _risk_blocks(batches, k):
            risk, events = at_risk.astype(float), events.astype(float)
            for i in range(k - 1):
                d, r = events[:, i + 1 :] + events[:, i : i + 1], risk[:, i + 1 :] + risk[:, i : i + 1]
                with np.errstate(divide="ignore", invalid="ignore"):
                    gap[i, i + 1 :] += (events[:, i : i + 1] - np.where(r > 0, d * risk[:, i : i + 1] / r, 0.0)).sum(0)
                var[i, i + 1 :] += (_scale(d, r) * risk[:, i : i + 1] * risk[:, i + 1 :]).sum(0)
        i, j = np.triu_indices(k, 1)
        yield _cells([i], [j], [gap[i, j]], [var[i, j]])

    return task


def _cells(i, j, a, b) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(np.concatenate(c).astype(t)) for c, t in ((i, np.int64), (j, np.int64), (a, float), (b, float))], ["i", "j", "a", "b"]
    )


def _sums(steps: DataFrame, k: int, work) -> DataFrame:
    """(i, j, a, b) of ``work`` over all times. ``steps`` has time, g, n and n_event."""
    cut = checkpointed(steps.select("time", "g", "n", "n_event").repartitionByRange("time").withColumn(PART, F.spark_partition_id()))
    parts = (cut.agg(F.max(PART)).first()[0] or 0) + 1
    leaving = cut.groupBy("g", PART).agg(F.sum("n").alias("n")).groupBy("g").agg(F.collect_list(F.struct(PART, "n")).alias("c"))
    starts = leaving.select("g", f"c.{PART}", "c.n").mapInArrow(_suffixes(parts), f"g bigint, {PART} int, n bigint")
    start = starts.select(PART, F.lit(True).alias("start"), F.lit(None).cast("double").alias("time"), "g", "n", F.lit(0).cast("bigint").alias("n_event"))
    rows = start.unionByName(cut.withColumn("start", F.lit(False)))
    dealt = rows.repartition(parts, PART).sortWithinPartitions(PART, F.desc("start"), F.desc("time"))
    found = dealt.select(PART, "start", "time", "g", "n", "n_event").mapInArrow(work(k), "i bigint, j bigint, a double, b double")
    return found.groupBy("i", "j").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))


def _listed(df: DataFrame, group: str, levels: Sequence | None) -> DataFrame:
    return df if levels is None else df.where(F.col(group).isin(list(levels)))


def _tested(df, time, event, group, levels, work) -> tuple[DataFrame, DataFrame]:
    """The numbered groups and the sums of ``work``."""
    groups, steps = _numbered(checkpointed(_steps(_listed(df, group, levels), time, event, group)))
    groups = checkpointed(groups)
    return groups, _sums(steps, max(groups.count(), 1), work)


def logrank_terms(
    df: DataFrame, time: str, event: str, group: str, levels: Sequence | None = None
) -> DataFrame:
    """Size, observed and expected events and variance of each group (of those in ``levels``, if given)."""
    groups, sums = _tested(df, time, event, group, levels, _together)
    own = sums.where("j = -1 OR i = j").groupBy("i").agg(
        F.max(F.when(F.col("j") < 0, F.col("a"))).alias("expected"), F.max(F.when(F.col("j") >= 0, F.col("a"))).alias("variance"))
    return groups.join(own, F.col("g") == F.col("i")).select(
        "group", F.col("size").alias("n"), F.col("observed").cast("double").alias("observed"), "expected", "variance"
    )


def _solve(pdf: pd.DataFrame) -> pd.DataFrame:
    """Quadratic form of the gaps of all groups with expected events but the first, by a Cholesky factor of their covariances."""
    heads = pdf[pdf.j < 0].sort_values("i")
    active = heads[heads.a > 0].i.to_numpy()
    place = {g: at for at, g in enumerate(active.tolist())}
    k = len(active)
    if k < 2:
        return pd.DataFrame({"statistic": [float("nan")], "df": pd.array([max(k - 1, 0)], dtype="int32")})
    gap = (heads.observed - heads.a).to_numpy()[heads.a.to_numpy() > 0]
    cells = pdf[(pdf.j >= 0) & pdf.i.isin(place) & pdf.j.isin(place)]
    cov = np.zeros((k, k))
    i, j = (cells[c].map(place).to_numpy() for c in ("i", "j"))
    cov[i, j] = cov[j, i] = cells.a.to_numpy()
    gap, cov = gap[1:], cov[1:, 1:]
    try:
        half = np.linalg.solve(np.linalg.cholesky(cov), gap)
        statistic = float(half @ half)
    except np.linalg.LinAlgError:  # groups that are never at risk together
        statistic = float(gap @ np.linalg.lstsq(cov, gap, rcond=None)[0])
    return pd.DataFrame({"statistic": [statistic], "df": pd.array([k - 1], dtype="int32")})


def logrank_test(
    df: DataFrame, time: str, event: str, group: str, levels: Sequence | None = None
) -> DataFrame:
    """Log-rank chi-square over all groups (those in ``levels``, if given); groups without expected events do not count."""
    groups, sums = _tested(df, time, event, group, levels, _together)
    observed = groups.select(F.col("g").alias("i"), F.col("observed").cast("double").alias("observed"))
    rows = sums.join(observed, "i").select(F.lit(event).alias("test"), "i", "j", "a", "observed")
    # the matrix of one test is one group by nature: k (k + 1) / 2 numbers
    solved = rows.groupBy("test").applyInPandas(_solve, "statistic double, df int")
    return solved.withColumn("p", chi2_p(F.col("statistic"), F.col("df")))


def pairwise_logrank(
    df: DataFrame, time: str, event: str, group: str, levels: Sequence | None = None, method: str = "bh"
) -> DataFrame:
    """Two-group log-rank tests of all pairs, from one pass over the times."""
    groups, sums = _tested(df, time, event, group, levels, _by_pairs)
    sides = {c: groups.select(F.col("g").alias(i), F.col("group").alias(c)) for i, c in (("i", "level_a"), ("j", "level_b"))}
    tests = sums.join(sides["level_a"], "i").join(sides["level_b"], "j").select(
        "level_a", "level_b", F.try_divide(F.col("a") * F.col("a"), F.col("b")).alias("statistic"), F.lit(event).alias("test")
    )
    tests = tests.withColumn("p", chi2_p(F.col("statistic"), F.lit(1)))
    return adjust_p(tests, ["test"], "p", method).drop("test")
