"""Order statistics of whole columns without a single-task sort.

A column is first reduced to a histogram (distinct value -> count), which
combines map-side, so a value held by a third of all rows is one row. The rows are
then cut into range partitions of (group, value) and kept: running totals are
taken inside each partition and shifted by what earlier partitions hold of its
first group. A group of any size spreads over many partitions, and the driver
sees one short row per partition.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from episodica.operators.episodes import bounded
from episodica.sources.tables import checkpointed

CHUNK = 100_000

VARIABLE = "variable"
PART = "_part"


def stacked(df: DataFrame, variables: Sequence[str], keep: Sequence[str], value: str, to: str) -> DataFrame:
    """Several columns as rows (keep..., variable, value).

    An inline array rather than ``unpivot``: plans that use the result twice then
    share one shuffle, which they do not above the expansion of ``unpivot``.
    """
    cells = [F.struct(F.lit(v).alias(VARIABLE), F.col(v).cast(to).alias(value)) for v in variables]
    return df.select(*keep, F.inline(F.array(*cells)))


def long_values(df: DataFrame, variables: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Known values of several numeric columns as rows (keep..., variable, value)."""
    return stacked(df, variables, keep, "value", "double").where(F.col("value").isNotNull())


def histogram(long: DataFrame, by: Sequence[str], value: str = "value") -> DataFrame:
    """Row count of each distinct value per ``by`` group."""
    return long.groupBy(*by, value).agg(F.count(F.lit(1)).alias("n"))


def ordered(
    rows: DataFrame, within: Sequence[str], order: Sequence[str | Column], merge: Mapping[str, Column] | None = None
) -> DataFrame:
    """Range partitions of (``within``, ``order``), sorted and kept, with the number of a row's partition.

    ``merge`` aggregates rows of equal keys once they are in one partition, which costs no further shuffle.
    Neither key may be so long-tailed in rows of equal keys that these do not fit one task; without ``merge`` break ties in ``order``.
    """
    cut = rows.repartitionByRange(*within, *order)
    if merge is not None:
        cut = cut.groupBy(*within, *order).agg(*[c.alias(n) for n, c in merge.items()])
    # The number must be taken before anything else is done with the partitions.
    return checkpointed(cut.sortWithinPartitions(*within, *order).withColumn(PART, F.spark_partition_id()))


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Runs of rows of one partition."""
    for batch in batches:
        part = batch.column(PART).to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(part)]
        for lo, hi in zip(cuts, cuts[1:]):
            if hi > lo:
                yield int(part[lo]), batch.slice(lo, hi - lo)


def _opens(piece: pa.RecordBatch, within: Sequence[str]) -> np.ndarray:
    """Rows other than the first that begin a new group."""
    out = np.zeros(piece.num_rows, bool)
    for name in within:
        c = piece.column(name)
        out[1:] |= pc.fill_null(pc.not_equal(c.slice(1), c.slice(0, len(c) - 1)), True).to_numpy(zero_copy_only=False)
    return out


def _key(piece: pa.RecordBatch, within: Sequence[str], row: int) -> tuple:
    return tuple(piece.column(c)[row].as_py() for c in within)


def _amount(piece: pa.RecordBatch, name: str) -> np.ndarray:
    return pc.fill_null(piece.column(f"_{name}"), 0).to_numpy(zero_copy_only=False)


def _ends(within: Sequence[str], names: Sequence[str]):
    """Of every partition: its number, first and last group, and what it holds of the last one."""

    def task(batches):
        parts: dict[int, list] = {}
        for part, piece in _pieces(batches):
            opens = np.flatnonzero(_opens(piece, within))
            first, last = _key(piece, within, 0), _key(piece, within, piece.num_rows - 1)
            seen = parts.setdefault(part, [first, first, [0] * len(names)])
            goes_on = seen[1] == first and not len(opens)
            tail = [_amount(piece, n)[opens[-1] if len(opens) else 0 :].sum().item() for n in names]
            seen[2] = [a + b for a, b in zip(seen[2], tail)] if goes_on else tail
            seen[1] = last
        rows = [pickle.dumps((part, *seen)) for part, seen in parts.items()]
        yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary())], ["end"])

    return task


def _starts(ends: Sequence[tuple], width: int) -> dict[int, list]:
    """What the partitions before each one hold of its first group."""
    starts, key, so_far = {}, None, [0] * width
    for part, first, last, tail in sorted(ends, key=lambda e: e[0]):
        starts[part] = so_far if first == key else [0] * width
        so_far = [a + b for a, b in zip(starts[part], tail)] if first == last else tail
        key = last
    return starts


def running_totals(cut: DataFrame, within: Sequence[str], amounts: Mapping[str, str | Column]) -> DataFrame:
    """Adds ``<name>_upto``: the total over the rows of the group up to and including this one.

    ``cut`` comes from ``ordered`` with the same groups (none: one group), through steps that neither move nor drop rows; the result may be
    used so again. Groups have no NULL; NULL amounts count as 0.
    """
    names = list(amounts)
    rows = cut.withColumns({f"_{n}": F.col(c) if isinstance(c, str) else c for n, c in amounts.items()})
    narrow = rows.select(PART, *within, *[f"_{n}" for n in names])
    ends = [pickle.loads(r["end"]) for r in narrow.mapInArrow(_ends(within, names), "end binary").collect()]
    starts = _starts(ends, len(names))
    kept = cut.columns

    def task(batches):
        before = None
        for part, piece in _pieces(batches):
            first = _key(piece, within, 0)
            if before is None or before[0] != part:
                carry = starts[part]
            else:
                carry = before[2] if before[1] == first else [0] * len(names)
            opens = _opens(piece, within)
            at = np.maximum.accumulate(np.where(opens, np.arange(len(opens)), 0))
            totals = []
            for n, c in zip(names, carry):
                amount = _amount(piece, n)
                sums = np.cumsum(amount)
                totals.append(np.where(at > 0, sums - (sums[at] - amount[at]), sums + c))
            before = part, _key(piece, within, piece.num_rows - 1), [t[-1].item() for t in totals]
            yield pa.RecordBatch.from_arrays(
                [*[piece.column(c) for c in kept], *[pa.array(t) for t in totals]], [*kept, *[f"{n}_upto" for n in names]]
            )

    types = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    schema = ", ".join([*[f"`{c}` {types[c]}" for c in kept], *[f"`{n}_upto` {types[f'_{n}']}" for n in names]])
    return rows.mapInArrow(task, schema)


def with_group_totals(rows: DataFrame, within: Sequence[str], amounts: Mapping[str, str]) -> DataFrame:
    """Adds ``<name>_all``, the total of the group. Groups are broadcast if a count shows that they are few."""
    totals = rows.groupBy(*within).agg(*[F.sum(c).alias(f"{n}_all") for n, c in amounts.items()])
    if not within:
        one = totals.first()  # one row
        return rows.withColumns({f"{n}_all": F.lit(one[f"{n}_all"]) for n in amounts})
    return rows.join(bounded(totals) or totals, list(within))


def exact_quantiles(
    hist: DataFrame, within: Sequence[str], probs: Mapping[str, float], value: str = "value"
) -> DataFrame:
    """Quantiles with linear interpolation between the order statistics.

    A value may come in several rows of a group; they count together.
    """
    cut = ordered(hist, within, [value], {"n": F.sum("n")})
    ranked = with_group_totals(running_totals(cut, within, {"n": "n"}), within, {"n": "n"})
    before = F.col("n_upto") - F.col("n")
    parts, results = [], []
    for name, p in probs.items():
        position = (F.col("n_all") - 1) * F.lit(p)
        for side, rank in (("lo", F.floor(position)), ("hi", F.ceil(position))):
            here = (before <= rank) & (rank < F.col("n_upto"))
            parts.append(F.max(F.when(here, F.col(value))).alias(f"_{name}_{side}"))
        fraction = (F.col("_n") - 1) * F.lit(p) - F.floor((F.col("_n") - 1) * F.lit(p))
        low, high = F.col(f"_{name}_lo"), F.col(f"_{name}_hi")
        results.append((low + (high - low) * fraction).alias(name))
    return ranked.groupBy(*within).agg(F.max("n_all").alias("_n"), *parts).select(*within, *results)


def repeat_rows(df: DataFrame, count: str, index: str, spread: Sequence[str]) -> DataFrame:
    """Repeats each row ``count`` times with a 0-based index.

    Large counts are cut into chunks that are spread over the tasks first, so no
    array and no task holds all copies of one row.
    """
    chunks = df.withColumn(
        "_chunk", F.explode(F.sequence(F.lit(0).cast("bigint"), F.expr(f"({count} - 1) div {CHUNK}")))
    )
    first = F.col("_chunk") * CHUNK
    last = F.least(first + CHUNK, F.col(count)) - 1
    return (
        chunks.repartition(*spread, "_chunk")
        .withColumn(index, F.explode(F.sequence(first, last)))
        .drop("_chunk")
    )
