"""Helpers that the operators share: stage tables, checked broadcasts, running sums."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from episodica.session import ensure_checkpoint_dir

#: Rows below which a key set may be broadcast; beyond it the same join shuffles.
BROADCAST_ROWS = 200_000


def stage_path(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back: cuts lineage, survives lost executors."""
    path = stage_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dropped(*stages: DataFrame) -> None:
    """Remove the files of stages from ``staged`` that nothing will read again: all that was made from them is itself kept."""
    for df in stages:
        jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
        for file in df.inputFiles()[:1]:
            folder = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(file)).getParent()
            folder.getFileSystem(conf).delete(folder, True)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Mark a narrow table for broadcast if a count shows that it is small, else leave the join to shuffle."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def narrowed(df: DataFrame, keys: DataFrame, on: str) -> DataFrame:
    """Drop rows that a following inner join on ``on`` would drop, if the keys are few enough to be broadcast."""
    return df.join(F.broadcast(keys), on, "left_semi") if keys.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def text_rows(docs: DataFrame) -> DataFrame:
    """Only the key and the text, whatever else the table has."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def running(df: DataFrame, group: str, order: Sequence[str], out: str, value: str | None = None) -> DataFrame:
    """Add, within each group in the given order, the sum of ``value`` over earlier rows (without it: their number, from 0).

    Rows are range-partitioned by group and order and kept as a stage, so a group
    spreads over many tasks; each task continues from the sums that earlier
    partitions have of the group. The driver sees one sum per partition and group
    that meets it (at most partitions plus groups). Null values count as 0; ``group`` has no nulls.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    # the number of a row's partition is kept in the row: a union or a coalesced read below would change the task's own
    cut = df.repartitionByRange(n, group, *order).sortWithinPartitions(group, *order).withColumn("_part", F.spark_partition_id()).checkpoint()
    step = F.coalesce(F.col(value), F.lit(0)).cast("long") if value else F.lit(1).cast("long")
    sums = cut.groupBy(F.col("_part").alias("part"), F.col(group).alias("g")).agg(F.sum(step).alias("s")).collect()
    starts, totals = {}, {}
    for r in sorted(sums, key=lambda r: (r["part"], r["g"])):
        starts[r["part"], r["g"]] = totals.get(r["g"], 0)
        totals[r["g"]] = totals.get(r["g"], 0) + r["s"]

    def add(batches):
        seen: dict = {}
        for batch in batches:
            part, of = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("_part", group))
            amount = batch.column(value).fill_null(0).to_numpy().astype(np.int64) if value else np.ones(len(part), np.int64)
            before = np.cumsum(amount) - amount
            # rows are in order, so a group is one run
            cuts = np.flatnonzero((part[1:] != part[:-1]) | (of[1:] != of[:-1])) + 1 if len(part) else []
            for lo, hi in zip([0, *cuts], [*cuts, len(part)]) if len(part) else ():
                key = int(part[lo]), of[lo].item() if hasattr(of[lo], "item") else of[lo]
                done = seen.get(key, 0)
                seen[key] = done + int(amount[lo:hi].sum())
                before[lo:hi] += starts[key] + done - before[lo]
            kept = [k for k, c in enumerate(batch.schema.names) if c != "_part"]
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in kept], pa.array(before)], [*[batch.schema.names[k] for k in kept], out])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return cut.mapInArrow(add, f"{schema}, `{out}` bigint")
