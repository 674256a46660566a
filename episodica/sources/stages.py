"""Stages in buckets of a key, each with a marker that names its inputs.

A stage is written to a folder of its own and counts only when its marker, written
last, names that folder and what it was made from. A stage whose writing ended halfway has no marker
and is never read. Stages in equal buckets of one key join without a shuffle.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

MARKER_SCHEMA = "inputs string, folder string, key string, buckets int, schema string"


class StageStore:
    """Stages below ``root``, a folder that driver and executors share.

    ``buckets`` is the number of buckets of keyed stages: about the size of the largest stage over what one task should
    read. It is part of what a stage was made from, so another number gives new stages.
    """

    def __init__(self, spark: SparkSession, root: str, buckets: int = 200):
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets

    def keep(self, name: str, inputs: str, build: Callable[[], DataFrame], key: str | None = None) -> DataFrame:
        """The stage made from ``inputs`` (a text that names tables, versions and settings); built and written only if there is none.

        With ``key`` the rows are in buckets of that column, sorted in each. Rows with a NULL key are kept in a bucket as well.
        """
        if not re.fullmatch(r"[A-Za-z0-9_]+", name):
            raise ValueError(f"{name!r} is no name of a stage")
        known = json.dumps([inputs, key, self.buckets if key else None])
        found = self._marker(name, known)
        if found is None:
            folder = f"{self.root}/{name}/data-{uuid.uuid4().hex}"
            df = build()
            self._write(df, folder, key)
            row = (known, folder, key, self.buckets if key else None, df.schema.json())
            self.spark.createDataFrame([row], MARKER_SCHEMA).coalesce(1).write.mode("overwrite").parquet(self._marker_path(name, known))
            found = self._marker(name, known)
        return self._read(found)

    def drop_others(self, name: str, inputs: str, key: str | None = None) -> int:
        """Delete all stages of ``name`` but the one made from ``inputs``, half-written ones too; the number of deleted folders.

        Not to be called while another application writes a stage of that name.
        """
        known = json.dumps([inputs, key, self.buckets if key else None])
        found = self._marker(name, known)
        wanted = {self._marker_path(name, known), found["folder"] if found else ""}
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        here = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        fs = here.getFileSystem(conf)
        if not fs.exists(here):
            return 0
        last = {w.rsplit("/", 1)[-1] for w in wanted}
        old = [s.getPath() for s in fs.listStatus(here) if s.getPath().getName() not in last]
        for path in old:
            self.spark.sql(f"DROP TABLE IF EXISTS {self._table(path.getName())}")
            fs.delete(path, True)
        return len(old)

    # markers go first by what they name, so that asking for a stage opens one small file
    def _marker_path(self, name: str, known: str) -> str:
        return f"{self.root}/{name}/done-{hashlib.sha256(known.encode()).hexdigest()[:32]}"

    def _marker(self, name: str, known: str):
        try:
            rows = self.spark.read.schema(MARKER_SCHEMA).parquet(self._marker_path(name, known)).where(F.col("inputs") == known).head(1)
        except AnalysisException:
            return None  # there is no such folder
        return rows[0] if rows else None

    @staticmethod
    def _table(folder: str) -> str:
        return "stage_" + re.sub("[^A-Za-z0-9]", "_", folder.rsplit("/", 1)[-1])

    def _write(self, df: DataFrame, folder: str, key: str | None) -> None:
        if key is None:
            df.write.parquet(folder)
            return
        cut = df.repartition(self.buckets, key)
        cut.write.format("parquet").bucketBy(self.buckets, key).sortBy(key).option("path", folder).saveAsTable(self._table(folder))

    def _read(self, marker) -> DataFrame:
        schema = StructType.fromJson(json.loads(marker["schema"]))
        if marker["key"] is None:
            return self.spark.read.schema(schema).parquet(marker["folder"])
        table = self._table(marker["folder"])
        if not self.spark.catalog.tableExists(table):  # written by an earlier session
            columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
            self.spark.sql(f"CREATE TABLE {table} ({columns}) USING parquet LOCATION '{marker['folder']}' "
                           f"CLUSTERED BY (`{marker['key']}`) SORTED BY (`{marker['key']}`) INTO {marker['buckets']} BUCKETS")
        # what the columns carry besides their type, such as the levels of factors
        return self.spark.table(table).select(*[
            F.col(f"`{f.name}`").alias(f.name, metadata=f.metadata) if f.metadata else F.col(f"`{f.name}`") for f in schema.fields
        ])
