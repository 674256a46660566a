"""Typed scans, CSV import, dataset checkpoints and result output."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DataType, DoubleType, LongType, StringType, StructField, StructType

from episodica.session import ensure_checkpoint_dir

# Input tables of the cohort study: column names and types.
CLINICAL_SCHEMAS: dict[str, str] = {
    "patient": (
        "uniquepid string, patienthealthsystemstayid bigint, patientunitstayid bigint, "
        "unitvisitnumber bigint, hospitalid bigint, unittype string, hospitaladmitoffset bigint, "
        "hospitaldischargeoffset bigint, unitdischargeoffset bigint, hospitaldischargeyear bigint, "
        "age string, apacheadmissiondx string, hospitaldischargestatus string, "
        "unitdischargestatus string, gender string, ethnicity string, "
        "admissionheight double, admissionweight double"
    ),
    "diagnosis": "patientunitstayid bigint, diagnosisstring string, diagnosisoffset bigint",
    "treatment": "patientunitstayid bigint, treatmentstring string, treatmentoffset bigint",
    "lab": "patientunitstayid bigint, labname string, labresult double, labresultoffset bigint",
    "microlab": "patientunitstayid bigint, organism string, culturetakenoffset bigint",
    "medication": "patientunitstayid bigint, drugname string, drugstartoffset bigint",
    "nursecare": "patientunitstayid bigint, nursecareoffset bigint, cellattributevalue string",
    "pivoted_vital": (
        "patientunitstayid bigint, chartoffset bigint, heartrate double, respiratoryrate double, "
        "spo2 double, ibp_mean double, nibp_mean double, temperature double, temperaturelocation string"
    ),
    "pivoted_vital_other": (
        "patientunitstayid bigint, chartoffset bigint, co double, ci double, svo2 double, "
        "svr double, svri double"
    ),
    "pivoted_bg": "patientunitstayid bigint, chartoffset bigint, pao2 double, fio2 double",
    "pivoted_uo": "patientunitstayid bigint, chartoffset bigint, urineoutput double",
    "apachepatientresult": "patientunitstayid bigint, apachescore double",
    "apache_groups": "patientunitstayid bigint, apachedxgroup string",
    "hospital": "hospitalid bigint, region string",
    "infection_diagnosis": "diagnosisstring string",
    "sofascore": "patientunitstayid bigint, sofatotal bigint",
    "tempsite": "temperaturelocation string, tempsite_flag string",
}


def scan(spark: SparkSession, path: str, schema: str | StructType | None = None) -> DataFrame:
    """Columnar scan; filters and column choice on the result reach the files."""
    reader = spark.read
    if schema is not None:
        reader = reader.schema(schema)
    return reader.parquet(path)


def load_clinical(
    spark: SparkSession, root: str, overrides: Mapping[str, DataFrame] | None = None
) -> dict[str, DataFrame]:
    """All study tables under ``root/<name>``; ``overrides`` supplies some directly. NaN becomes NULL in all of them."""
    given = dict(overrides or {})
    return {
        name: nan_to_null(given[name] if name in given else scan(spark, f"{root}/{name}", ddl))
        for name, ddl in CLINICAL_SCHEMAS.items()
    }


def load_sample(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the star-schema sample tables."""
    return scan(spark, f"{sf_dir}/{name}.parquet")


#: What the text of a value must look like to be of a type, from the narrowest type to the widest; all else is text.
_TYPES = {
    "boolean": r"^(?:TRUE|FALSE|True|False|true|false)$",
    "bigint": r"^[+-]?[0-9]+$",
    "double": r"^[+-]?(?:[0-9]+[.]?[0-9]*|[.][0-9]+)(?:[eE][+-]?[0-9]+)?$",
}
_SPARK_TYPES: dict[str, DataType] = {"boolean": BooleanType(), "bigint": LongType(), "double": DoubleType(), "string": StringType()}
UNKNOWN = "NA"


def infer_schema(spark: SparkSession, path: str) -> StructType:
    """Types of a CSV file with header, from all of its values in one aggregation.

    A column is of the narrowest type that all its known values fit: logical, integer (if all fit a long), number or text. ``NA`` and blanks
    fit every type; a column without any known value is a number.
    """
    names = spark.read.csv(path, header=True, inferSchema=False).columns
    raw = spark.read.csv(path, header=True, schema=StructType([StructField(n, StringType()) for n in names]))
    tests = []
    for i, n in enumerate(names):
        known = F.when((F.col(f"`{n}`") != "") & (F.col(f"`{n}`") != UNKNOWN), F.col(f"`{n}`"))
        # a long is wider than its text tells: too many digits are numbers
        fits = {t: known.rlike(pattern) for t, pattern in _TYPES.items()}
        fits["bigint"] = fits["bigint"] & known.try_cast("bigint").isNotNull()
        tests += [F.count(known).alias(f"{i}_n"), *[F.count_if(fit).alias(f"{i}_{t}") for t, fit in fits.items()]]
    seen = raw.agg(*tests).first()  # four numbers for each column

    def narrowest(i: int) -> str:
        if not seen[f"{i}_n"]:
            return "double"
        return next((t for t in _TYPES if seen[f"{i}_{t}"] == seen[f"{i}_n"]), "string")

    return StructType([StructField(n, _SPARK_TYPES[narrowest(i)]) for i, n in enumerate(names)])


def read_csv(spark: SparkSession, path: str, schema: str | StructType | None = None) -> DataFrame:
    """CSV with header; types are stated, or inferred from all rows. ``NA`` reads as NULL; a blank is empty in a text column and NULL in others."""
    raw = spark.read.csv(path, header=True, schema=schema if schema is not None else infer_schema(spark, path))
    texts = {f.name for f in raw.schema.fields if f.dataType.typeName() == "string"}
    return raw.select(*[
        F.nullif(F.coalesce(f"`{c}`", F.lit("")), F.lit(UNKNOWN)).alias(c) if c in texts else F.col(f"`{c}`") for c in raw.columns
    ])


def write_dataset(df: DataFrame, path: str) -> DataFrame:
    """Write a stage result and read it back: the next stage starts from files."""
    df.write.mode("overwrite").parquet(path)
    return scan(df.sparkSession, path, df.schema)


def read_dataset(spark: SparkSession, path: str) -> DataFrame:
    return scan(spark, path)


def emit(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Write a result for other tools (``parquet`` or ``csv``)."""
    writer = df.write.mode("overwrite")
    if fmt == "csv":
        writer.option("header", True).option("nullValue", "NA").csv(path)
    else:
        writer.format(fmt).save(path)


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def dealt(df: DataFrame, key: str) -> DataFrame:
    """The rows with a known key, dealt by it and kept: later aggregates and joins by that key move nothing.

    For a narrow table from which several wider ones are derived row by row.
    """
    conf = df.sparkSession.conf
    parts, adaptive = max(int(conf.get("spark.sql.shuffle.partitions")), 1), conf.get("spark.sql.adaptive.enabled")
    # an adaptive plan has no partitioning that a checkpoint could keep; there is nothing to adapt in this one
    conf.set("spark.sql.adaptive.enabled", "false")
    try:
        return checkpointed(df.where(F.col(key).isNotNull()).repartition(parts, key))
    finally:
        conf.set("spark.sql.adaptive.enabled", adaptive)


def nan_to_null(df: DataFrame) -> DataFrame:
    """Unknown is always NULL: turn NaN in floating columns into NULL."""
    floats = {f.name for f in df.schema.fields if f.dataType.typeName() in ("double", "float")}
    return df.select(*[
        F.nanvl(F.col(f"`{c}`"), F.lit(None)).alias(c) if c in floats else F.col(f"`{c}`")
        for c in df.columns
    ])


def repeated_keys(df: DataFrame, keys: Iterable[str]) -> DataFrame:
    """Keys that occur more than once, with their count."""
    keys = list(keys)
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def assert_unique(df: DataFrame, keys: Iterable[str]) -> DataFrame:
    """Raise if a key repeats; returns the input so that calls can be chained."""
    keys = list(keys)
    if not repeated_keys(df, keys).isEmpty():
        raise ValueError(f"rows are not unique by {keys}")
    return df
