"""CSV source of the daily metrics table."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from daywright.operators.cleaning import clean_daily
from daywright.operators.ingest import CORRUPT, REJECTS, typed
from daywright.settings import SERIES


def read_text_csv(spark: SparkSession, path: str) -> DataFrame:
    """Every column as text, the file position ``_ord``, and ``_corrupt``: a row with too few or too many fields."""
    try:
        names = spark.read.csv(path, header=True).columns
    except AnalysisException as error:
        if "PATH_NOT_FOUND" in str(error):
            raise FileNotFoundError(path) from error
        raise
    schema = T.StructType([T.StructField(c, T.StringType()) for c in (*names, CORRUPT)])
    # Without pruning a row's fields are counted whichever columns are asked for.
    reader = spark.read.schema(schema).option("columnPruning", False)
    raw = reader.csv(path, header=True, mode="PERMISSIVE", columnNameOfCorruptRecord=CORRUPT)
    position = F.struct(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("start"),
        F.monotonically_increasing_id().alias("row"),
    )
    return raw.withColumn("_ord", position)


def read_daily_csv(spark: SparkSession, path: str, rejects: bool = False) -> DataFrame:
    """All columns but ``time`` and ``series_id`` as DOUBLE, plus the file position ``_ord``.

    No inference pass: columns are read as text and converted. Text that is no number is missing. With
    ``rejects`` the column ``_rejects`` says what could not be read (see ``ingest.reject_counts``).
    """
    text = read_text_csv(spark, path)
    numbers = [c for c in text.columns if c not in ("time", SERIES, "_ord", CORRUPT)]
    out = typed(text, {c: "double" for c in numbers})
    return out if rejects else out.drop(REJECTS)


def load_daily(spark: SparkSession, path: str, series: str = "ALL") -> DataFrame:
    """Cleaned daily table; a file without ``series_id`` is one series."""
    raw = read_daily_csv(spark, path)
    if SERIES not in raw.columns:
        raw = raw.withColumn(SERIES, F.lit(series))
    out = clean_daily(raw)
    return out.withColumnRenamed("CapMVRVCur", "mvrv") if "CapMVRVCur" in out.columns else out


def scan_daily(spark: SparkSession, path: str, rejects: bool = False) -> DataFrame:
    """The table as it is, with ``time`` parsed; neither truncated nor de-duplicated. A time in no known form is missing."""
    text = read_text_csv(spark, path).drop("_ord")
    kinds = {c: "time" if c == "time" else "double" for c in text.columns if c not in (SERIES, CORRUPT)}
    out = typed(text, kinds)
    return out if rejects else out.drop(REJECTS)
