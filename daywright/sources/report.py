"""JSON report sink: nested documents cut into chunks.

A series has a header document (time, summary metrics, number of windows and chunks) and one document
for each block of window starts, so that a list of any length is spread over many rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from daywright.functions.labels import ISO_FORMAT
from daywright.operators.metrics import METRICS
from daywright.operators.rolling import DEFAULT_KEYS, Keys

# Field order of the report's window entries: fixed values.
REPORT_FIELDS = (
    "window",
    "start_date",
    "dynamic_percentile",
    "uniform_percentile",
    "excess_percentile",
    "dynamic_sats_per_dollar",
    "uniform_sats_per_dollar",
    "min_sats_per_dollar",
    "max_sats_per_dollar",
)

#: Days of window starts in one chunk.
CHUNK_DAYS = 256

HEADER = "header"


def _json(*fields) -> Column:
    return F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})


def report_documents(
    windows: DataFrame, metrics: DataFrame, keys: Keys = DEFAULT_KEYS, at: Column | None = None, chunk_days: int = CHUNK_DAYS
) -> DataFrame:
    """(keys, chunk, document): a header and the chunks of each series as JSON text.

    A chunk is named by the first day of its block of starts. ``at`` is the time of the report.
    """
    day = F.unix_date(F.to_date(F.substring("start_date", 1, 10)))
    chunk = F.date_format(F.date_from_unix_date((F.floor(day / chunk_days) * chunk_days).cast("int")), "yyyy-MM-dd")
    entry = F.struct("start_date", "window", F.struct(*REPORT_FIELDS).alias("entry"))
    chunks = (
        windows.groupBy(*keys, chunk.alias("chunk"))
        .agg(F.array_sort(F.collect_list(entry)).alias("_rows"), F.count(F.lit(1)).alias("_n"))
        .withColumn("document", _json(*keys, "chunk", F.transform("_rows", lambda r: r["entry"]).alias("window_level_data")))
    )
    counts = windows.groupBy(*keys).agg(F.count(F.lit(1)).alias("windows"), F.count_distinct(chunk).alias("chunks"))
    time = F.date_format(F.current_timestamp() if at is None else at, ISO_FORMAT).alias("timestamp")
    header = metrics.join(counts, list(keys), "left").fillna(0, ["windows", "chunks"]).select(
        *keys,
        F.lit(HEADER).alias("chunk"),
        _json(*keys, F.lit(HEADER).alias("chunk"), time, F.struct(*METRICS).alias("summary_metrics"), "windows", "chunks").alias("document"),
    )
    return header.unionByName(chunks.select(*keys, "chunk", "document"))


def write_report(windows: DataFrame, metrics: DataFrame, path: str, keys: Keys = DEFAULT_KEYS) -> None:
    """One document a line."""
    report_documents(windows, metrics, keys).select("document").write.mode("overwrite").text(path)
