"""Stored weights: each day's weights are decided once and kept.

The store is a Parquet table keyed by (id, start_date, end_date, DCA_date) with a folder for each
day (``DCA_date``). A run writes the folders of the days it decides, whole, by dynamic partition
overwrite: run again it finds nothing new, and a run that was cut off is simply repeated.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from daywright.functions.numeric import as_column
from daywright.operators.rolling import DEFAULT_KEYS, Keys
from daywright.operators.windows import BLOCK, window_block, window_number
from daywright.settings import WINDOW_BLOCK_DAYS

LOCK_KEYS = ("id", "start_date", "end_date", "DCA_date")
STORE_SCHEMA = "id string, start_date date, end_date date, weight double, DCA_date date"

#: Column of a weight table: the weight that the store has for the row, null if it has none.
LOCKED = "locked_weight"


def to_locked(weights: DataFrame, current_date, id_column: str = DEFAULT_KEYS[0]) -> DataFrame:
    """Rows of a weight table that are decided on ``current_date``, in stored form."""
    return weights.where(F.col("date") <= as_column(current_date).cast("date")).select(
        F.col(id_column).alias("id"),
        F.col("window_start").alias("start_date"),
        F.col("window_end").alias("end_date"),
        F.col("date").alias("DCA_date"),
        "weight",
    )


def new_locked(
    weights: DataFrame, current_date, stored: DataFrame | None = None, id_column: str = DEFAULT_KEYS[0]
) -> DataFrame:
    """Decided rows that are not stored yet. Running it again adds nothing.

    Weights that were built with the store say so themselves (``locked_weight``): no join. For others
    ``stored`` is needed.
    """
    if LOCKED in weights.columns:
        return to_locked(weights.where(F.col(LOCKED).isNull()), current_date, id_column)
    fresh = to_locked(weights, current_date, id_column)
    return fresh if stored is None else fresh.join(stored.select(*LOCK_KEYS), list(LOCK_KEYS), "left_anti")


def packed(
    stored: DataFrame, id_column: str = DEFAULT_KEYS[0], rolling: bool = True, block_days: int = WINDOW_BLOCK_DAYS
) -> DataFrame:
    """Stored weights as one row a series, block of windows and day: a map from the window's number to its weight.

    The size of a block bounds the map; blocks are those of a rolling range or of a table of windows. Rows stored twice alike are one; two weights
    for one key fail the job.
    """
    start, end = F.col("start_date"), F.col("end_date")
    entry = F.struct(window_number(start, end).alias("window"), F.col("weight").alias("weight"))
    return (
        stored.where(F.col("weight").isNotNull())
        .groupBy(F.col("id").alias(id_column), window_block(start, None if rolling else end, block_days).alias(BLOCK), F.col("DCA_date").alias("date"))
        .agg(F.map_from_entries(F.collect_set(entry)).alias("known"))
    )


def read_store(spark: SparkSession, path: str) -> DataFrame | None:
    """The stored weights; nothing before the first run."""
    try:
        return spark.read.schema(STORE_SCHEMA).parquet(path)
    except Exception as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return None


def append_locked(weights: DataFrame, path: str, current_date, id_column: str = DEFAULT_KEYS[0]) -> int:
    """Bring the newly decided rows into the store at ``path``; how many days they touch.

    The new rows are written beside the table first (``_fresh``, which readers pass over), so that the
    weights are built once. The folder of a day that has new rows is replaced by what it held and
    them; only those folders are read. A day without new rows is not touched.
    """
    spark = weights.sparkSession
    stored = read_store(spark, path)
    staged = f"{path.rstrip('/')}/_fresh"
    new_locked(weights, current_date, stored, id_column).write.mode("overwrite").parquet(staged)
    fresh = spark.read.schema(STORE_SCHEMA).parquet(staged)
    days = [row[0] for row in fresh.select("DCA_date").distinct().collect()]  # as many as the calendar has at most
    if not days:
        return 0
    if stored is not None:
        fresh = fresh.unionByName(stored.where(F.col("DCA_date").isin(days)))
    columns = ("id", "start_date", "end_date", "weight", "DCA_date")
    fresh.select(*columns).repartition("DCA_date").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
        "DCA_date"
    ).parquet(path)
    return len(days)


def compare_weights(a: DataFrame, b: DataFrame, keys: Keys = DEFAULT_KEYS, tolerance: float = 1e-12) -> DataFrame:
    """Per window over common dates: days compared, greatest difference, equality."""
    on = [*keys, "window_start", "window_end", "date"]
    both = a.select(*on, F.col("weight").alias("_a")).join(
        b.select(*on, F.col("weight").alias("_b")), on
    )
    return (
        both.groupBy(*keys, "window_start", "window_end")
        .agg(
            F.count(F.lit(1)).alias("days"),
            F.max(F.abs(F.col("_a") - F.col("_b"))).alias("max_diff"),
        )
        .withColumn("all_equal", F.col("max_diff") < tolerance)
    )
