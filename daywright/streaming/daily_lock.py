"""Lock weights as new days arrive.

The daily advance is an incremental batch job; this wraps the same job in ``foreachBatch``.
A replayed batch changes nothing, because what is stored is left as it is.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from daywright.operators.locked import append_locked
from daywright.operators.rolling import DEFAULT_KEYS

WeightsOn = Callable[[SparkSession, date], DataFrame]


def lock_on_arrival(
    days: DataFrame, weights_on: WeightsOn, path: str, checkpoint: str, id_column: str = DEFAULT_KEYS[0]
) -> StreamingQuery:
    """Start a query that locks the weights of the days in each batch.

    ``days`` is a stream of (series, ``date``), ``weights_on(spark, day)`` returns the weight table
    as of a day. The days of a batch are locked one after another, each for the series that have it in
    the batch: a series that lags behind the others is locked when its own days come. Processes what
    is available and ends.
    """

    def on_batch(batch: DataFrame, _: int) -> None:
        arrived = batch.select(id_column, "date").distinct().persist()
        try:
            # One value a calendar day of the batch; the series stay on the executors.
            for (day,) in arrived.select("date").where("date IS NOT NULL").distinct().orderBy("date").collect():
                series = arrived.where(arrived["date"] == day).select(id_column)
                weights = weights_on(batch.sparkSession, day).join(series, id_column, "left_semi")
                append_locked(weights, path, day, id_column)
        finally:
            arrived.unpersist()

    return (
        days.writeStream.foreachBatch(on_batch)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
