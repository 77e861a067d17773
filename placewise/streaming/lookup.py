"""A stream of queries against static corpora: an extension, since the batch reference has no streams.

Lookups are stateless; every micro-batch is a batch of queries, so that the whole cascade is open to it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def answer_stream(queries: DataFrame, answer: Callable[[DataFrame], DataFrame], path: str, checkpoint: str) -> StreamingQuery:
    """Answers each micro-batch of ``queries`` (qid, text) and appends to Parquet under its number; a batch that is run again replaces its own answers."""

    def write(batch: DataFrame, number: int) -> None:
        answer(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return queries.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def throttled(events: DataFrame, at: str, key: str, minutes: int, most: int) -> DataFrame:
    """Events by key and window, with whether they are more than allowed; late ones up to a window's length count."""
    counts = events.withWatermark(at, f"{minutes} minutes").groupBy(F.window(at, f"{minutes} minutes"), key).agg(F.count(F.lit(1)).alias("n"))
    return counts.select(key, F.col("window.start").alias("start"), "n", (F.col("n") > most).alias("throttled"))
