"""Events from a stream into a store: each micro-batch is one commit, made once.

The store's manifest remembers the last batch of each stream, so a batch that is
replayed after a failure adds nothing. A batch with a wrong event stops the
stream unless ``rejects`` names a folder for such lines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.store import EventStore, parsed


def into(store: EventStore, lines: DataFrame, name: str, checkpoint: str, rejects: str | None = None, once: bool = True) -> StreamingQuery:
    """Start writing a stream with a column ``value`` into the store; with once, what is there now and no more."""

    def commit(batch: DataFrame, number: int) -> None:
        batch = batch.select("value")
        if rejects:
            judged = parsed(batch.select("value", F.col("value").alias("line_")), store.schema)
            judged.filter("error_ IS NOT NULL").select(F.col("line_").alias("value"), F.col("error_").alias("error")).write.mode("overwrite").json(f"{rejects}/{name}-{number}")
            batch = judged.filter("error_ IS NULL").select(F.col("line_").alias("value"))
        store.ingest(batch, name, number)

    writer = lines.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def text_stream(spark: SparkSession, folder: str, files_per_batch: int = 1000) -> DataFrame:
    """Lines of the text files in a folder, oldest file first."""
    return spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(folder)


def windowed(events: DataFrame, time: str, width: str, late: str, *keys: str) -> DataFrame:
    """Rows by time window and keys of a stream, final once the watermark has passed."""
    return events.withWatermark(time, late).groupBy(F.window(time, width), *keys).agg(F.count(F.lit(1)).alias("count"))
