"""Current decisions from a growing log of decision events, as a stream. The batch form is in ``operators.view``.

The checkpoint is what a scan's frontier is elsewhere: after a stop, the stream goes on where it was, and an event
that comes twice counts once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

SCHEMA = "session string, relative_path string, decision string, revision long, recorded_at timestamp"


def read_log(spark, folder: str) -> DataFrame:
    """New JSON lines files of the folder, as they come."""
    return spark.readStream.schema(SCHEMA).json(folder)


def once(events: DataFrame, *, late: str = "7 days") -> DataFrame:
    """Each (session, path, revision) once, with state bounded by the watermark."""
    return events.withWatermark("recorded_at", late).dropDuplicatesWithinWatermark(["session", "relative_path", "revision"])


def current(events: DataFrame) -> DataFrame:
    """(session, relative_path, decision, revision) of the last revision, kept up to date."""
    return events.groupBy("session", "relative_path").agg(F.max_by("decision", "revision").alias("decision"), F.max("revision").alias("revision"))


def maintain(events: DataFrame, table: str, checkpoint: str) -> StreamingQuery:
    """Write the changed rows of :func:`current` to folders of ``table`` by batch; a batch that is run again overwrites itself."""

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{table}/batch={number}")

    return current(once(events)).writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(write).trigger(availableNow=True).start()


def latest(spark, table: str) -> DataFrame:
    """The last row of each subject over all batches."""
    return spark.read.parquet(table).groupBy("session", "relative_path").agg(F.max_by("decision", "revision").alias("decision"), F.max("revision").alias("revision"))
