"""Continuous versions: new revisions into the latest state, new documents into segments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from verbaloom.operators.catalogue import latest
from verbaloom.operators.segment import segments
from verbaloom.sources import sinks


def revisions_stream(spark: SparkSession, folder: str, schema) -> DataFrame:
    """Revisions as they arrive as files; their times get a zone, which watermarks need."""
    raw = spark.readStream.schema(schema).parquet(folder)
    return raw.withColumn("revised_at", F.col("revised_at").cast("timestamp"))


def _deltas(spark: SparkSession, root: str) -> list[str]:
    fs, hadoop = sinks._fs(spark, root)
    return sorted(str(f.getPath()) for f in fs.globStatus(hadoop(f"{root}/delta/*/_SUCCESS")) or [])


def state(spark: SparkSession, root: str, keys: list[str], by: list[str]) -> DataFrame:
    """The last row by key of a table kept by ``latest_state``: its newest version and the batches since then."""
    parts = [*([now] if (now := sinks.current(spark, root)) else []), *(d.rsplit("/", 1)[0] for d in _deltas(spark, root))]
    return latest(spark.read.parquet(*parts), keys, by)


def latest_state(stream: DataFrame, root: str, checkpoint: str, keys: list[str], by: list[str], compact: int = 32) -> StreamingQuery:
    """Keep the last row by key: every micro-batch is reduced and written beside the table, under its number.

    After ``compact`` batches table and batches become a new version, so what a batch costs doesn't grow with the table.
    A batch that is run again after a failure writes the same folder, and rows that come twice change nothing, as the last one wins.
    """

    def add(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        latest(batch, keys, by).write.mode("overwrite").parquet(f"{root}/delta/{number:020d}")
        done = _deltas(spark, root)
        if len(done) >= compact:
            sinks.write_version(state(spark, root, keys, by), root)
            fs, hadoop = sinks._fs(spark, root)
            for d in done:
                fs.delete(hadoop(d.rsplit("/", 1)[0]), True)

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def revision_counts(stream: DataFrame, late: str = "2 days", window: str = "1 day") -> DataFrame:
    """An extension: revisions by day and author with a watermark; later ones than ``late`` are left out."""
    timed = stream.filter("revised_at is not null").withWatermark("revised_at", late)
    return timed.groupBy(F.window("revised_at", window).alias("w"), "author").agg(F.count("*").alias("n")).select(F.col("w.start").alias("day"), "author", "n")


def documents_to_segments(stream: DataFrame, path: str, text: str, to: str, checkpoint: str) -> StreamingQuery:
    """Segment documents as they arrive; no state, so files append exactly once by the sink's log."""
    return segments(stream, path, text).writeStream.format("parquet").option("path", to).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
