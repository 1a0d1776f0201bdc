"""Incremental processing: new rows only, and upserts, on Structured Streaming (an extension beyond batch use)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from quire.operators.relational import upsert, without_existing
from quire.session import new_path


def read_new_files(spark: SparkSession, path: str, schema, per_batch: int = 16) -> DataFrame:
    """A stream of the files of a folder, at most per_batch of them at a time."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", str(per_batch)).parquet(path)


def windowed_counts(events: DataFrame, ts: str, by: str, length: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """(window_start, by, n): counts per tumbling window; events later than `late` are left out on a stream."""
    w = events.withWatermark(ts, late) if events.isStreaming else events
    return w.groupBy(F.window(ts, length).alias("w"), by).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("window_start"), by, "n")


def start_upserts(updates: DataFrame, target: str, keys: list[str], version: str, checkpoint: str) -> StreamingQuery:
    """Apply every micro-batch of updates to the parquet table at target; only new or later rows change it.

    Each batch writes a new generation folder and then names it in _current, so that a failed batch leaves the last
    one in place and a repeated batch gives the same result.
    """

    def apply(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        held = current(spark, target)
        new = batch.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in batch.columns if c not in keys]), version).alias("r")).select(*keys, "r.*")
        out = new if held is None else upsert(held, new.select(*held.columns), keys, version)
        out.write.mode("overwrite").parquet(f"{target}/generation={number}")
        spark.createDataFrame([(number,)], "n bigint").coalesce(1).write.mode("overwrite").json(f"{target}/_current")

    return updates.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, target: str) -> DataFrame | None:
    """The last finished generation of a table written by start_upserts(); None before the first."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{target}/_current")
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return None
    n = spark.read.json(f"{target}/_current").first()["n"]
    return spark.read.parquet(f"{target}/generation={n}")


def drain(stream: DataFrame, name: str) -> DataFrame:
    """Run a stream over what is there now and give its result as a table in the shared folder."""
    spark = stream.sparkSession
    out, state = new_path(spark, name), new_path(spark, name + "-state")
    mode = "append"
    q = stream.writeStream.outputMode(mode).format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def new_rows(stream: DataFrame, existing: DataFrame, key: str) -> DataFrame:
    """The stream's rows whose key the table lacks."""
    return without_existing(stream, existing, key) if not stream.isStreaming else stream.join(existing.select(key).distinct().withColumn("_in", F.lit(1)), key, "left").filter("_in IS NULL").drop("_in")


__all__ = ["current", "drain", "new_rows", "read_new_files", "start_upserts", "windowed_counts"]
