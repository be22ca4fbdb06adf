"""Windowed aggregates over streams, and what a stream leaves behind."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from strandline.plans import scratch


def run(df: DataFrame, mode: str, keys: list[str] = (), checkpoint: str | None = None) -> DataFrame:
    """Runs a streaming query over all that is there and returns its rows.

    append: finished rows; complete: all rows of the last batch; update: the
    newest row of each key.  Batches are folders, overwritten if run again.
    """
    spark: SparkSession = df.sparkSession
    folder = checkpoint or scratch.folder(spark, "stream")

    def keep(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out/batch={batch_id}")

    df.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/state").foreachBatch(keep).trigger(availableNow=True).start().awaitTermination()
    out = spark.read.schema(StructType([*df.schema.fields, StructField("batch", IntegerType())])).parquet(f"{folder}/out")
    if mode == "append":
        return out.drop("batch")
    if mode == "complete":
        last = out.agg(F.max("batch").alias("_last"))
        return out.join(F.broadcast(last), F.col("batch") == F.col("_last")).drop("batch", "_last")  # one row
    values = [c for c in df.columns if c not in keys]
    return out.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("_v")).select(*keys, *[F.col(f"_v.{c}").alias(c) for c in values])


def source(spark: SparkSession, path: str, files_per_batch: int = 1) -> DataFrame:
    """Parquet files as a stream, in the order they came."""
    return spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def tumbling(events: DataFrame, time: str, duration: str, aggregates: list, keys: list[str] = (), lateness: str | None = None, slide: str | None = None) -> DataFrame:
    """Aggregates by window start and keys; with lateness a watermark, behind which windows are finished."""
    kept = events.withColumn("_t", F.col(time).cast("timestamp"))
    if lateness:
        kept = kept.withWatermark("_t", lateness)
    window = F.window("_t", duration, slide) if slide else F.window("_t", duration)
    out = kept.groupBy(window.alias("_w"), *keys).agg(*aggregates)
    rest = [c for c in out.columns if c != "_w"]
    return out.select(F.col("_w.start").cast("timestamp_ntz").alias(time), *rest)


def sessions(events: DataFrame, time: str, gap: str, keys: list[str], aggregates: list, lateness: str = "0 seconds") -> DataFrame:
    """Runs of a key's events with no longer gap than this between them."""
    kept = events.withColumn("_t", F.col(time).cast("timestamp"))
    if events.isStreaming:
        kept = kept.withWatermark("_t", lateness)
    out = kept.groupBy(*keys, F.session_window("_t", gap).alias("_w")).agg(*aggregates)
    rest = [c for c in out.columns if c != "_w"]
    return out.select(F.col("_w.start").cast("timestamp_ntz").alias("first_time"), *rest)
