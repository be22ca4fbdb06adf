"""Generated series."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.functions import waves
from strandline.functions.timebin import seconds


def series(spark: SparkSession, start: str, end: str, interval: str, points: dict[str, list[dict]], time_column: str = "timestamp") -> DataFrame:
    """Rows from start to end, both included, every interval; each point is the sum of its waveforms over seconds since start."""
    step = seconds(interval)
    span = spark.sql(f"select timestampdiff(SECOND, timestamp_ntz'{start}', timestamp_ntz'{end}')").first()[0]
    rows = spark.range(0, span // step + 1)
    t = (F.col("id") * step).cast("double")
    time = F.timestamp_add("SECOND", F.col("id") * step, F.expr(f"timestamp_ntz'{start}'"))
    return rows.select(time.alias(time_column), *[waves.total(t, parts).alias(name) for name, parts in points.items()])


def generator(spark: SparkSession, rows: int, columns: int, batch: int = 1024) -> DataFrame:
    """Numbered rows with arithmetic columns, in partitions of `batch` rows at least: a source for load tests."""
    base = spark.range(0, rows, 1, max(1, min(rows // batch, 1024)))
    return base.select("id", *[((F.col("id") * (i + 1)) % 1000).alias(f"c{i}") for i in range(columns)])
