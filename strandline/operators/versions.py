"""Versioned series: which versions of a series are live, and what they hold."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.operators.transforms import column


def live(df: DataFrame, collapsed_through: int | None = None, version: str = "_version") -> DataFrame:
    """Rows of versions that no collapse has replaced, oldest first."""
    return df if collapsed_through is None else df.where(F.col(version) > collapsed_through)


def select(df: DataFrame, which: str | int = "all", version: str = "_version") -> DataFrame:
    """all, latest or one numbered version.  `latest` is the newest version alone."""
    if which == "all":
        return df
    if which == "latest":
        newest = df.agg(F.max(version).alias("_newest"))
        return df.join(F.broadcast(newest), F.col(version) == F.col("_newest")).drop("_newest")  # one row
    return df.where(F.col(version) == int(which))


def bounds(df: DataFrame, time: str, keys: list[str]) -> DataFrame:
    """Rows, first and last time of each file or version."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min(time).alias("first_time"), F.max(time).alias("last_time"))


def prune(manifest: DataFrame, event_time_from=None, version_above: int | None = None) -> DataFrame:
    """Entries of a manifest (version, last_time ...) that a bounded read needs; an entry without a bound is never dropped."""
    out = manifest
    if event_time_from is not None:
        out = out.where(F.col("last_time").isNull() | (F.col("last_time") >= F.lit(event_time_from)))
    if version_above is not None:
        out = out.where(F.col("version") > version_above)
    return out


def latest_per_key(df: DataFrame, keys: list[str], order: list, deleted) -> DataFrame:
    """The newest row of each key, where it isn't a tombstone."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).where((F.col("_rank") == 1) & ~deleted).drop("_rank")


def null_counts(df: DataFrame, by: list[str] = ()) -> DataFrame:
    """Rows, and nulls of every column, in one pass."""
    others = [c for c in df.columns if c not in by]
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n_rows"), *[F.count_if(column(c).isNull()).alias(f"{c}_nulls") for c in others])
