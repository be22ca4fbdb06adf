"""Overlaps in time between the files and versions of a series."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Largest gap at which a change of origin begins an overlap.
GAP_MS = 60_000


def timeline(parts: dict[str, DataFrame], time: str) -> DataFrame:
    """All points with their origin, by time."""
    frames = [df.select(F.lit(name).alias("origin"), F.col(time).alias("time")) for name, df in parts.items()]
    return reduce(DataFrame.union, frames).orderBy("time", "origin")


def runs(points: DataFrame, keys: list[str] = (), order: tuple[str, ...] = ("time", "origin")) -> DataFrame:
    """Maximal runs of points of one origin: origin, first and last time, points.  keys part independent series."""
    w = Window.partitionBy(*keys).orderBy(*order)
    changed = points.withColumn("_new", F.when(F.lag("origin").over(w) == F.col("origin"), 0).otherwise(1))
    numbered = changed.withColumn("run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*keys, "run", "origin").agg(F.min("time").alias("first_time"), F.max("time").alias("last_time"), F.count(F.lit(1)).alias("n"))


def scan(rows: list[tuple[int, str]], gap_ms: int = GAP_MS) -> list[tuple[str, int, int, int]]:
    """Segments (kind, first, last, points) of points (milliseconds, origin) sorted by time.

    Where the origin changes within the gap, the points up to one gap after the
    change are an overlap, and the run before it ends.  The scan then goes on
    with the next point, so points of an overlap can be in a later segment too; a
    run of a single point before an overlap is no segment.
    """
    out, begin = [], 0
    for i in range(1, len(rows) + 1):
        if i < len(rows) and rows[i][1] == rows[i - 1][1]:
            continue
        overlap = i < len(rows) and rows[i][0] - rows[i - 1][0] <= gap_ms
        if not overlap or i - begin > 1:
            out.append((rows[begin][1], rows[begin][0], rows[i - 1][0], i - begin))
        if overlap:
            last = i
            while last + 1 < len(rows) and rows[last + 1][0] - rows[i][0] <= gap_ms:
                last += 1
            out.append(("overlap", rows[i - 1][0], rows[last][0], last - i + 2))
        begin = i
    return out


def segments(points: DataFrame, key: str, millis: str, gap_ms: int = GAP_MS) -> DataFrame:
    """`scan` of each key's points (key, millis, origin): sequential within a key by its definition."""

    def one(frame):
        import pandas as pd

        frame = frame.sort_values([millis, "origin"])
        found = scan(list(zip(frame[millis].tolist(), frame["origin"].tolist(), strict=True)), gap_ms)
        return pd.DataFrame([(frame[key].iloc[0], *s) for s in found], columns=[key, "kind", "first_ms", "last_ms", "n"])

    kind = dict(points.dtypes)[key]
    return points.groupBy(key).applyInPandas(one, f"{key} {kind}, kind string, first_ms long, last_ms long, n long")
