"""Export to calendar partitions, reuse of unchanged ones, and plans for viewers."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.operators import transforms
from strandline.operators.transforms import column
from strandline.plans.scratch import Store

PARTS = ("year", "quarter", "month", "day", "hour", "minute")
#: Lengths in seconds of a minute, hour, day, month, quarter and year as a viewer counts them.
LADDER = (60, 3600, 86400, 2592000, 7776000, 31536000)
TARGET_POINTS = 1500


def with_parts(df: DataFrame, time_column: str, parts: list[str]) -> DataFrame:
    return df.withColumns({p: F.date_part(F.lit(p), column(time_column)).cast("int") for p in parts})


class CorruptExport(RuntimeError):
    """Files of an export that is to be reused aren't the ones that were written."""


def export(df: DataFrame, folder: str, time_column: str, parts: list[str], begin=None, end=None) -> list[str]:
    """Writes df in calendar partitions, sorted by time; the partitions written.  Rows without a time are an error.

    One pass counts, one writes.  Rows are dealt by partition and split by size, so
    a small partition is one file and no task holds a large one.
    """
    out = with_parts(transforms.within(df, time_column, begin, end), time_column, parts)
    found = out.groupBy(*parts).agg(F.count_if(column(time_column).isNull()).alias("nulls")).collect()  # one row a partition
    if any(r.nulls for r in found):
        raise ValueError(f"{time_column} has nulls")
    if not found:
        raise ValueError("nothing to export")
    (
        out.hint("rebalance", *[F.col(p) for p in parts]).sortWithinPartitions(*parts, time_column)
        .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*parts).parquet(folder)
    )
    return ["/".join(f"{p}={r[p]}" for p in parts) for r in sorted(found, key=lambda r: [r[p] for p in parts])]


def partition_times(path: str) -> tuple[int, int]:
    """First second and the one after the last of a partition path such as year=2024/month=2."""
    found = dict(p.split("=", 1) for p in path.split("/") if "=" in p)
    value = {p: int(found[p]) for p in PARTS if p in found}
    if value.get("year", 0) <= 0:
        raise ValueError(f"no year in {path!r}")
    month = value.get("month", 3 * value["quarter"] - 2 if "quarter" in value else 1)
    start = dt.datetime(value["year"], month, value.get("day", 1), value.get("hour", 0), value.get("minute", 0), tzinfo=dt.UTC)
    last = [p for p in PARTS if p in value][-1]
    if last in ("year", "quarter", "month"):
        n = {"year": 12, "quarter": 3, "month": 1}[last]
        months = start.year * 12 + start.month - 1 + n
        end = start.replace(year=months // 12, month=months % 12 + 1)
    else:
        end = start + dt.timedelta(**{f"{last}s": 1})
    return int(start.timestamp()), int(end.timestamp())


def file_width(resolution_seconds: int, target: int = TARGET_POINTS) -> int:
    """Seconds a partition should hold so that two files at most cover a viewer's widest view."""
    half = max(1, resolution_seconds * target // 2)
    return next((w for w in LADDER if w >= half), LADDER[-1])


def field_parts(name: str) -> dict[str, str | None]:
    """instrument, name, unit and aggregate of a column name by the number of its dots."""
    if name == "timestamp.count":
        return {"instrument": None, "name": "timestamp", "unit": None, "agg": "count"}
    p = name.split(".")
    if len(p) == 1:
        return {"instrument": None, "name": p[0], "unit": None, "agg": None}
    if len(p) == 2:
        return {"instrument": None, "name": p[0], "unit": None, "agg": p[1]}
    return {"instrument": ".".join(p[:-3]) or None, "name": p[-3], "unit": p[-2], "agg": p[-1]}


def stale(manifest: dict[str, str], digests: dict[str, str], changed_since: int | None, sound=lambda partition: True) -> tuple[list[str], list[str], list[str]]:
    """(partitions to keep, to write, to remove) given the last export's digests and the present ones.

    sound: whether a partition's files are the ones that were written.  If nothing
    has changed at all, all are to be reused and unsound files are an error; else
    unsound partitions are written again.
    """
    keep = [p for p, d in digests.items() if manifest.get(p) == d and (changed_since is None or partition_times(p)[1] <= changed_since)]
    lost = [p for p in keep if not sound(p)]
    if lost and manifest == digests and len(keep) == len(digests):
        raise CorruptExport(f"files of {', '.join(lost)} are missing or were changed")
    keep = [p for p in keep if p not in lost]
    return keep, [p for p in digests if p not in keep], [p for p in manifest if p not in digests]


def partition_digests(df: DataFrame, time_column: str, parts: list[str]) -> dict[str, str]:
    """An order-independent digest of each partition's rows."""
    out = with_parts(df, time_column, parts)
    rows = out.groupBy(*parts).agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)")).alias("s")).collect()
    return {"/".join(f"{p}={r[p]}" for p in parts): f"{r.n}:{r.s}" for r in rows}


def export_changed(df: DataFrame, folder: str, time_column: str, parts: list[str], changed_since: int | None = None) -> tuple[list[str], list[str], list[str]]:
    """As `export`, but partitions whose rows and files are as they were stay, and those without rows go; (kept, written, removed)."""
    spark: SparkSession = df.sparkSession
    store = Store(spark, folder)
    parent, base = folder.rstrip("/").rsplit("/", 1)
    beside, name = Store(spark, parent), f"{base}.export.json"  # beside the folder, which readers list
    last = beside.load(name) or {"rows": {}, "files": {}}
    digests = partition_digests(df, time_column, parts)
    keep, write, remove = stale(last["rows"], digests, changed_since, lambda p: store.digest(p) == last["files"].get(p))
    for p in remove:
        store.delete(p)
    if write:
        values = [tuple(int(x.split("=")[1]) for x in p.split("/")) for p in write]
        chosen = F.broadcast(spark.createDataFrame(values, ", ".join(f"{p} int" for p in parts)))  # one row a partition
        rows = with_parts(df, time_column, parts).join(chosen, parts, "left_semi")
        export(rows.drop(*parts), folder, time_column, parts)
    beside.save(name, {"rows": digests, "files": {p: store.digest(p) for p in digests}})
    return keep, write, remove
