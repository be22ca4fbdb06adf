"""Temporal reduction: downsampling to epoch-aligned buckets, in one pass or through partial aggregates.

Partials (sum, count, min, max, rows) of the finest resolution merge into every
coarser one, so a directory of resolutions reads the input once.
"""

from __future__ import annotations

from functools import reduce as fold

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.functions.timebin import at, seconds
from strandline.operators import transforms
from strandline.operators.transforms import column

AGGREGATES = ("avg", "min", "max", "sum", "count")
ROWS = "timestamp.count"
_NEEDS = {"avg": ("sum", "count"), "sum": ("sum",), "count": ("count",), "min": ("min",), "max": ("max",)}


def expand(df: DataFrame, aggregations: list[dict], time_column: str) -> list[tuple[str, str]]:
    """(aggregate, column) of a configuration, in its order; `columns` missing means all, `count` of * means rows.

    Patterns expand in their order, each in the order of the schema, a column once.
    """
    names = [c for c in df.columns if c != time_column]
    kinds = dict(df.dtypes)
    out: list[tuple[str, str]] = []
    for spec in aggregations:
        kind = spec["type"]
        if kind not in AGGREGATES:
            raise ValueError(f"unknown aggregate {kind!r}")
        if kind == "count" and spec.get("columns") == ["*"]:
            out.append(("count", "*"))
            continue
        wanted = names if spec.get("columns") is None else [n for p in spec["columns"] for n in transforms.column_glob(p, names)]
        for name in dict.fromkeys(wanted):
            if kind in ("avg", "sum") and not kinds[name].startswith(("double", "float", "int", "bigint", "smallint", "tinyint", "decimal")):
                raise ValueError(f"{kind} of {name}, which isn't numeric")
            out.append((kind, name))
    return out


def _name(kind: str, name: str) -> str:
    return ROWS if name == "*" else f"{name}.{kind}"


def bucketed(df: DataFrame, time_column: str, resolution: str) -> DataFrame:
    """df with _bucket, the start of each row's bucket; rows without a time are left out."""
    return df.where(column(time_column).isNotNull()).withColumn("_bucket", F.window(column(time_column), f"{seconds(resolution)} seconds")["start"])


def single_pass(df: DataFrame, time_column: str, resolution: str, aggregations: list[dict], ordered: bool = True) -> DataFrame:
    """One row for each non-empty bucket: its start and the aggregates, ordered by time unless a join or union goes on from here."""
    wanted = expand(df, aggregations, time_column)
    exprs = [F.count(F.lit(1)).alias(ROWS) if n == "*" else getattr(F, k)(column(n)).alias(_name(k, n)) for k, n in wanted]
    out = bucketed(df, time_column, resolution).groupBy("_bucket").agg(*exprs)
    out = out.withColumnRenamed("_bucket", time_column)
    return out.orderBy(time_column) if ordered else out


def partial_columns(wanted: list[tuple[str, str]]) -> list[tuple[str, str]]:
    """The partials that a configuration needs, each once."""
    needs = [("rows", "*") if n == "*" else (p, n) for k, n in wanted for p in (("rows",) if n == "*" else _NEEDS[k])]
    return list(dict.fromkeys(needs))


def _partial_name(kind: str, name: str) -> str:
    return f"{name}#{kind}"


def partials(df: DataFrame, time_column: str, resolution: str, wanted: list[tuple[str, str]]) -> DataFrame:
    """Partial aggregates of df's buckets; a column that df lacks has null sums and no counts."""
    exprs = []
    for kind, name in partial_columns(wanted):
        if kind == "rows":
            e = F.count(F.lit(1))
        elif name not in df.columns:
            e = F.lit(0).cast("long") if kind == "count" else F.lit(None).cast("double")
            e = F.max(e)
        else:
            e = getattr(F, kind)(column(name))
        exprs.append(e.alias(_partial_name(kind, name)))
    return bucketed(df, time_column, resolution).groupBy("_bucket").agg(*exprs)


def merge(parts: DataFrame, resolution: str, wanted: list[tuple[str, str]], low: int | None = None, high: int | None = None) -> DataFrame:
    """Partials of a finer resolution folded to a coarser one; low and high (epoch seconds, high excluded) cut before grouping."""
    out = parts
    if low is not None:
        out = out.where(F.col("_bucket") >= at(low))
    if high is not None:
        out = out.where(F.col("_bucket") < at(high))
    how = {"sum": F.sum, "count": F.sum, "rows": F.sum, "min": F.min, "max": F.max}
    exprs = [how[k](column(_partial_name(k, n))).alias(_partial_name(k, n)) for k, n in partial_columns(wanted)]
    return out.withColumn("_b", F.window("_bucket", f"{seconds(resolution)} seconds")["start"]).groupBy("_b").agg(*exprs).withColumnRenamed("_b", "_bucket")


def reconstruct(parts: DataFrame, wanted: list[tuple[str, str]], time_column: str, ordered: bool = True) -> DataFrame:
    """The configured outputs from partials."""

    def value(kind: str, name: str) -> Column:
        part = lambda p: column(_partial_name(p, name))
        if name == "*":
            return part("rows")
        if kind == "avg":
            return part("sum").cast("double") / F.nullif(part("count"), F.lit(0).cast("long"))
        return part(kind)

    out = parts.select(F.col("_bucket").alias(time_column), *[value(k, n).alias(_name(k, n)) for k, n in wanted])
    return out.orderBy(time_column) if ordered else out


def check_nesting(resolutions: list[str]) -> list[str]:
    """Resolutions from fine to coarse, each a whole multiple of the one before."""
    ordered = sorted(dict.fromkeys(resolutions), key=seconds)
    for fine, coarse in zip(ordered, ordered[1:], strict=False):
        if seconds(coarse) % seconds(fine):
            raise ValueError(f"{coarse} isn't a multiple of {fine}")
    if not ordered or not seconds(ordered[0]):
        raise ValueError("resolutions must be a second or more")
    return ordered


def resolutions(df: DataFrame, time_column: str, names: list[str], aggregations: list[dict], ordered: bool = True) -> dict[str, DataFrame]:
    """One reduced table for each resolution, all from the finest one's partials."""
    ordered = check_nesting(names)
    wanted = expand(df, aggregations, time_column)
    parts = partials(df, time_column, ordered[0], wanted)
    levels = {ordered[0]: parts}
    for name in ordered[1:]:
        parts = merge(parts, name, wanted)
        levels[name] = parts
    return {name: reconstruct(levels[name], wanted, time_column, ordered) for name in names}


def flagship(spark, sf_dir: str) -> DataFrame:
    """Events at an hour, six hours and a day: rows, average, minimum and maximum of value."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("ts", "value")
    spec = [{"type": "count", "columns": ["*"]}, *({"type": k, "columns": ["value"]} for k in ("avg", "min", "max"))]
    frames = []
    for name, df in resolutions(events, "ts", ["1h", "6h", "1d"], spec, ordered=False).items():
        frames.append(df.select(F.lit(name).alias("resolution"), F.col("ts"), column(ROWS).alias("n"), *[F.round(column(f"value.{k}"), 4).alias(f"{k}_value") for k in ("avg", "min", "max")]))
    return fold(DataFrame.union, frames)
