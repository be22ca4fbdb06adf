"""Joins of time series and of validity intervals.

Equi-joins are left to the planner.  Joins on ranges first put both sides on a
common calendar key where the interval's length is bounded, so they hash instead
of pairing everything with everything.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.operators import transforms
from strandline.operators.transforms import column


def series_join(inputs: list[dict], time_column: str = "timestamp", align: str = "first") -> DataFrame:
    """Aligns series in time by full outer joins, ordered by time.

    An input is {"df", "scope"?, "begin"?, "end"?, "transforms"?}.  Inputs of one
    scope are one device after another: they are stitched by name, equal rows
    once.  Scopes are joined in the order of their names, each on the first one's
    time, so a time that only later scopes have makes a row for each of them.
    align="coalesce" joins on the time so far instead.
    """
    if len(inputs) < 2:
        raise ValueError("a join needs two inputs or more")
    groups: dict[str, list[DataFrame]] = {}
    for i, spec in enumerate(inputs):
        df = transforms.within(spec["df"], time_column, spec.get("begin"), spec.get("end"))
        df = transforms.chain(df, spec.get("transforms", []))
        name = spec.get("scope")
        groups.setdefault(name or f"_none_{i}", []).append(transforms.scope(df, name, time_column) if name else df)
    frames = [transforms.union_by_name(groups[g], distinct=len(groups[g]) > 1) for g in sorted(groups)]
    times = [f"_time_{i}" for i in range(len(frames))]
    frames = [f.withColumnRenamed(time_column, t) for f, t in zip(frames, times, strict=True)]
    out = frames[0]
    for i in range(1, len(frames)):
        so_far = F.col(times[0]) if align == "first" else F.coalesce(*[F.col(t) for t in times[:i]])
        out = out.join(frames[i], so_far == F.col(times[i]), "full")
    values = [column(c) for c in out.columns if c not in times]
    return out.select(F.coalesce(*[F.col(t) for t in times]).alias(time_column), *values).orderBy(time_column)


def series_pivot(sites: dict[str, DataFrame], columns: list[str], time_column: str = "timestamp") -> DataFrame:
    """One row for each distinct time of any site, with `<site>.<column>`; what a site lacks is a null double.

    One shuffle whatever the number of sites.  Of rows that a site has twice at a
    time the greatest values stay.
    """
    parts = []
    for site, df in sites.items():
        own = transforms.pad(df, {c: "double" for c in columns})
        own = own.select(column(time_column).alias(time_column), *[column(c).alias(f"{site}.{c}") for c in columns])
        parts.append(own)
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    names = [f"{site}.{c}" for site in sites for c in columns]
    return stacked.groupBy(time_column).agg(*[F.max(column(n)).alias(n) for n in names]).orderBy(time_column)


def _days(first: Column, last: Column) -> Column:
    return F.explode(F.sequence(F.trunc(first, "month"), F.trunc(last, "month"), F.expr("interval 1 month")))


def valid_on(facts: DataFrame, date: str, ranges: DataFrame, begin: str, end: str, keys: list[str] = (), horizon: str | None = None, how: str = "left", include_end: bool = True) -> DataFrame:
    """facts with the ranges that hold on their date (begin <= date <= end, an open end holds for good).

    Each range is spread over the months it touches, up to the horizon (the facts'
    last date) if open, so the join hashes on month and keys.
    """
    last = F.lit(horizon).cast("date") if horizon else F.lit(facts.agg(F.max(date)).first()[0]).cast("date")
    until = F.least(F.coalesce(F.col(end).cast("date"), last), last)
    spread = ranges.where(F.col(begin) <= last).withColumn("_month", _days(F.col(begin).cast("date"), F.greatest(until, F.col(begin).cast("date"))))
    left = facts.withColumn("_fact_month", F.trunc(F.col(date).cast("date"), "month"))
    on = (left["_fact_month"] == spread["_month"]) & (spread[begin] <= left[date])
    on = on & (spread[end].isNull() | ((left[date] <= spread[end]) if include_end else (left[date] < spread[end])))
    for k in keys:
        on = on & (left[k] == spread[k])
    joined = left.join(spread.drop(*[]), on, how)
    for k in keys:
        joined = joined.drop(spread[k])
    return joined.drop("_month", "_fact_month")


def as_of(facts: DataFrame, date: str, rules: DataFrame, begin: str, end: str, identity: list[str], keys: list[str] = ()) -> DataFrame:
    """facts with the one rule in force on their date: of several the latest to begin; facts without one are kept.

    identity: the columns that tell facts apart.
    """
    matched = valid_on(facts, date, rules, begin, end, keys)
    rank = F.row_number().over(Window.partitionBy(*identity).orderBy(F.col(begin).desc_nulls_last()))
    return matched.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def overlapping(ranges: DataFrame, key: str, identity: str, begin: str, end: str) -> DataFrame:
    """Pairs of a key's intervals that overlap; an open end never ends.  a_id < b_id.

    Two intervals overlap if the later one begins within the other, so beginnings
    are looked up among the months that intervals touch.
    """
    starts = ranges.select(F.col(key).alias("_key"), F.col(identity).alias("_id"), F.col(begin).alias("_from"), F.col(end).alias("_to")).where(F.col("_to").isNull() | (F.col("_from") <= F.col("_to")))
    spans = starts.select("_key", F.col("_id").alias("_other"), F.col("_from").alias("_begin"), F.col("_to").alias("_end"))
    met = valid_on(starts, "_from", spans, "_begin", "_end", ["_key"], how="inner").where("_id <> _other")
    return met.select(F.col("_key").alias(key), F.least("_id", "_other").alias("a_id"), F.greatest("_id", "_other").alias("b_id")).distinct()
