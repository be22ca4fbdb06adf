"""Table-to-table projections: renaming, scoping, padding and bounds.

All of them are projections or filters, so Catalyst pushes predicates and pruned
columns through them down to the scan.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Target types of a cast in a rename rule.
CASTS = {"timestamp": "timestamp", "utf8": "string", "string": "string", "int64": "bigint", "int32": "int", "float64": "double", "float32": "float", "boolean": "boolean"}


def column(name: str):
    return F.col("`" + name.replace("`", "``") + "`")


def rename(df: DataFrame, rules: list[dict]) -> DataFrame:
    """Renames columns; of the rules that match a column the first wins.

    A rule is {"type": "direct", "from", "to", "cast"?} or {"type": "pattern",
    "pattern", "replacement"}, a regular expression of which the first match in
    the name is replaced ($1 refers to a group).  An unknown cast is left out.
    """
    out = []
    for name in df.columns:
        source, target = column(name), name
        for rule in rules:
            if rule["type"] == "direct" and rule["from"] == name:
                target = rule["to"]
                if kind := CASTS.get(rule.get("cast") or ""):
                    source = source.cast(kind)
                break
            if rule["type"] == "pattern" and re.search(rule["pattern"], name):
                target = re.sub(rule["pattern"], re.sub(r"\$(\d+|\{\w+\})", lambda m: "\\g<" + m[1].strip("{}") + ">", rule["replacement"]), name, count=1)
                break
        out.append(source.alias(target))
    return df.select(*out)


def scope(df: DataFrame, prefix: str, time_column: str = "timestamp") -> DataFrame:
    """Puts `prefix.` before every column but the time column."""
    return df.select(*[column(c).alias(c if c == time_column else f"{prefix}.{c}") for c in df.columns])


def pad(df: DataFrame, wanted: dict[str, str]) -> DataFrame:
    """Adds the wanted columns (name to type) that df lacks, as nulls."""
    missing = {c: F.lit(None).cast(t) for c, t in wanted.items() if c not in df.columns}
    return df.withColumns(missing) if missing else df


def within(df: DataFrame, time_column: str, begin=None, end=None) -> DataFrame:
    """Rows whose time lies between begin and end, both included; a missing bound bounds nothing."""
    kind = dict(df.dtypes)[time_column]
    out = df
    if begin is not None:
        out = out.where(column(time_column) >= F.lit(begin).cast(kind))
    if end is not None:
        out = out.where(column(time_column) <= F.lit(end).cast(kind))
    return out


def chain(df: DataFrame, steps: list[Callable[[DataFrame], DataFrame]]) -> DataFrame:
    return reduce(DataFrame.transform, steps, df)


def union_by_name(frames: list[DataFrame], distinct: bool = False) -> DataFrame:
    """All frames' rows under their columns' names; a column that a frame lacks is null there."""
    if not frames:
        raise ValueError("nothing matched")
    out = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    return out.distinct() if distinct else out


def column_glob(pattern: str, names: list[str]) -> list[str]:
    """Names that a pattern with one `*` matches; without one, or with more, names equal to it."""
    if pattern.count("*") != 1:
        return [n for n in names if n == pattern]
    head, tail = pattern.split("*")
    return [n for n in names if len(n) >= len(head) + len(tail) and n.startswith(head) and n.endswith(tail)]


def time_column_of(df: DataFrame) -> str:
    """The time column by its usual names, in their order."""
    kinds = dict(df.dtypes)
    for name in ("timestamp", "Timestamp", "event_time", "time", "ts", "datetime"):
        if kinds.get(name, "").startswith(("timestamp", "bigint")):
            return name
    raise ValueError("no time column")
