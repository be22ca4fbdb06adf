"""Spans of regular expressions in texts by DataFrame functions alone.

Spark's functions return matches but not where they are.  Splitting a text by the
same expression gives what lies between the matches, so running sums over the
lengths of both are the positions, in code points.  Both run only on texts that
a cheaper test lets through.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "struct<kind:int,start:bigint,end:bigint,value:string,part:string>"


def find(text: Column, test: Column, pattern: str, kind: int, group: int = 0) -> Column:
    """Leftmost non-overlapping matches as SPAN, in order; part is the group's text.  Empty where test is not true."""
    rx = F.lit(pattern)
    matches = F.regexp_extract_all(text, rx, F.lit(0))
    parts = F.regexp_extract_all(text, rx, F.lit(group)) if group else matches
    gaps = F.split(text, pattern, -1)
    zipped = F.zip_with(F.zip_with(matches, parts, lambda m, p: F.struct(m.alias("m"), p.alias("p"))), F.slice(gaps, 1, F.size(matches)), lambda x, g: F.struct(x["m"].alias("m"), x["p"].alias("p"), F.length(g).cast("long").alias("gap")))
    nothing = F.struct(F.lit(0).cast("long").alias("at"), F.lit(None).cast(f"array<{SPAN}>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        end = start + F.length(x["m"])
        span = F.struct(F.lit(kind).alias("kind"), start.alias("start"), end.alias("end"), x["m"].alias("value"), x["p"].alias("part"))
        return F.struct(end.alias("at"), F.concat(F.coalesce(acc["out"], F.array().cast(f"array<{SPAN}>")), F.array(span)).alias("out"))

    found = F.aggregate(zipped, nothing, step)["out"]
    return F.when(test, F.coalesce(found, F.array().cast(f"array<{SPAN}>"))).otherwise(F.array().cast(f"array<{SPAN}>"))


def sorted_by(spans: Column, *order: str) -> Column:
    """Spans in the order of the named fields."""
    keyed = F.transform(spans, lambda s: F.struct(*[s[o].alias(f"k{i}") for i, o in enumerate(order)], s.alias("span")))
    return F.transform(F.array_sort(keyed), lambda x: x["span"])


def joined(spans: Column, names: list[str]) -> Column:
    """kind:start:end of each span, comma-joined."""
    kinds = F.array(*[F.lit(n) for n in names])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kinds, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def count(spans: Column, kind: int) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
