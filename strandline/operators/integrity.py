"""Checksums that find out whether two copies of a table are equal, and where they differ."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LIMBS = 8
_LIMB = 1 << 32


def row_digest(columns: list[str]) -> Column:
    """SHA-256 of a row: each value as text behind its length, so no two rows run together."""
    parts = [F.when(F.col(c).isNull(), F.lit("-")).otherwise(F.concat(F.length(F.col(c).cast("string")).cast("string"), F.lit(":"), F.col(c).cast("string"))) for c in columns]
    return F.sha2(F.concat_ws("|", *parts), 256)


def set_digest(digests: DataFrame, column: str = "digest", by: list[str] = ()) -> DataFrame:
    """The sum of 256-bit digests modulo 2**256, as eight 32-bit sums that still have their carries: order plays no part.

    Partial sums meet as integers, so any number of rows is one aggregation.
    """
    limbs = [F.sum(F.conv(F.substring(column, 1 + 8 * i, 8), 16, 10).cast("long")).alias(f"limb{i}") for i in range(LIMBS)]
    return digests.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *limbs)


def carried(limbs: list[int]) -> str:
    """Limb sums (the first is the most significant) to 64 hexadecimal digits."""
    total = 0
    for x in limbs:
        total = total * _LIMB + x
    return f"{total % (1 << 256):064x}"


def fold_digests(df: DataFrame, by: list[str], column: str = "digest") -> DataFrame:
    """A digest for each group over its members' digests in order.  For groups of a bounded size, such as directories."""
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.sha2(F.array_join(F.sort_array(F.collect_list(column)), ""), 256).alias("digest"))


def tree(df: DataFrame, levels: list[str], column: str = "digest") -> DataFrame:
    """Digests of every directory of a tree, from the deepest level to the root: levels, n (rows below it) and digest.

    Two replicas are equal if their roots are; where they aren't, the first levels
    that differ lead to the difference.
    """
    out, below = None, df.select(*levels, column).withColumn("n", F.lit(1).cast("long"))
    for depth in range(len(levels), -1, -1):
        by = levels[:depth]
        below = below.groupBy(*by).agg(F.sum("n").alias("n"), F.sha2(F.array_join(F.sort_array(F.collect_list(column)), ""), 256).alias(column))
        whole = below.select(*by, *[F.lit(None).cast(df.schema[c].dataType).alias(c) for c in levels[depth:]], "n", column)
        out = whole if out is None else out.unionByName(whole)
    return out


def wrong_rows(df: DataFrame, digest: Column, stored: str) -> DataFrame:
    """The rows whose content doesn't have the digest that is stored with it, all of them: one doesn't stop the search."""
    return df.where(~digest.eqNullSafe(F.col(stored)))


def diff(old: DataFrame, new: DataFrame, key: str, kind: str = "kind", digest: str = "digest") -> DataFrame:
    """key, change (added, removed, type_changed, modified) of everything that differs, by key."""
    a = old.select(F.col(key).alias("_k"), F.col(kind).alias("_kind"), F.col(digest).alias("_digest"))
    change = (
        F.when(F.col("_k").isNull(), "added").when(F.col(key).isNull(), "removed").when(~F.col(kind).eqNullSafe(F.col("_kind")), "type_changed")
        .when(~F.col(digest).eqNullSafe(F.col("_digest")), "modified")
    )
    return a.join(new.select(key, kind, digest), F.col("_k") == F.col(key), "full").select(F.coalesce(F.col(key), F.col("_k")).alias(key), change.alias("change")).where("change is not null").orderBy(key)


def missing(local: DataFrame, remote: DataFrame, key: str) -> DataFrame:
    return local.join(remote.select(key), key, "left_anti")
