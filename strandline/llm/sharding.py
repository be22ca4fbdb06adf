"""Sharding by a permutation-filled lookup table.

Every shard prefers the slots of a table of prime size in an order of its own:
it begins at an offset and goes on by a skip, both from a hash of its name, which
reaches all slots because the size is prime.  Shards take turns in claiming their
next free slot until the table is full, so shares differ by one slot at most.  A
row's place is the shard of the slot of its key's hash: one look into an array
of TABLE_SIZE entries, whatever the number of rows.  When a shard is added or
lost, few other slots change hands.

The table is broadcast: its size is fixed, and placement is a hash join on the slot,
so rows are never shuffled.

Defined cases: a null key has the slot of the empty text; repeated rows go to one
shard; an empty table gives no rows; repeated shard names count once.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.llm import common

#: Slots of the lookup table: a prime, over a hundred times the number of shards.
TABLE_SIZE = 65_537
SHARDS = 64


def _numbers(name: str) -> tuple[int, int]:
    h = hashlib.md5(name.encode()).digest()
    return int.from_bytes(h[:8], "big"), int.from_bytes(h[8:], "big")


def fill(names: list[str], size: int = TABLE_SIZE) -> list[int]:
    """The shard (place in the sorted distinct names) that each slot belongs to."""
    names = sorted(set(names))
    if not names or len(names) > size:
        raise ValueError("a table needs at least one shard, and as many slots as shards")
    spot, skip = zip(*((a % size, b % (size - 1) + 1) for a, b in map(_numbers, names)), strict=True)
    spot, table, left = list(spot), [-1] * size, size
    while True:
        for i in range(len(names)):
            while table[spot[i]] >= 0:
                spot[i] = (spot[i] + skip[i]) % size
            table[spot[i]] = i
            left -= 1
            if not left:
                return table


def slot(key: Column, size: int = TABLE_SIZE) -> Column:
    """Slot of a key: the first 15 hexadecimal digits of the MD5 of its text, modulo the table's size."""
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary"))
    return F.pmod(F.conv(F.substring(digest, 1, 15), 16, 10).cast("long"), F.lit(size)).cast("int")


def place(df: DataFrame, key: str, names: list[str], size: int = TABLE_SIZE) -> DataFrame:
    """df with its rows' slot and shard (int) appended, in place of columns of these names; all others keep their values."""
    table = fill(names, size)
    # The table has `size` rows of two integers by construction, so it is broadcast.
    lookup = df.sparkSession.createDataFrame(list(enumerate(table)), "spot int, name int")
    packed = df.select(common.whole(df), slot(common.column(key), size).alias("at"))
    out = packed.join(F.broadcast(lookup), F.col("at") == F.col("spot"))
    kept = df.select(*[common.column(c) for c in df.columns if c.lower() not in ("slot", "shard")])
    return common.unpacked(out, kept, F.col("at").alias("slot"), F.col("name").alias("shard"))


def write_shards(df: DataFrame, key: str, names: list[str], path: str, rows_per_file: int = 1_000_000) -> None:
    """Writes df as one folder a shard; files are cut by rows, so no task holds a whole shard."""
    place(df, key, names).write.option("maxRecordsPerFile", rows_per_file).partitionBy("shard").parquet(path)


def shard_names(n: int = SHARDS) -> list[str]:
    return [f"shard-{i:04d}" for i in range(n)]


def op4(spark, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id")
    return place(docs, "doc_id", shard_names())
