"""Near-duplicate documents: one-permutation MinHash, banded buckets, star candidates, exact confirmation.

Every text becomes the set of its distinct k-word shingles (64-bit hashes of the
words' lanes, tokens.Hasher).  One sorted pass over a set fills all bins of a
one-permutation sketch, because the leading bits of a hash name its bin and the
first hash of a bin is its minimum; an empty bin borrows from the first full bin in
a fixed random order of all bins of its own (optimal densification, so that bins of
a short text agree or differ on their own too).  Equal sets, by a 128-bit digest of
all their shingles, are one class from here on.

Classes that share a band's bucket are candidates.  A bucket of n classes gives
n - 1 star edges instead of all pairs; its centre is the class that meets most
others in all of its buckets, which of a group of edited copies is one of the least
edited.  Each edge is confirmed on the full sets.  A class that its centre does not
confirm may still be linked to another member, so the members of buckets that hold
more than one component are joined once more, by prefixes of their full sets and the
places of the shared shingle in both (`prefix_pairs`), which misses no link, and
those pairs are confirmed too.  So no candidate pair goes unchecked but those inside
one component, which cannot change it, and those that share too few items to link.

Defined cases: null or wordless texts have an empty set and link with nothing; a
text of fewer than k words is one shingle; repeated rows are members of one
class; a null doc_id keeps its row, gets its class's component and is not kept;
other columns of docs may have any name.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.llm import common, tokens

BANDS, ROWS = 40, 6
BINS = 256
_rng = np.random.default_rng(77)
#: The places of all bins in the order in which bin b looks at them when it is empty.
_PLACE = _rng.permuted(np.tile(np.arange(BINS, dtype=np.uint8), (BINS, 1)), axis=1)
_BAND_SALT = _rng.integers(0, 2**63, BANDS, dtype=np.uint64)
#: The bins of each band; bands overlap in bins only as far as BANDS * ROWS exceeds BINS.
_BAND_BINS = np.arange(BANDS * ROWS).reshape(BANDS, ROWS) % BINS


def shingle_sets(texts: pa.Array, k: int):
    """Sorted distinct shingle hashes of each text, in order."""
    for _, h, offsets in tokens.words(texts):
        grams = h
        if len(h) >= k:
            grams = h[: len(h) - k + 1].copy()
            for j in range(1, k):
                grams = tokens.mix(grams) + h[j : len(h) - k + 1 + j]
            grams = tokens.mix(grams)
        for a, b in zip(offsets[:-1], offsets[1:], strict=True):
            if b - a >= k:
                s = np.sort(grams[a : b - k + 1])
                yield s[np.concatenate(([True], s[1:] != s[:-1]))]
            elif b > a:
                one = h[a : a + 1]
                for x in range(a + 1, b):
                    one = tokens.mix(one) + h[x : x + 1]
                yield tokens.mix(one + np.uint64(b - a))
            else:
                yield h[:0]


def sketch(s: np.ndarray) -> np.ndarray:
    """The densified one-permutation sketch of a sorted set."""
    bins = (s >> np.uint64(64 - 8)).astype(np.int64)
    first = np.flatnonzero(np.concatenate(([True], bins[1:] != bins[:-1])))
    out = np.zeros(BINS, np.uint64)
    where = bins[first]
    out[where] = s[first]
    if 0 < len(where) < BINS:
        empty = np.ones(BINS, bool)
        empty[where] = False
        out[empty] = out[where[_PLACE[empty][:, where].argmin(axis=1)]]
    return out


def band_keys(s: np.ndarray) -> np.ndarray:
    sk = tokens.mix(sketch(s))[_BAND_BINS]
    key = _BAND_SALT.copy()
    for j in range(ROWS):
        key = tokens.mix(key ^ sk[:, j])
    return key.view(np.int64)


def digest(s: np.ndarray) -> bytes:
    """A 128-bit name of a set."""
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else b""


def _signatures(k: int):
    def run(batches):
        common.plain_memory()
        for batch in batches:
            sizes, digests, keys = [], [], []
            for s in shingle_sets(batch.column(1), k):
                sizes.append(len(s))
                digests.append(digest(s))
                keys.append(band_keys(s) if len(s) else np.zeros(0, np.int64))
            offsets = np.concatenate(([0], np.cumsum([len(x) for x in keys]))).astype(np.int32)
            flat = np.concatenate(keys) if keys else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))],
                names=["doc_id", "n_shingles", "set_id", "bands"],
            )
        common.trim()

    return run


def _sets(k: int):
    def run(batches):
        common.plain_memory()
        for batch in batches:
            sets = list(shingle_sets(batch.column(1), k))
            offsets = np.concatenate(([0], np.cumsum([len(x) for x in sets]))).astype(np.int32)
            flat = np.concatenate(sets).view(np.int64) if sets else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([digest(x) for x in sets], pa.binary()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], names=["id", "set_id", "items"])
        common.trim()

    return run


def components(edges: DataFrame, keep: common.Scratch) -> DataFrame:
    """(node, root): the smallest node reachable, for every node on an edge (a, b).

    Alternating large-star and small-star steps, each written to the shared
    folder; links never leave the executors.
    """
    spark = edges.sparkSession
    with common.Scratch(spark) as scratch:
        now = scratch.written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "links")
        before = None
        while True:
            # Large star: neighbours above a node hang on the smallest neighbour or itself.
            both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).union(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
            low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
            # Each step is a plan of its own: a join of two scans at most.
            large = scratch.written(both.join(low, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct(), "large")
            # Small star: a node and its smaller neighbours hang on the smallest of them.
            least = large.groupBy("a").agg(F.min("b").alias("m"))
            small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least).distinct()
            now, state = scratch.measured(small, "links", F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("sum"))
            if state == before:
                break
            before = state
            common.tidy(spark)
        # Every node hangs on its root now, and roots hang on none.
        return keep.written(now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()), "roots")


def confirmed(edges: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Edges (a, b) of class representatives whose full sets have 100 * intersection >= percent * union."""
    with_a = edges.join(sets.select(F.col("id").alias("a"), F.col("items").alias("x")), "a")
    with_b = with_a.join(sets.select(F.col("id").alias("b"), F.col("items").alias("y")), "b")
    both = F.size(F.array_intersect("x", "y"))
    return with_b.where(100 * both >= percent * (F.size("x") + F.size("y") - both)).select("a", "b")


def stars(crowded: DataFrame) -> DataFrame:
    """(key, centre) of each bucket: the member that meets most others, of all members in all of their buckets.

    crowded: key, rep and n, the bucket's size.  Edges of a bucket are as many as its members.
    """
    weight = crowded.groupBy("rep").agg(F.sum("n").alias("weight"))
    return crowded.join(weight, "rep").groupBy("key").agg(F.max_by("rep", F.struct("weight", -F.col("rep"))).alias("centre"))


def postings(open_: DataFrame, sets: DataFrame, percent: int, scratch: common.Scratch) -> DataFrame:
    """item, rep, root, size and place of the items in the prefixes of open classes.

    open_: key, rep, root.  The items of all open sets are in one order, rare ones
    first; place counts from 1 in a set's own items.  Two sets that have at least m
    items in common share one among the first size - m + 1 of each; m follows from
    the least size of a partner in the set's buckets.
    """
    sized = scratch.written(open_.join(sets.select(F.col("id").alias("rep"), "set_id", F.size("items").alias("size")), "rep"), "sized")
    smallest = sized.groupBy("key").agg(F.min("size").alias("smallest"))
    nodes = sized.join(smallest, "key").groupBy("rep", "set_id", "root", "size").agg(F.min("smallest").alias("smallest"))
    partner = F.greatest(F.col("smallest").cast("double"), F.col("size") * percent / 100.0)
    need = F.ceil((F.col("size") + partner) * percent / (100.0 + percent) - 1e-6)
    nodes = scratch.written(nodes.withColumn("prefix", F.col("size") - need + 1), "nodes")
    items = nodes.join(sets.withColumnRenamed("id", "rep"), ["rep", "set_id"]).select("rep", "set_id", "root", "size", "prefix", F.explode("items").alias("item"))
    often = items.groupBy("item").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    # Items that one set alone has come before all others, so they move the others' places.
    mine = Window.partitionBy("rep", "set_id")
    ranked = items.join(often, "item").withColumn("place", F.row_number().over(mine.orderBy("df", "item")) + F.col("size") - F.count(F.lit(1)).over(mine))
    return ranked.where("place <= prefix").select("item", "rep", "root", "size", "place")


def divided(posts: DataFrame) -> DataFrame:
    """Postings of items that several components have, with `own`: whether the row is of the item's largest component."""
    per_root = posts.groupBy("item", "root").agg(F.count(F.lit(1)).alias("n"))
    main = per_root.groupBy("item").agg(F.max_by("root", F.struct("n", "root")).alias("main"), F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("item", "main")
    return posts.join(main, "item").select("item", "rep", "root", "size", "place", (F.col("root") == F.col("main")).alias("own"))


def prefix_pairs(posts: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of classes of different components that may link, out of `divided` postings: none that does is missing.

    Of an item, rows outside its largest component meet all others, never that
    component itself.  The first item that two sets share, at places p and q, leaves
    them at most 1 + min(size - p, size - q) in common.  A pair that links passes at
    that item; what passes nowhere shares too little.  So a large group of edited
    copies does not become all of its pairs: edits that few have come first and use
    up the prefix.
    """
    others = posts.where("not own").select("item", F.col("rep").alias("x"), F.col("root").alias("rx"), F.col("size").alias("sx"), F.col("place").alias("px"))
    fits = f"root <> rx and {100 + percent} * (1 + least(size - place, sx - px)) >= {percent} * (size + sx)"
    return others.join(posts.drop("own"), "item").where(fits).select(F.least("x", "rep").alias("a"), F.greatest("x", "rep").alias("b"))


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs (doc_id long, text string)."""
    spark = docs.sparkSession
    common.settings(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    with common.Scratch(spark) as scratch:
        signed = scratch.written(docs.mapInArrow(_signatures(k), "doc_id long, n_shingles long, set_id binary, bands array<long>"), "sketch")
        classes = signed.where("n_shingles > 0 and doc_id is not null").groupBy("set_id").agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands"))
        members = scratch.written(classes.select("rep", F.explode("bands").alias("key")), "members")
        full = members.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        # Only buckets with two classes or more go on.
        crowded = scratch.written(members.join(full, "key"), "crowded")
        buckets = scratch.written(crowded.select("key", "rep").join(scratch.written(stars(crowded), "centres"), "key"), "buckets")
        common.tidy(spark)
        # Full sets of the classes in them.  A doc_id that rows repeat with other texts has a set for each; one shuffle by id serves this and the joins.
        ids = buckets.select(F.col("rep").alias("id")).distinct()
        some = common.may_hit(common.keyed(docs, F.col("doc_id")), ids, "id").select("row.doc_id", "row.text")
        sets = some.mapInArrow(_sets(k), "id long, set_id binary, items array<long>").repartition("id")
        sets = scratch.written(sets.join(ids, "id", "left_semi").groupBy("id", "set_id").agg(F.first("items").alias("items")), "sets")
        common.tidy(spark)
        ends = (F.least("centre", "rep").alias("a"), F.greatest("centre", "rep").alias("b"))
        edges = scratch.written(buckets.where("rep <> centre").select(*ends).distinct(), "edges")
        links = scratch.written(confirmed(edges, sets, percent), "confirmed")
        common.tidy(spark)
        roots = components(links, scratch)
        common.tidy(spark)
        # Members other than the centre, which has met everyone in its bucket.
        left = buckets.where("rep <> centre").join(roots, F.col("rep") == F.col("node"), "left").select("key", "rep", F.coalesce("root", "rep").alias("root"))
        left = scratch.written(left, "left")
        spread = left.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi")
        open_ = scratch.written(left.join(spread, "key", "left_semi"), "open")
        common.tidy(spark)
        # Written before they are joined: adaptive execution splits an item that many have only in a plain join of two tables.
        posts = scratch.written(divided(scratch.written(postings(open_, sets, percent, scratch), "postings")), "posts")
        more = scratch.written(prefix_pairs(posts, percent).distinct().join(edges, ["a", "b"], "left_anti"), "more")
        fresh, found = scratch.measured(confirmed(more, sets, percent), "fresh", F.count(F.lit(1)).alias("n"))
        common.tidy(spark)
        if found.get("n"):
            roots = components(links.union(fresh), scratch)
        # One row for each class; the sketches' bands are not needed any more.
        by_set = common.written(classes.select("set_id", "rep").join(roots, F.col("rep") == F.col("node"), "left").select("set_id", F.coalesce("root", "rep").alias("component")), "classes")
        rows = common.written(signed.drop("bands"), "rows")
    # The copies of one text may be a third of all rows: their side is dealt by set_id and split by adaptive execution.
    out = rows.join(by_set, "set_id", "left")
    component = F.when(F.col("n_shingles") > 0, F.coalesce("component", "doc_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"))


def drop_near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs that stay, one document of each group, with all their columns; rows with a null doc_id stay."""
    gone = common.written(near_duplicates(docs, k, percent).where("not kept and doc_id is not null").select(F.col("doc_id").alias("_gone")), "near-copies")
    return common.without(docs, "doc_id", gone, "_gone")


def op9(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(common.table(spark, sf_dir, "documents"), k=4, percent=80)
