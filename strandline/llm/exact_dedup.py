"""Exact deduplication by a stateful stream.

A narrow table of (digest, doc_id, locator) is streamed through a keyed aggregation
whose state lies in RocksDB on disk and in the shared checkpoint folder: no
watermark, so no key ever expires.  The state of a digest is its smallest doc_id,
the locator of that row's content and the number of rows.  A locator is the file
that a row lies in and its place there; rows that don't come from Parquet files as
they are get theirs from a copy in the shared folder.  Within a batch, rows are
aggregated before the shuffle, so a text that is a third of the corpus reaches its
state as a row per task.  Each batch's updates are appended to a log; the newest
entry of a digest is its state.

A digest only names candidates.  On every hit the full normalised bytes, fetched
by locator, are held against those of the row that stays, and rows that differ
from it under one digest are told apart by their text.  A bitmap of fixed size
keeps texts without a hit out of that join.

Texts are equal when they are identical after each run of space and \\x09-\\x0D
became one space.  Defined cases: a null text counts as empty, and empty texts
are copies of each other; rows that repeat a doc_id and text are members of one
group, each with its row in the result and `kept` true for each of them; a null
doc_id never stays unless all of its group are null; other columns may have any name.
"""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from strandline.llm import common

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: The state store is on disk: all its partitions on an executor share one bounded cache, and none reserves disk ahead.
SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": ROCKSDB,
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "128",
}
#: Rows that a partition of the state is meant for: a key and its state are about 100 bytes on disk.
STATE_ROWS = 1_000_000


@contextmanager
def _settings(spark: SparkSession, partitions: int):
    settings = SETTINGS | {"spark.sql.shuffle.partitions": str(partitions)}
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


LOCATOR = "struct<file:string,at:bigint>"


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), "[\\x20\\x09-\\x0D]+", " ")


def _digest(text: Column) -> Column:
    return F.unhex(F.sha2(normalised(text), 256))


def _is_scan(df: DataFrame) -> bool:
    """Whether df is Parquet files read as they are, so that a row's place in them names it."""
    plan = df._jdf.queryExecution().analyzed()
    if not plan.deterministic():
        return False
    while plan.nodeName() in ("Project", "Filter", "SubqueryAlias"):
        plan = plan.children().head()
    return plan.nodeName() == "LogicalRelation" and "parquet" in plan.toString().lower() and not any(c.lower() == "_metadata" for c in df.columns)


def located(docs: DataFrame) -> DataFrame:
    """docs as (row, key): all its columns, and the locator of each row."""
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("at")).alias("key")
    if _is_scan(docs):
        return docs.select(common.whole(docs), place)
    return common.written(docs.select(common.whole(docs)), "dedup-copy").select("row", place)


def stream_states(spark: SparkSession, source: str, kind: str, files_per_batch: int | None = None, state: str | None = None, rows: int = 0) -> DataFrame:
    """(digest, keep_id, locator, group_size) of all rows under `source`, by a stream that stops when it has read them.

    kind: the type of doc_id.  state: a folder kept from an earlier call; rows that
    have arrived since are then all that is read.  rows: how many to expect, for the
    number of state partitions.
    """
    with common.Scratch(spark) as scratch:
        folder = state or scratch.folder("dedup-state")
        log_folder, batches = f"{state}/log" if state else common.new_folder(spark, "dedup-log"), []
        reader = spark.readStream.schema(f"doc_id {kind}, digest binary, locator {LOCATOR}")
        if files_per_batch:
            reader = reader.option("maxFilesPerTrigger", files_per_batch)
        stays = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "locator")).alias("stays")
        keyed = reader.parquet(source).groupBy("digest").agg(stays, F.count(F.lit(1)).alias("group_size"))

        def log(batch: DataFrame, batch_id: int) -> None:
            # A folder a batch, overwritten if the batch is run again after a failure.
            batch.select("digest", F.col("stays.doc_id").alias("keep_id"), "stays.locator", "group_size").write.mode("overwrite").parquet(f"{log_folder}/batch={batch_id}")
            batches.append(batch_id)

        # As many state partitions as the rows need, and no fewer than there are cores; a kept state keeps its own number.
        partitions = max(spark.sparkContext.defaultParallelism, -(-rows // STATE_ROWS))
        with _settings(spark, partitions):
            keyed.writeStream.outputMode("update").foreachBatch(log).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    states = spark.read.schema(f"digest binary, keep_id {kind}, locator {LOCATOR}, group_size long, batch int").parquet(log_folder)
    if state is None and set(batches) == {0}:
        return states.drop("batch")  # one batch has each digest once
    return states.groupBy("digest").agg(F.max_by(F.struct("keep_id", "locator", "group_size"), "batch").alias("s")).select("digest", "s.*")


def _groups(docs: DataFrame, files_per_batch: int | None = None, digest=_digest) -> tuple[DataFrame, DataFrame]:
    """(docs as `located`, and for every row its locator, doc_id, digest, and keep_id, keep_locator and group_size of its group)."""
    spark = docs.sparkSession
    common.settings(spark)
    packed = located(docs)
    kind = docs.schema["doc_id"].dataType.simpleString()
    source, seen = common.new_folder(spark, "dedup-rows"), Observation()
    named = packed.select(F.col("row.doc_id").alias("doc_id"), digest(F.col("row.text")).alias("digest"), F.col("key").alias("locator"))
    named.observe(seen, F.count(F.lit(1)).alias("n")).write.option("compression", "zstd").parquet(source)
    rows = spark.read.schema(named.schema).parquet(source)
    states = stream_states(spark, source, kind, files_per_batch, rows=seen.get.get("n", 0))
    common.tidy(spark)
    out = common.written(rows.join(states.withColumnRenamed("locator", "keep_locator"), "digest", "left"), "dedup-groups")
    common.tidy(spark)
    # Full bytes of all rows whose digest was hit: they are one text if the least and the greatest of them are.
    members = out.where("group_size > 1").select("locator")
    texts = packed.select(F.struct(F.col("row.doc_id").alias("doc_id"), F.col("row.text").alias("text")).alias("row"), "key")
    content = common.may_hit(texts, members, "locator").select(F.col("row.doc_id").alias("doc_id"), F.col("key").alias("locator"), digest(F.col("row.text")).alias("digest"), normalised(F.col("row.text")).alias("bytes"))
    with common.Scratch(spark) as scratch:
        several = content.groupBy("digest").agg(F.min("bytes").alias("least"), F.max("bytes").alias("greatest")).where("least <> greatest").select(F.col("digest").alias("several"))
        several, clashes = scratch.measured(several, "dedup-clashes", F.count(F.lit(1)).alias("n"))
        common.tidy(spark)
        if clashes.get("n"):
            # Texts that differ under one digest: none is known for this hash, but they stay apart if one comes up.
            clash = scratch.written(content.join(several, F.col("digest") == F.col("several")).drop("several"), "dedup-clash")
            stays = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "locator")).alias("stays")
            apart = scratch.written(clash.groupBy(F.col("digest").alias("d"), F.col("bytes").alias("b")).agg(stays, F.count(F.lit(1)).alias("own_size")), "dedup-apart")
            own = clash.join(apart, (F.col("digest") == F.col("d")) & (F.col("bytes") == F.col("b"))).select(F.col("locator").alias("own"), "stays", "own_size")
            mine = F.col("own").isNotNull()
            out = common.written(
                out.join(own, F.col("locator") == F.col("own"), "left").select(
                    "doc_id", "digest", "locator", F.when(mine, F.col("stays.doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
                    F.when(mine, F.col("stays.locator")).otherwise(F.col("keep_locator")).alias("keep_locator"), F.when(mine, F.col("own_size")).otherwise(F.col("group_size")).alias("group_size"),
                ), "dedup-groups",
            )
    return packed, out


def exact_groups(docs: DataFrame, files_per_batch: int | None = None, digest=_digest) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 and the locator of the row that stays, for every row of docs."""
    out = _groups(docs, files_per_batch, digest)[1]
    return out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"), "keep_locator")


def drop_exact_duplicates(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, with all their columns; of rows that repeat a doc_id and text one stays.

    Rows are named by their locators; of the others only copies are ever shuffled.
    """
    packed, groups = _groups(docs)
    gone = common.written(groups.where("locator <> keep_locator").select("locator"), "dedup-gone")
    common.tidy(docs.sparkSession)
    some = common.may_hit(packed, gone, "locator").join(gone, F.col("key") == F.col("locator"), "left_anti").select("row", "key")
    return common.unpacked(common.cannot_hit(packed, gone, "locator").union(some), docs)


def op3(spark, sf_dir: str) -> DataFrame:
    return exact_groups(common.table(spark, sf_dir, "documents")).drop("keep_locator")


OP3_SQL = r"""
WITH t AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents
), g AS (
  SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY text_sha256
)
SELECT t.doc_id, g.keep_id, CAST(g.group_size AS BIGINT) AS group_size, t.doc_id = g.keep_id AS kept, t.text_sha256
FROM t JOIN g USING (text_sha256)
"""
