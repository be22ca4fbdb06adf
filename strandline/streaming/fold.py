"""Durable folds and ingests: status of each key, journal entries by unit, and growing log files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from strandline.operators.transforms import union_by_name
from strandline.plans.scratch import Store


class StatusFold:
    """Latest entry and newest messages of each key.

    A fold reads versions above its watermark only, so folding a version again
    changes nothing and the watermark never goes back.  Of entries of one time
    the one folded later wins.  Generation and watermark lie beside the tables and
    are replaced in one step once these are written, so a fold that breaks off
    leaves the last state, and another object on the folder goes on from it.
    backfill: seconds before the newest entry that a first fold takes; all without.
    """

    def __init__(self, spark: SparkSession, folder: str, tail: int = 5, backfill: int | None = None):
        self.spark, self.store, self.tail, self.backfill = spark, Store(spark, folder), tail, backfill

    def state(self) -> dict:
        return self.store.load("state.json") or {"generation": 0, "through": -1}

    def _path(self, what: str, generation: int) -> str:
        return self.store.at(f"{what}-{generation}")

    def fold(self, entries: DataFrame) -> None:
        """entries: key, time, message, version."""
        state = self.state()
        new = entries.where(F.col("version") > state["through"])
        high, newest = new.agg(F.max("version"), F.max("time")).first()
        if high is None:
            return
        if not state["generation"] and self.backfill is not None:
            new = new.where(F.col("time") >= F.timestamp_add("SECOND", F.lit(-self.backfill), F.lit(newest).cast(entries.schema["time"].dataType)))
        generation = state["generation"] + 1
        after = F.struct("time", "fold", "version", "message")
        seen = new.select("key", "time", "message", "version", F.lit(generation).alias("fold"))
        tail = seen.select("key", "time", "message")
        if state["generation"]:
            seen = union_by_name([seen, self._read("latest")])
            tail = union_by_name([tail, self._read("tail")])
        latest = seen.groupBy("key").agg(F.max_by(F.struct("time", "message", "version", "fold"), after).alias("l")).select("key", "l.*")
        place = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("time"), "message"))
        tail = tail.distinct().withColumn("n", place).where(F.col("n") <= self.tail).drop("n")
        latest.write.mode("overwrite").parquet(self._path("latest", generation))
        tail.write.mode("overwrite").parquet(self._path("tail", generation))
        self.store.save("state.json", {"generation": generation, "through": max(state["through"], high)})
        for what in ("latest", "tail"):
            self.store.delete(f"{what}-{generation - 2}")

    def _read(self, what: str) -> DataFrame:
        return self.spark.read.parquet(self._path(what, self.state()["generation"]))

    def latest(self) -> DataFrame:
        return self._read("latest").select("key", "time", "message")

    def newest(self) -> DataFrame:
        return self._read("tail")


def route(transport: Column, unit: Column, user_unit: Column, identifier: Column) -> Column:
    """The series that a journal entry belongs to: kernel, its unit (a user's own below user@ services), identifier or other."""
    known = lambda c: c.isNotNull() & (c != "")
    own = F.when(unit.rlike("^user@.*\\.service$") & known(user_unit), user_unit).otherwise(unit)
    return F.when(transport == "kernel", "kernel").when(known(unit), own).when(known(identifier), identifier).otherwise("other")


class JournalIngest:
    """Journal entries appended to one series a unit, each exactly once.

    The cursor of the last entry taken lies beside the series.  A batch has a folder
    of its own, written again from the same cursor if it breaks off before the
    cursor moves, and is read only once it has moved.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.store = spark, Store(spark, folder)

    def state(self) -> dict:
        return self.store.load("state.json") or {"batches": 0, "cursor": None}

    def ingest(self, entries: DataFrame) -> int:
        """Takes entries (cursor, time, series and more columns) whose cursor is beyond the last one; how many."""
        state, seen = self.state(), Observation()
        new = entries if state["cursor"] is None else entries.where(F.col("cursor") > state["cursor"])
        counted = new.observe(seen, F.count(F.lit(1)).alias("n"), F.max("cursor").alias("cursor"))
        counted.write.mode("overwrite").partitionBy("series").parquet(self.store.at(f"batches/{state['batches']}"))
        n, cursor = seen.get.get("n", 0), seen.get.get("cursor")
        if n:
            self.store.save("state.json", {"batches": state["batches"] + 1, "cursor": cursor})
        return n

    def read(self) -> DataFrame:
        paths = [self.store.at(f"batches/{i}") for i in range(self.state()["batches"])]
        return union_by_name([self.spark.read.parquet(p) for p in paths])

    def spans(self) -> DataFrame:
        """Entries, first and last time of each series."""
        return self.read().groupBy("series").agg(F.count(F.lit(1)).alias("n"), F.min("time").alias("first_time"), F.max("time").alias("last_time"))


def tail_state(size: Column, same_prefix: Column, old_size: Column) -> Column:
    """What became of a growing log file: new, same, appended or rotated."""
    kept = F.when((size < old_size) | ~same_prefix, "rotated").when(size == old_size, "same").otherwise("appended")
    return F.when(old_size.isNull(), "new").otherwise(kept)


class LogTail:
    """Growing, rotating log files ingested line by line, each line once.

    Of every active file the length and the digest of what was taken are kept.  A
    file that begins with those bytes has grown, and what follows them, up to its
    last line end, is taken; any other was rotated: it is taken from its start, and
    the archived file that begins with the old bytes is taken from where they end.
    Archived files don't change; each is taken once.  Lines lie in a folder a run,
    and count only when the state that names it has been replaced.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.store = spark, Store(spark, folder)

    def _state(self) -> dict:
        return self.store.load("state.json") or {"runs": 0}

    def _known(self, state: dict) -> DataFrame:
        schema = "path string, kind string, size long, digest string"
        return self.spark.read.schema(schema).parquet(self.store.at(f"known/{state['runs']}")) if state["runs"] else self.spark.createDataFrame([], schema)

    def ingest(self, active: str, archived: str | None = None) -> DataFrame:
        """Takes what the files of two patterns have that is new: path and state of every file."""
        state = self._state()
        run, known = state["runs"] + 1, self._known(state)
        head = lambda n: F.sha2(F.substring("content", F.lit(1), n.cast("int")), 256)
        files = self._files(active, "active")
        if archived:
            files = files.unionByName(self._files(archived, "archived"))
        # Only whole lines are taken.
        body = F.length("content") - F.length(F.substring_index(F.decode("content", "ISO-8859-1"), "\n", -1))
        files = files.withColumn("whole", F.when(F.col("kind") == "archived", F.length("content")).otherwise(body).cast("long"))
        mine = known.select(F.col("path").alias("k_path"), F.col("kind").alias("k_kind"), F.col("size").alias("k_size"), F.col("digest").alias("k_digest"))
        found = files.join(mine, (F.col("path") == F.col("k_path")) & (F.col("kind") == F.col("k_kind")), "left")
        found = found.withColumn("state", tail_state(F.col("whole"), head(F.col("k_size")) == F.col("k_digest"), F.col("k_size")))
        found = found.withColumn("from", F.when(F.col("state").isin("same", "appended"), F.col("k_size")).otherwise(0))
        if archived:
            # What a rotated file had before lies at the head of an archived file that is new; as many pairs as files of the two kinds that are new and rotated.
            moved = found.where("kind = 'active' and state = 'rotated'").select(F.col("k_size").alias("m_size"), F.col("k_digest").alias("m_digest"))
            fresh = found.where("kind = 'archived' and state = 'new'").select("path", "content").join(moved, head(F.col("m_size")) == F.col("m_digest"))
            taken = fresh.groupBy(F.col("path").alias("t_path")).agg(F.max("m_size").alias("taken"))
            found = found.join(taken, F.col("path") == F.col("t_path"), "left").withColumn("from", F.coalesce("taken", "from"))
            # Seen before: an archived file as it is, or an active one that has only got another name.
        found = found.withColumn("state", F.when((F.col("kind") == "archived") & (F.col("state") == "new") & (F.col("from") > 0), "continued").otherwise(F.col("state")))
        delta = found.where("from < whole and (kind = 'active' or state <> 'rotated')")
        lines = delta.select("path", F.posexplode(F.split(F.rtrim(F.decode(F.expr("substring(content, cast(from + 1 as int), cast(whole - from as int))"), "UTF-8"), F.lit("\n")), "\n")).alias("place", "line"))
        lines.write.mode("overwrite").parquet(self.store.at(f"lines/{run}"))
        result = found.select("path", "kind", "state", F.col("whole").alias("size"), head(F.col("whole")).alias("digest"))
        result.write.mode("overwrite").parquet(self.store.at(f"known/{run}"))
        result = self.spark.read.parquet(self.store.at(f"known/{run}"))
        if result.where("kind = 'archived' and state = 'rotated'").limit(1).count():
            raise ValueError("an archived log was changed")
        self.store.save("state.json", {"runs": run})
        return result.select("path", "state")

    def _files(self, pattern: str, kind: str) -> DataFrame:
        found = self.spark.read.format("binaryFile").load(pattern)
        return found.select("path", F.lit(kind).alias("kind"), "content")

    def lines(self) -> DataFrame:
        """All lines taken so far: run, path, place within the run, line."""
        paths = [(i, self.store.at(f"lines/{i}")) for i in range(1, self._state()["runs"] + 1)]
        return union_by_name([self.spark.read.parquet(p).select(F.lit(i).alias("run"), "path", "place", "line") for i, p in paths])
