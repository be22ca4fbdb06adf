"""Incremental rollups: finished buckets are sealed behind a lateness watermark, the rest is computed anew.

A rollup is a folder of Parquet files and a manifest.  Each immutable input
version has one file of partials at the finest resolution.  Each resolution has
sealed runs [low, high) and one hot part from the watermark on.  A build reads
new versions only, and of older ones those that reach beyond the watermark; runs
are written once, and neighbours of like size are merged, so their number grows
with the logarithm of the history.  A version that brings data older than the
watermark is refused: the answer is a rebuild.  So is another configuration.
"""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from strandline.functions.timebin import at, epoch_seconds, seconds
from strandline.operators import transforms
from strandline.plans import reduce
from strandline.plans.scratch import Store
from strandline.sources.urls import BUILTIN

FORMAT = 2
LATENESS = "1d"


class LateData(ValueError):
    """New data lies before the sealed watermark."""


class OverlappingVersion(ValueError):
    """A version that restates others begins before their end, so its rows would count twice."""


class CorruptRollup(RuntimeError):
    """A file that the manifest names isn't there, or isn't the one that was written."""


def watermark(newest_bucket: int, lateness: int, interval: int) -> int:
    """Epoch seconds up to which buckets are finished."""
    return (newest_bucket - lateness) // interval * interval


def plan(manifest: dict | None, versions: list[str], lateness: int, config: str) -> str:
    """reuse for the same versions, incremental for more of them, rebuild for anything else."""
    if manifest is None or (manifest["format"], manifest["lateness"], manifest["config"]) != (FORMAT, lateness, config):
        return "rebuild"
    old, new = set(manifest["versions"]), set(versions)
    return "reuse" if old == new else "incremental" if old < new else "rebuild"


def applies(folder: str | None, steps: list, scheme: str, sources: dict) -> bool:
    """Whether a rollup may serve: with a folder, sources in a format that is parsed, and nothing between them and the reduction."""
    return bool(folder and sources and not steps and scheme not in BUILTIN)


def reduced(spark: SparkSession, sources: dict[str, DataFrame], time_column: str, resolution: str, aggregations: list[dict], folder: str | None = None, steps: list = (), scheme: str = "file", resolutions: list[str] | None = None) -> DataFrame:
    """The reduction of all sources at a resolution: by a rollup where one applies, else in a single pass, with equal results."""
    if applies(folder, steps, scheme, sources):
        built = Rollup(spark, folder, time_column, resolutions or [resolution], aggregations)
        built.build(sources)
        return built.read(resolution)
    whole = transforms.chain(transforms.union_by_name(list(sources.values())), list(steps))
    return reduce.single_pass(whole, time_column, resolution, aggregations)


class Rollup:
    """snapshots: versions restate one another instead of adding to each other, so each must begin where the last one ended."""

    def __init__(self, spark: SparkSession, folder: str, time_column: str, resolutions: list[str], aggregations: list[dict], lateness: str = LATENESS, snapshots: bool = False):
        self.spark, self.folder, self.time = spark, folder.rstrip("/"), time_column
        self.levels = reduce.check_nesting(resolutions)
        self.aggregations, self.lateness, self.snapshots = aggregations, seconds(lateness), snapshots
        self.store = Store(spark, self.folder)
        self.config = hashlib.sha256(json.dumps([time_column, self.levels, aggregations, snapshots], sort_keys=True).encode()).hexdigest()

    def manifest(self) -> dict | None:
        return self.store.load("manifest.json")

    def drop(self) -> None:
        self.store.delete()

    def _read(self, parts: list[dict]) -> DataFrame:
        for p in parts:
            if self.store.digest(p["file"]) != p["digest"]:
                raise CorruptRollup(f"{p['file']} is missing or was changed")
        return transforms.union_by_name([self.spark.read.parquet(self.store.at(p["file"])) for p in parts])

    def _parts(self, level: dict, low: int | None = None) -> list[dict]:
        """Files of a level with buckets from low on."""
        return [*(r for r in level["runs"] if low is None or r["high"] > low), level["hot"]]

    def _written(self, df: DataFrame, name: str, **more) -> dict:
        seen = Observation()
        bucket = epoch_seconds(F.col("_bucket"))
        df.observe(seen, F.count(F.lit(1)).alias("rows"), F.min(bucket).alias("low"), F.max(bucket).alias("high")).write.mode("overwrite").parquet(self.store.at(name))
        return {"file": name, "digest": self.store.digest(name)} | {k: seen.get.get(k) for k in ("rows", "low", "high")} | more

    def build(self, versions: dict[str, DataFrame]) -> str:
        """Brings the rollup up to date with versions (name to table; a name's table never changes); what it did."""
        old = self.manifest()
        step = plan(old, list(versions), self.lateness, self.config)
        if step == "reuse":
            for level in old["levels"].values():
                self._read(self._parts(level))
            return step
        if step == "rebuild":
            self.drop()
            old = None
        # The schema is that of the last version by name.
        wanted = reduce.expand(versions[max(versions)], self.aggregations, self.time)
        manifest = old or {"format": FORMAT, "lateness": self.lateness, "config": self.config, "versions": {}, "levels": {}, "generation": 0}
        finest, generation = self.levels[0], manifest["generation"] + 1
        fresh = {v: None for v in sorted(versions) if v not in manifest["versions"]}
        sealed = manifest["levels"].get(finest, {}).get("sealed_hi")
        frontier = max([p["high"] for p in manifest["versions"].values() if p["rows"]], default=None)
        try:
            for v in fresh:
                part = fresh[v] = self._written(reduce.partials(versions[v], self.time, finest, wanted), self._version_file(v))
                if not part["rows"]:
                    continue
                if self.snapshots and frontier is not None and part["low"] < frontier:
                    raise OverlappingVersion(f"{v} begins at {part['low']}, before {frontier}, up to where versions were read: rebuild")
                if sealed is not None and part["low"] < sealed:
                    raise LateData(f"{v} has data at {part['low']}, older than the watermark {sealed}: rebuild")
                frontier = max(part["high"], part["high"] if frontier is None else frontier)
        except (LateData, OverlappingVersion):
            for v in fresh:
                self.store.delete(self._version_file(v))
            raise
        known = manifest["versions"] | fresh
        # What lies before the watermark is sealed: files that end there aren't opened, and the bound reaches the others' scans.
        live = [p for p in known.values() if sealed is None or p["rows"] and p["high"] >= sealed] or list(fresh.values())
        finer = reduce.merge(self._read(live), finest, wanted, low=sealed)
        garbage = []
        for name in self.levels:
            finer = self._level(manifest, name, finer, wanted, generation, frontier, garbage)
        digest = hashlib.sha256("\n".join(f"{v} {p['digest']}" for v, p in sorted(known.items())).encode()).hexdigest()
        self.store.save("manifest.json", manifest | {"versions": known, "wanted": wanted, "generation": generation, "frontier": frontier, "digest": digest})
        for name in garbage:  # no manifest names them any more
            self.store.delete(name)
        return step

    def _version_file(self, version: str) -> str:
        return f"versions/{hashlib.sha256(version.encode()).hexdigest()[:16]}"

    def _level(self, manifest: dict, name: str, finer: DataFrame, wanted, generation: int, newest: int | None, garbage: list[str]) -> DataFrame:
        """Seals what the watermark has passed, writes the rest in the same job, and returns what coarser levels need of the level."""
        level = manifest["levels"].setdefault(name, {"runs": [], "sealed_hi": None, "hot": None})
        step, low = seconds(name), level["sealed_hi"]
        new = finer if name == self.levels[0] else reduce.merge(finer, name, wanted, low=low)
        high = low if newest is None else watermark(newest // step * step, self.lateness, step)
        high = high if low is None else max(low, high)
        bucket, seen = F.col("_bucket"), Observation()
        done = F.lit(False) if high is None else bucket < at(high)
        where = f"levels/{name}-{generation}"
        counted = new.withColumn("sealed", done).observe(seen, F.count_if("sealed").alias("runs"), F.count_if(~F.col("sealed")).alias("hot"))
        counted.write.mode("overwrite").partitionBy("sealed").parquet(self.store.at(where))
        if seen.get.get("runs"):
            self._add(level, {"file": f"{where}/sealed=true", "digest": self.store.digest(f"{where}/sealed=true"), "rows": seen.get["runs"], "low": low, "high": high}, f"levels/{name}-{generation}-merged", garbage)
        hot = f"{where}/sealed=false"
        if not seen.get.get("hot"):
            # An empty part still has the columns.
            hot = f"levels/{name}-{generation}-hot"
            new.where("false").write.mode("overwrite").parquet(self.store.at(hot))
        if level["hot"]:
            garbage.append(level["hot"]["file"])
        level |= {"sealed_hi": high, "hot": {"file": hot, "digest": self.store.digest(hot), "rows": seen.get.get("hot")}}
        coarser = self.levels[self.levels.index(name) + 1 :][:1]
        return self._read(self._parts(level, manifest["levels"].get(coarser[0], {}).get("sealed_hi") if coarser else high))

    def _add(self, level: dict, run: dict, merged: str, garbage: list[str]) -> None:
        """Adds a run, together with its neighbours of like size or less: each row is written again as often as the runs' number doubles."""
        together = [run]
        while level["runs"] and level["runs"][-1]["rows"] <= 2 * sum(r["rows"] for r in together):
            together.insert(0, level["runs"].pop())
        if len(together) > 1:
            self._read(together).write.mode("overwrite").parquet(self.store.at(merged))
            garbage += [r["file"] for r in together]
            run = {"file": merged, "digest": self.store.digest(merged), "rows": sum(r["rows"] for r in together), "low": together[0]["low"], "high": run["high"]}
        level["runs"].append(run)

    def read(self, resolution: str, ordered: bool = True) -> DataFrame:
        """The reduced table at a resolution: equal to a single pass over all versions."""
        manifest = self.manifest()
        if manifest is None:
            raise CorruptRollup("not built yet")
        if manifest["config"] != self.config:
            raise CorruptRollup("built for another configuration")
        return reduce.reconstruct(self._read(self._parts(manifest["levels"][resolution])), [tuple(x) for x in manifest["wanted"]], self.time, ordered)
