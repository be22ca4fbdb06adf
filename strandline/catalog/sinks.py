"""Sinks, exports and maintenance."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandline.catalog import query
from strandline.operators import transforms
from strandline.plans import export, scratch, tablelog, views
from strandline.plans.scratch import table


def _events(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", "ts", "value")


@query(
    "snk_table",
    "SELECT 0 AS line, 'r_regionkey int | r_name string' AS text UNION ALL SELECT CAST(row_number() OVER (ORDER BY r_regionkey) AS INTEGER), r_regionkey || ' | ' || r_name FROM region UNION ALL SELECT CAST(count(*) + 1 AS INTEGER), count(*) || ' rows' FROM region",
)
def _(spark, sf_dir):
    """What a terminal shows: header with types, rows, and their number."""
    df = table(spark, sf_dir, "region").orderBy("r_regionkey")
    head = " | ".join(f"{n} {t}" for n, t in df.dtypes)
    lines = [head, *[" | ".join(map(str, r)) for r in df.limit(100).collect()], f"{df.count()} rows"]
    return spark.createDataFrame([(i, s) for i, s in enumerate(lines)], "line int, text string")


@query("snk_parquet_stdout", "SELECT r_regionkey, r_name FROM region")
def _(spark, sf_dir):
    where = scratch.folder(spark, "parquet")
    table(spark, sf_dir, "region").write.parquet(where)
    return spark.read.parquet(where)


@query("snk_hive_export", "SELECT CAST(year(ts) AS INTEGER) AS year, CAST(month(ts) AS INTEGER) AS month, CAST(day(ts) AS INTEGER) AS day, CAST(count(*) AS BIGINT) AS n, round(sum(value), 4) AS total, min(ts) AS first_ts FROM events GROUP BY 1, 2, 3")
def _(spark, sf_dir):
    where = scratch.folder(spark, "export")
    export.export(_events(spark, sf_dir), where, "ts", ["year", "month", "day"])
    return spark.read.parquet(where).groupBy("year", "month", "day").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"), F.min("ts").alias("first_ts"))


@query("snk_export_range", "SELECT CAST(day(ts) AS INTEGER) AS day, CAST(count(*) AS BIGINT) AS n FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-10' AND TIMESTAMP '2024-01-20' GROUP BY 1")
def _(spark, sf_dir):
    where = scratch.folder(spark, "export")
    export.export(_events(spark, sf_dir), where, "ts", ["year", "month", "day"], "2024-01-10 00:00:00", "2024-01-20 00:00:00")
    return spark.read.parquet(where).groupBy("day").agg(F.count(F.lit(1)).alias("n"))


@query(
    "snk_export_reuse",
    "WITH d AS (SELECT DISTINCT CAST(ts AS DATE) AS x FROM events), n AS (SELECT CAST(count(*) AS INTEGER) AS every, CAST(count(*) FILTER (day(x) < 20) AS INTEGER) AS early, CAST(count(*) FILTER (day(x) = 3) AS INTEGER) AS third FROM d) "
    "SELECT 0 AS export, 0 AS kept, early AS written, 0 AS removed FROM n UNION ALL SELECT 1, early, every - early, 0 FROM n UNION ALL SELECT 2, every - third, 0, third FROM n UNION ALL SELECT 3, every - third - 1, third + 1, 0 FROM n",
)
def _(spark, sf_dir):
    """Three exports with more days, fewer days, and again all after a partition's files were lost: only what differs is written."""
    where = scratch.folder(spark, "export")
    e, steps = _events(spark, sf_dir), []
    for df in (e.where("day(ts) < 20"), e, e.where("day(ts) <> 3"), e):
        if len(steps) == 3:
            scratch.Store(spark, where).delete("year=2024/month=1/day=5")
        steps.append(export.export_changed(df, where, "ts", ["year", "month", "day"]))
    return spark.createDataFrame([(i, len(k), len(w), len(r)) for i, (k, w, r) in enumerate(steps)], "export int, kept int, written int, removed int")


@query("snk_partition_times", "SELECT * FROM (VALUES ('year=2024', 1704067200, 1735689600), ('year=2024/quarter=2', 1711929600, 1719792000), ('year=2024/month=2', 1706745600, 1709251200), ('year=2024/month=12/day=31', 1735603200, 1735689600), ('year=2023/month=1/day=1/hour=5', 1672549200, 1672552800)) t(path, first, after)")
def _(spark, sf_dir):
    paths = ["year=2024", "year=2024/quarter=2", "year=2024/month=2", "year=2024/month=12/day=31", "year=2023/month=1/day=1/hour=5"]
    return spark.createDataFrame([(p, *export.partition_times(p)) for p in paths], "path string, first int, after int")


@query("snk_partition_plan", "SELECT * FROM (VALUES (1, 3600), (60, 86400), (3600, 7776000), (21600, 31536000), (86400, 31536000)) t(resolution, width)")
def _(spark, sf_dir):
    return spark.createDataFrame([(r, export.file_width(r)) for r in (1, 60, 3600, 21600, 86400)], "resolution int, width int")


@query("snk_field_parse", "SELECT * FROM (VALUES ('depth', NULL, 'depth', NULL, NULL), ('temp.avg', NULL, 'temp', NULL, 'avg'), ('temp.C.avg', NULL, 'temp', 'C', 'avg'), ('a.b.temp.C.max', 'a.b', 'temp', 'C', 'max'), ('timestamp.count', NULL, 'timestamp', NULL, 'count')) t(field, instrument, name, unit, agg)")
def _(spark, sf_dir):
    fields = ["depth", "temp.avg", "temp.C.avg", "a.b.temp.C.max", "timestamp.count"]
    rows = [(f, p["instrument"], p["name"], p["unit"], p["agg"]) for f in fields for p in (export.field_parts(f),)]
    return spark.createDataFrame(rows, "field string, instrument string, name string, unit string, agg string")


@query("snk_export_set", "SELECT DISTINCT event_type AS capture, 'year=' || year(ts) || '/month=' || month(ts) AS partition FROM events WHERE event_type IN ('click', 'view')")
def _(spark, sf_dir):
    where = scratch.folder(spark, "set")
    rows = []
    for t in ("click", "view"):
        df = table(spark, sf_dir, "events").where(F.col("event_type") == t).select("ts", "value")
        rows += [(t, p) for p in export.export(df, f"{where}/{t}", "ts", ["year", "month"])]
    return spark.createDataFrame(rows, "capture string, partition string")


@query("snk_copy_out", "SELECT n_nationkey, n_name FROM nation")
def _(spark, sf_dir):
    where = scratch.folder(spark, "copy")
    table(spark, sf_dir, "nation").select("n_nationkey", "n_name").write.option("header", True).csv(where)
    return spark.read.schema("n_nationkey int, n_name string").option("header", True).csv(where)


@query("snk_series_write", "SELECT event_id, value FROM events")
def _(spark, sf_dir):
    """Ten appends to one series."""
    where = scratch.folder(spark, "series")
    for k in range(10):
        table(spark, sf_dir, "events").where(f"event_id % 10 = {k}").select("event_id", "value").write.mode("append").parquet(where)
    return spark.read.parquet(where)


@query("snk_site", "SELECT time_bucket(INTERVAL '1 hour', ts, TIMESTAMP '1970-01-01') AS t, max(value) AS v FROM events WHERE ts >= TIMESTAMP '2024-01-10' AND ts <= TIMESTAMP '2024-01-12' GROUP BY 1")
def _(spark, sf_dir):
    """A viewer's query: partitions of the range only, at the resolution of the view."""
    where = scratch.folder(spark, "site")
    export.export(_events(spark, sf_dir), where, "ts", ["year", "month", "day"])
    view = transforms.within(spark.read.parquet(where).where("year = 2024 and month = 1 and day between 10 and 12"), "ts", "2024-01-10 00:00:00", "2024-01-12 00:00:00")
    return view.groupBy(F.window("ts", "1 hour")["start"].alias("t")).agg(F.max("value").alias("v"))


@query("ver_collapse", "SELECT event_id, ts, value FROM events")
def _(spark, sf_dir):
    """Many versions rewritten as one: the same rows."""
    where = scratch.folder(spark, "versions")
    e = _events(spark, sf_dir)
    for k in range(3):
        e.where(f"event_id % 3 = {k}").write.parquet(f"{where}/v{k}")
    merged = transforms.union_by_name([spark.read.parquet(f"{where}/v{k}") for k in range(3)])
    merged.hint("rebalance").write.parquet(f"{where}/collapsed")  # as few files as their size allows
    return spark.read.parquet(f"{where}/collapsed")


@query("ver_compact_sort", "SELECT event_id, ts, value FROM events ORDER BY ts")
def _(spark, sf_dir):
    where = scratch.folder(spark, "sorted")
    _events(spark, sf_dir).orderBy("ts", "event_id").write.parquet(where)
    return spark.read.parquet(where)


@query("delta_maint", "SELECT step, rows FROM (SELECT CAST(count(*) AS BIGINT) AS rows FROM events), (VALUES ('twelve appends'), ('compacted'), ('from the checkpoint'), ('vacuumed'), ('a version before')) t(step)")
def _(spark, sf_dir):
    """A table of many small files packed to a target size, checkpointed and cleared of what no version needs: the rows stay."""
    log = tablelog.TableLog(spark, scratch.folder(spark, "log"))
    e, rows = _events(spark, sf_dir), []
    for k in range(12):
        log.append(e.where(f"event_id % 12 = {k}"))
    rows.append(("twelve appends", log.read().count()))
    before, many = log.version(), len(log.live())
    log.compact()
    assert len(log.live()) < many and log.compact() is None
    rows.append(("compacted", log.read().count()))
    log.checkpoint()
    rows.append(("from the checkpoint", log.read().count()))
    rows.append(("a version before", log.read(before).count()))
    assert len(log.vacuum()) == many and not log.vacuum()
    rows.append(("vacuumed", log.read().count()))
    return spark.createDataFrame(rows, "step string, rows long")


@query("src_delta_log", "SELECT * FROM (VALUES ('append', true, 3::BIGINT, 2::BIGINT), ('compact', true, 1, 3), ('compact', false, 3, 3)) t(action, added, files, last_version)")
def _(spark, sf_dir):
    """The log of a table as a table that SQL reads: files and newest version by action."""
    log = tablelog.TableLog(spark, scratch.folder(spark, "log"))
    for k in range(3):
        log.append(_events(spark, sf_dir).where(f"event_id % 3 = {k}").coalesce(1))
    log.compact()
    return views.sql_view(spark, {"delta_table": log.history()}, "SELECT action, added, count(*) AS files, max(version) AS last_version FROM delta_table GROUP BY action, added")


@query("ext_exec_modes", "SELECT * FROM (VALUES ('reader', 'read', true), ('reader', 'write', false), ('writer', 'read', true), ('writer', 'write', true), ('transform', 'read', true), ('transform', 'write', false)) t(mode, act, allowed)")
def _(spark, sf_dir):
    """What a step may do to a catalog in each mode, by trying."""
    rows = []
    for mode in views.MODES:
        for act in ("read", "write"):
            catalog = views.Catalog(spark)
            catalog.add("tables/region", table(spark, sf_dir, "region"))
            limited = views.limited(catalog, mode)
            try:
                limited.get("tables/region") if act == "read" else limited.add("tables/other", table(spark, sf_dir, "nation"))
                rows.append((mode, act, True))
            except PermissionError:
                rows.append((mode, act, False))
    return spark.createDataFrame(rows, "mode string, act string, allowed boolean")
