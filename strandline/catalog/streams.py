"""Streaming queries; each must give what the batch query gives."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandline.catalog import query
from strandline.plans import scratch
from strandline.plans.scratch import table
from strandline.streaming import fold, windows


def _stream(spark, sf_dir, parts: int = 3):
    """Events as files that arrive one after another, in the order of their times."""
    where, e = scratch.folder(spark, "arrivals"), table(spark, sf_dir, "events")
    for k in range(parts):
        e.where(f"(day(ts) - 1) * {parts} div 31 = {k}").coalesce(1).write.mode("append").parquet(where)
    return windows.source(spark, where)


@query("st_tumbling", "SELECT time_bucket(INTERVAL '4 hours', ts, TIMESTAMP '1970-01-01') AS ts, event_type, CAST(count(*) AS BIGINT) AS n, max(value) AS top FROM events GROUP BY 1, 2")
def _(spark, sf_dir):
    out = windows.tumbling(_stream(spark, sf_dir), "ts", "4 hours", [F.count(F.lit(1)).alias("n"), F.max("value").alias("top")], ["event_type"])
    return windows.run(out, "complete")


@query("st_tumbling_update", "SELECT time_bucket(INTERVAL '4 hours', ts, TIMESTAMP '1970-01-01') AS ts, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY 1")
def _(spark, sf_dir):
    out = windows.tumbling(_stream(spark, sf_dir), "ts", "4 hours", [F.count(F.lit(1)).alias("n")])
    return windows.run(out, "update", ["ts"])


@query("st_tumbling_append")
def _(spark, sf_dir):
    """Finished windows only: those behind the watermark when the input ends."""
    out = windows.tumbling(_stream(spark, sf_dir), "ts", "4 hours", [F.count(F.lit(1)).alias("n")], lateness="1 day")
    return windows.run(out, "append")


@query("st_sliding", "SELECT w AS ts, CAST(count(*) AS BIGINT) AS n FROM (SELECT unnest([time_bucket(INTERVAL '1 hour', ts, TIMESTAMP '1970-01-01') - INTERVAL 1 HOUR * i FOR i IN [0, 1, 2]]) AS w FROM events) GROUP BY 1")
def _(spark, sf_dir):
    return windows.tumbling(table(spark, sf_dir, "events"), "ts", "3 hours", [F.count(F.lit(1)).alias("n")], slide="1 hour")


@query("st_sessions", "WITH e AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 6 HOUR THEN 1 ELSE 0 END AS brk FROM events), s AS (SELECT *, sum(brk) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e) SELECT min(ts) AS first_time, user_id, CAST(count(*) AS BIGINT) AS n FROM s GROUP BY user_id, k")
def _(spark, sf_dir):
    return windows.sessions(table(spark, sf_dir, "events"), "ts", "6 hours", ["user_id"], [F.count(F.lit(1)).alias("n")])


def _entries(spark, sf_dir):
    return table(spark, sf_dir, "events").select(F.col("event_type").alias("key"), F.col("ts").alias("time"), F.col("props").alias("message"), F.day("ts").alias("version"))


@query("st_status_fold", "SELECT event_type AS key, max(ts) AS time, arg_max(props, ts) AS message FROM events GROUP BY 1")
def _(spark, sf_dir):
    where, e = scratch.folder(spark, "status"), _entries(spark, sf_dir)
    for through in (10, 10, 20, 31):  # the second fold finds nothing new; each is by an object of its own
        fold.StatusFold(spark, where).fold(e.where(f"version <= {through}"))
    return fold.StatusFold(spark, where).latest()


@query("st_status_tail", "SELECT key, time, message FROM (SELECT event_type AS key, ts AS time, props AS message, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, props) AS n FROM events) WHERE n <= 5")
def _(spark, sf_dir):
    f = fold.StatusFold(spark, scratch.folder(spark, "status"))
    for through in (15, 31):
        f.fold(_entries(spark, sf_dir).where(f"version <= {through}"))
    return f.newest()


@query(
    "st_log_tail",
    "SELECT line, CAST(count(*) AS BIGINT) AS n FROM (SELECT 'r' || r_regionkey || ' ' || r_name AS line FROM region UNION ALL SELECT 'n' || n_nationkey || ' ' || n_name FROM nation UNION ALL SELECT 'r' || r_regionkey || ' ' || r_name || ' again' FROM region) GROUP BY 1",
)
def _(spark, sf_dir):
    """A log that grows, grows and rotates, and begins anew: every line once, the last ones before the rotation from the archive."""
    where = scratch.folder(spark, "logs")
    files, tail = scratch.Store(spark, where), fold.LogTail(spark, f"{where}-tail")
    one = [f"r{r.r_regionkey} {r.r_name}" for r in table(spark, sf_dir, "region").orderBy("r_regionkey").collect()]
    two = [f"n{r.n_nationkey} {r.n_name}" for r in table(spark, sf_dir, "nation").orderBy("n_nationkey").collect()]
    three = [f"{x} again" for x in one]
    text = lambda lines: "".join(f"{x}\n" for x in lines)
    steps = [
        {"app.log": text(one[:3]) + "half a li"},
        {"app.log": text(one + two[:4])},
        {"app.log": text(one + two[:4])},
        {"app.log": text(three), "app.log.1": text(one + two)},
        {"app.log": text(three), "app.log.1": text(one + two)},
    ]
    for step in steps:
        for name, content in step.items():
            files.put(name, content)
        tail.ingest(f"{where}/app.log", f"{where}/app.log.[0-9]*" if len(step) > 1 else None)
    return tail.lines().groupBy("line").agg(F.count(F.lit(1)).alias("n"))


_UNIT = "CASE WHEN event_type = 'error' THEN 'kernel' WHEN event_type = 'view' THEN CASE WHEN user_id % 2 = 0 THEN 'own.service' ELSE 'user@1.service' END WHEN event_type = 'click' THEN 'web.service' WHEN event_type = 'signup' THEN 'ident' ELSE 'other' END"


@query("st_journal", f"SELECT {_UNIT} AS series, CAST(count(*) AS BIGINT) AS n, min(ts) AS first_time, max(ts) AS last_time FROM events GROUP BY 1")
def _(spark, sf_dir):
    """Entries routed to a series a unit, in runs that overlap, each by an object of its own: the cursor lets an entry in once."""
    t, u = F.col("event_type"), F.col("user_id")
    unit = F.when(t == "view", "user@1.service").when(t == "click", "web.service")
    series = fold.route(F.when(t == "error", "kernel").otherwise("journal"), unit, F.when(u % 2 == 0, "own.service"), F.when(t == "signup", "ident"))
    entries = table(spark, sf_dir, "events").select(F.col("event_id").alias("cursor"), F.col("ts").alias("time"), series.alias("series"), "props")
    last, where = entries.agg(F.max("cursor")).first()[0] or 0, scratch.folder(spark, "journal")
    for share in (0.4, 0.7, 0.7, 1.0):
        fold.JournalIngest(spark, where).ingest(entries.where(F.col("cursor") <= int(last * share)))
    return fold.JournalIngest(spark, where).spans()
