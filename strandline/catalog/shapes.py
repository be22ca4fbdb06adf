"""Windows, order, sets, composite analytics, overlaps and scalar functions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from strandline.catalog import query
from strandline.catalog.sources import by_type
from strandline.functions.timebin import epoch_seconds
from strandline.operators import overlap, transforms
from strandline.plans.scratch import table


def _events(spark, sf_dir):
    return table(spark, sf_dir, "events")




def own():
    """A user's events in order; event_id makes the order total."""
    return Window.partitionBy("user_id").orderBy("ts", "event_id")


_W = "(PARTITION BY user_id ORDER BY ts, event_id"


def _window(name, sql, expr):
    query(name, f"SELECT event_id, {sql} AS x FROM events")(lambda spark, sf_dir: _events(spark, sf_dir).select("event_id", expr().alias("x")))


_window("win_row_number", f"row_number() OVER {_W})", lambda: F.row_number().over(own()).cast("long"))
_window("win_lag", f"lag(value) OVER {_W})", lambda: F.lag("value").over(own()))
_window("win_lead", f"lead(event_id, 2) OVER {_W})", lambda: F.lead("event_id", 2).over(own()))
_window("win_running_sum", f"CAST(sum(CASE WHEN value > 42 THEN 1 ELSE 0 END) OVER {_W} ROWS UNBOUNDED PRECEDING) AS BIGINT)", lambda: F.sum(F.when(F.col("value") > 42, 1).otherwise(0)).over(own().rowsBetween(Window.unboundedPreceding, 0)))
_window("win_first_value", f"first_value(value) OVER {_W})", lambda: F.first_value("value").over(own()))
_window("win_first_full_frame", "first_value(event_id) OVER (PARTITION BY user_id ORDER BY value, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)", lambda: F.first_value("event_id").over(Window.partitionBy("user_id").orderBy("value", "event_id").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
_window("win_partition_max", "max(value) OVER (PARTITION BY user_id)", lambda: F.max("value").over(Window.partitionBy("user_id")))
_window("win_moving_avg", f"round(avg(value) OVER {_W} ROWS BETWEEN 20 PRECEDING AND 10 PRECEDING), 9)", lambda: F.round(F.avg("value").over(own().rowsBetween(-20, -10)), 9))
_window("win_rank", "rank() OVER (PARTITION BY event_type ORDER BY floor(value))", lambda: F.rank().over(Window.partitionBy("event_type").orderBy(F.floor("value"))).cast("long"))
_window("win_dense_rank", "dense_rank() OVER (PARTITION BY event_type ORDER BY floor(value))", lambda: F.dense_rank().over(Window.partitionBy("event_type").orderBy(F.floor("value"))).cast("long"))
_window("win_ntile", f"ntile(4) OVER {_W})", lambda: F.ntile(4).over(own()).cast("long"))
_window("win_nth_value", f"nth_value(event_id, 3) OVER {_W})", lambda: F.nth_value("event_id", 3).over(own()))
_window("win_range", "CAST(count(*) OVER (PARTITION BY user_id ORDER BY event_id RANGE BETWEEN 500 PRECEDING AND CURRENT ROW) AS BIGINT)", lambda: F.count(F.lit(1)).over(Window.partitionBy("user_id").orderBy("event_id").rangeBetween(-500, 0)))


@query("ord_sort", "SELECT event_id, ts FROM events ORDER BY ts, event_id")
def _(spark, sf_dir):
    return _events(spark, sf_dir).select("event_id", "ts").orderBy("ts", "event_id")


@query("ord_topk", "SELECT * FROM (SELECT event_id, value FROM events ORDER BY value DESC, event_id LIMIT 25) ORDER BY event_id")
def _(spark, sf_dir):
    return _events(spark, sf_dir).select("event_id", "value").orderBy(F.desc("value"), "event_id").limit(25).orderBy("event_id")


@query("ord_limit_offset", "SELECT event_id, value FROM events ORDER BY event_id LIMIT 10 OFFSET 30")
def _(spark, sf_dir):
    return _events(spark, sf_dir).select("event_id", "value").orderBy("event_id").offset(30).limit(10)


@query("ord_case_key", "SELECT o_orderkey, o_orderstatus FROM orders ORDER BY CASE o_orderstatus WHEN 'O' THEN 0 WHEN 'P' THEN 1 ELSE 2 END, o_orderkey LIMIT 40")
def _(spark, sf_dir):
    key = F.when(F.col("o_orderstatus") == "O", 0).when(F.col("o_orderstatus") == "P", 1).otherwise(2)
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus").orderBy(key, "o_orderkey").limit(40)


def _pair(spark, sf_dir):
    t = by_type(spark, sf_dir, "user_id", F.floor("value").alias("v"))
    return t["click"], t["view"]


_L, _R = "SELECT user_id, CAST(floor(value) AS BIGINT) AS v FROM events WHERE event_type = 'click'", "SELECT user_id, CAST(floor(value) AS BIGINT) AS v FROM events WHERE event_type = 'view'"


@query("set_union_all", f"{_L} UNION ALL {_R}")
def _(spark, sf_dir):
    a, b = _pair(spark, sf_dir)
    return a.union(b)


@query("set_union_distinct", f"{_L} UNION {_R}")
def _(spark, sf_dir):
    a, b = _pair(spark, sf_dir)
    return a.union(b).distinct()


@query("set_union_all_by_name", f"SELECT user_id, v, NULL::VARCHAR AS w FROM ({_L}) UNION ALL SELECT user_id, v, 'x' FROM ({_R})")
def _(spark, sf_dir):
    a, b = _pair(spark, sf_dir)
    return transforms.union_by_name([a, b.select(F.lit("x").alias("w"), "v", "user_id")])


@query("set_union_by_name_distinct", f"SELECT user_id, v FROM ({_L}) UNION SELECT user_id, v FROM ({_R})")
def _(spark, sf_dir):
    a, b = _pair(spark, sf_dir)
    return transforms.union_by_name([a, b.select("v", "user_id")], distinct=True)


@query("set_intersect", f"{_L} INTERSECT {_R}")
def _(spark, sf_dir):
    a, b = _pair(spark, sf_dir)
    return a.intersect(b)


@query("set_except", f"{_L} EXCEPT {_R}")
def _(spark, sf_dir):
    a, b = _pair(spark, sf_dir)
    return a.subtract(b)


@query("cte", "WITH big AS (SELECT user_id, sum(value) AS s FROM events GROUP BY 1), avg_big AS (SELECT avg(s) AS a FROM big) SELECT user_id, round(s, 4) AS s FROM big, avg_big WHERE s > a")
def _(spark, sf_dir):
    big = _events(spark, sf_dir).groupBy("user_id").agg(F.sum("value").alias("s"))
    return big.join(F.broadcast(big.agg(F.avg("s").alias("a"))), F.col("s") > F.col("a")).select("user_id", F.round("s", 4).alias("s"))  # one row


# 2.11 composites, on each user's events as one instrument's readings

_SECONDS = "CAST(floor(epoch(ts)) AS BIGINT)"
_CYCLES = f"""WITH e AS (SELECT user_id, event_id, ts, value, {_SECONDS} AS s, CASE WHEN value > 42 THEN 1 ELSE 0 END AS drawing FROM events),
g AS (SELECT *, CASE WHEN drawing = 1 AND coalesce(lag(drawing) OVER (PARTITION BY user_id ORDER BY ts, event_id), 0) = 0 THEN 1 ELSE 0 END AS edge FROM e),
c AS (SELECT *, sum(edge) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS cycle FROM g)"""


def cycles(spark, sf_dir, threshold=42):
    """Events numbered by the cycle that the last rise over the threshold began."""
    drawing = F.when(F.col("value") > threshold, 1).otherwise(0)
    e = _events(spark, sf_dir).select("user_id", "event_id", "ts", "value", epoch_seconds(F.col("ts")).alias("s"), drawing.alias("drawing"))
    e = e.withColumn("edge", F.when((F.col("drawing") == 1) & (F.coalesce(F.lag("drawing").over(own()), F.lit(0)) == 0), 1).otherwise(0))
    return e.withColumn("cycle", F.sum("edge").over(own().rowsBetween(Window.unboundedPreceding, 0)))


@query("q_drawdown_by_month", _CYCLES + """, a AS (SELECT *, first_value(s) OVER (PARTITION BY user_id, cycle ORDER BY ts, event_id) AS s0, first_value(value) OVER (PARTITION BY user_id, cycle ORDER BY ts, event_id) AS v0 FROM c WHERE cycle > 0)
SELECT month(ts) AS month, (s - s0) // 3600 AS elapsed_h, CAST(count(*) AS BIGINT) AS n, round(quantile_cont(v0 - value, 0.1), 4) AS p10, round(quantile_cont(v0 - value, 0.5), 4) AS p50, round(quantile_cont(v0 - value, 0.9), 4) AS p90 FROM a WHERE s - s0 <= 72000 GROUP BY 1, 2""")
def _(spark, sf_dir):
    w = Window.partitionBy("user_id", "cycle").orderBy("ts", "event_id")
    a = cycles(spark, sf_dir).where("cycle > 0").withColumns({"s0": F.first_value("s").over(w), "v0": F.first_value("value").over(w)}).where("s - s0 <= 72000")
    down = F.col("v0") - F.col("value")
    return a.groupBy(F.month("ts").cast("long").alias("month"), F.expr("(s - s0) div 3600").alias("elapsed_h")).agg(F.count(F.lit(1)).alias("n"), *[F.round(F.percentile(down, p), 4).alias(f"p{int(p * 100)}") for p in (0.1, 0.5, 0.9)])


@query("q_horner_by_month", _CYCLES + """, a AS (SELECT *, first_value(s) OVER (PARTITION BY user_id, cycle ORDER BY value, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS trough, min(s) OVER (PARTITION BY user_id, cycle) AS s0 FROM c WHERE cycle > 0),
b AS (SELECT month(ts) AS month, floor(log10((s - s0) * 1.0 / (s - trough)) / 0.05) AS bin, value FROM a WHERE s > trough AND s > s0)
SELECT month, CAST(bin AS BIGINT) AS bin, CAST(count(*) AS BIGINT) AS n, round(quantile_cont(value, 0.5), 4) AS p50 FROM b GROUP BY 1, 2""")
def _(spark, sf_dir):
    cycle = Window.partitionBy("user_id", "cycle")
    full = cycle.orderBy("value", "event_id").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    a = cycles(spark, sf_dir).where("cycle > 0").withColumns({"trough": F.first_value("s").over(full), "s0": F.min("s").over(cycle)}).where("s > trough and s > s0")
    bin_ = F.floor(F.log10((F.col("s") - F.col("s0")) * 1.0 / (F.col("s") - F.col("trough"))) / 0.05)
    return a.groupBy(F.month("ts").cast("long").alias("month"), bin_.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.round(F.percentile("value", 0.5), 4).alias("p50"))


@query("q_pump_quality", _CYCLES + ", q AS (SELECT user_id, cycle FROM c WHERE cycle > 0 GROUP BY 1, 2 HAVING count(*) >= 3 AND max(value) > 60), r AS (SELECT user_id, cycle FROM c GROUP BY 1, 2 HAVING max(s) - min(s) < 200000) SELECT c.user_id, CAST(c.cycle AS BIGINT) AS cycle, CAST(count(*) AS BIGINT) AS n FROM c JOIN q ON c.user_id = q.user_id AND c.cycle = q.cycle JOIN r ON c.user_id = r.user_id AND c.cycle = r.cycle GROUP BY 1, 2")
def _(spark, sf_dir):
    per = cycles(spark, sf_dir).groupBy("user_id", "cycle").agg(F.count(F.lit(1)).alias("n"), F.max("value").alias("top"), (F.max("s") - F.min("s")).alias("span"))
    return per.where("cycle > 0 and n >= 3 and top > 60 and span < 200000").select("user_id", "cycle", "n")


@query("q_duty_cycle", _CYCLES + ", p AS (SELECT user_id, cycle, min(s) AS s0, max(CASE WHEN drawing = 1 THEN s END) AS s1 FROM c WHERE cycle > 0 GROUP BY 1, 2), n AS (SELECT *, lead(s0) OVER (PARTITION BY user_id ORDER BY cycle) AS nx FROM p) SELECT user_id, CAST(cycle AS BIGINT) AS cycle, round((s1 - s0) * 1.0 / nullif(nx - s0, 0), 6) AS duty FROM n WHERE nx IS NOT NULL")
def _(spark, sf_dir):
    p = cycles(spark, sf_dir).where("cycle > 0").groupBy("user_id", "cycle").agg(F.min("s").alias("s0"), F.max(F.when(F.col("drawing") == 1, F.col("s"))).alias("s1"))
    n = p.withColumn("nx", F.lead("s0").over(Window.partitionBy("user_id").orderBy("cycle"))).where("nx is not null")
    return n.select("user_id", "cycle", F.round((F.col("s1") - F.col("s0")).cast("double") / F.nullif((F.col("nx") - F.col("s0")).cast("double"), F.lit(0.0)), 6).alias("duty"))


@query("q_pageviews_hourly", "SELECT time_bucket(INTERVAL '1 hour', ts, TIMESTAMP '1970-01-01') AS hour, event_type AS path, CAST(count(*) AS BIGINT) AS hits, CAST(count(DISTINCT user_id) AS BIGINT) AS visitors FROM events WHERE event_type NOT LIKE 'err%' GROUP BY 1, 2")
def _(spark, sf_dir):
    return _events(spark, sf_dir).where(~F.col("event_type").like("err%")).groupBy(F.window("ts", "1 hour")["start"].alias("hour"), F.col("event_type").alias("path")).agg(F.count(F.lit(1)).alias("hits"), F.count_distinct("user_id").alias("visitors"))


@query("q_status_class", "SELECT time_bucket(INTERVAL '1 hour', ts, TIMESTAMP '1970-01-01') AS hour, CASE WHEN value < 20 THEN 'low' WHEN value < 100 THEN 'mid' ELSE 'high' END AS class, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY 1, 2")
def _(spark, sf_dir):
    kind = F.when(F.col("value") < 20, "low").when(F.col("value") < 100, "mid").otherwise("high")
    return _events(spark, sf_dir).groupBy(F.window("ts", "1 hour")["start"].alias("hour"), kind.alias("class")).agg(F.count(F.lit(1)).alias("n"))


@query("q_referrers_daily", "SELECT page_id % 7 AS day, CASE WHEN url IS NULL OR url = '-' THEN '(direct)' ELSE regexp_replace(url, '^https?://(www\\.)?([^/]+)/.*$', '\\2') END AS domain, CAST(count(*) AS BIGINT) AS visits FROM pages GROUP BY 1, 2")
def _(spark, sf_dir):
    domain = F.when(F.col("url").isNull() | (F.col("url") == "-"), "(direct)").otherwise(F.regexp_replace("url", "^https?://(www\\.)?([^/]+)/.*$", "$2"))
    return table(spark, sf_dir, "pages").groupBy((F.col("page_id") % 7).alias("day"), domain.alias("domain")).agg(F.count(F.lit(1)).alias("visits"))


@query("q_journal_status", "SELECT user_id, arg_max(props, event_id) FILTER (event_type <> 'error') AS last_ok, arg_max(props, event_id) FILTER (event_type = 'error') AS last_error, arg_max(event_id, struct_pack(v := value, e := event_id)) AS peak, max(ts) AS last_seen FROM events GROUP BY 1")
def _(spark, sf_dir):
    error = F.col("event_type") == "error"
    return _events(spark, sf_dir).groupBy("user_id").agg(
        F.max_by("props", F.when(~error, F.col("event_id"))).alias("last_ok"), F.max_by("props", F.when(error, F.col("event_id"))).alias("last_error"),
        F.max_by("event_id", F.struct("value", "event_id")).alias("peak"), F.max("ts").alias("last_seen"),
    )


@query("q_journal_tail", "SELECT * FROM (SELECT event_id, ts, event_type FROM events WHERE event_type LIKE '%r%' ORDER BY ts DESC, event_id DESC LIMIT 50) ORDER BY ts")
def _(spark, sf_dir):
    return _events(spark, sf_dir).where("event_type like '%r%'").select("event_id", "ts", "event_type").orderBy(F.desc("ts"), F.desc("event_id")).limit(50).orderBy("ts")


@query("q_txn_recent", "WITH recent AS (SELECT o_custkey FROM orders GROUP BY 1 HAVING max(o_orderdate) >= TIMESTAMP '2001-07-01') SELECT o_custkey, min(o_orderdate) AS first_at, CAST(count(*) FILTER (o_orderstatus = 'F') AS BIGINT) AS failed FROM orders WHERE o_custkey IN (SELECT o_custkey FROM recent) GROUP BY 1")
def _(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.max("o_orderdate").alias("last"), F.min("o_orderdate").alias("first_at"), F.count_if(F.col("o_orderstatus") == "F").alias("failed")).where("last >= timestamp_ntz'2001-07-01'").drop("last")


@query("q_txn_ops", "SELECT l_orderkey, CAST(count(*) AS BIGINT) AS ops, CAST(count(DISTINCT l_suppkey) AS BIGINT) AS nodes, CAST(count(DISTINCT CASE WHEN l_returnflag = 'R' THEN l_partkey END) AS BIGINT) AS removed FROM lineitem GROUP BY 1")
def _(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("ops"), F.count_distinct("l_suppkey").alias("nodes"), F.count_distinct(F.when(F.col("l_returnflag") == "R", F.col("l_partkey"))).alias("removed"))


@query("q_partition_stats", "SELECT o_orderpriority, CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (o_orderstatus = 'O') AS BIGINT) AS n_open, round(sum(CASE WHEN o_totalprice > 200000 THEN o_totalprice ELSE 0 END), 2) AS big FROM orders GROUP BY 1")
def _(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("o_orderstatus") == "O").alias("n_open"), F.round(F.sum(F.when(F.col("o_totalprice") > 200000, F.col("o_totalprice")).otherwise(0)), 2).alias("big"))


@query("q_collapsible", "SELECT o.o_custkey, CAST(count(*) AS BIGINT) AS live FROM orders o JOIN (SELECT o_custkey, max(CASE WHEN o_orderstatus = 'F' THEN o_orderkey ELSE 0 END) AS through FROM orders GROUP BY 1) t ON o.o_custkey = t.o_custkey WHERE o.o_orderkey > t.through GROUP BY 1 HAVING count(*) > 2")
def _(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    through = o.groupBy("o_custkey").agg(F.max(F.when(F.col("o_orderstatus") == "F", F.col("o_orderkey")).otherwise(0)).alias("through"))
    return o.join(through, "o_custkey").where("o_orderkey > through").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("live")).where("live > 2")


# 2.12 overlaps


def _timeline(spark, sf_dir):
    e = by_type(spark, sf_dir, "ts")
    return overlap.timeline({t: e[t] for t in ("click", "view")}, "ts")


@query("ov_timeline", "SELECT event_type AS origin, ts AS time FROM events WHERE event_type IN ('click', 'view')")
def _(spark, sf_dir):
    return _timeline(spark, sf_dir)


@query("ov_stats", "SELECT event_type AS origin, CAST(count(*) AS BIGINT) AS n, min(ts) AS first_time, max(ts) AS last_time FROM events WHERE event_type IN ('click', 'view') GROUP BY 1")
def _(spark, sf_dir):
    return _timeline(spark, sf_dir).groupBy("origin").agg(F.count(F.lit(1)).alias("n"), F.min("time").alias("first_time"), F.max("time").alias("last_time"))


@query("ov_runs", "WITH p AS (SELECT user_id, event_type AS origin, ts, event_id, CASE WHEN lag(event_type) OVER w = event_type THEN 0 ELSE 1 END AS nw FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), r AS (SELECT *, sum(nw) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM p) SELECT user_id, CAST(run AS BIGINT) AS run, origin, min(ts) AS first_time, max(ts) AS last_time, CAST(count(*) AS BIGINT) AS n FROM r GROUP BY 1, 2, 3")
def _(spark, sf_dir):
    points = _events(spark, sf_dir).select("user_id", "event_id", F.col("event_type").alias("origin"), F.col("ts").alias("time"))
    return overlap.runs(points, ["user_id"], ("time", "event_id"))


@query("ov_segments")
def _(spark, sf_dir):
    points = _events(spark, sf_dir).select("user_id", (epoch_seconds(F.col("ts")) * 1000).alias("ms"), F.col("event_type").alias("origin"))
    return overlap.segments(points, "user_id", "ms", 3_600_000)


# 2.16 scalar functions


@query("fn_date_time", "SELECT event_id, date_trunc('day', ts) AS d, CAST(date_part('quarter', ts) AS INTEGER) AS q, CAST(month(ts) AS INTEGER) AS m, CAST(floor(epoch(ts)) AS BIGINT) AS s FROM events")
def _(spark, sf_dir):
    ts = F.col("ts")
    return _events(spark, sf_dir).select("event_id", F.date_trunc("day", ts).cast("timestamp_ntz").alias("d"), F.date_part(F.lit("quarter"), ts).cast("int").alias("q"), F.month(ts).alias("m"), epoch_seconds(ts).alias("s"))


@query("fn_conditional", "SELECT event_id, CASE WHEN value > 100 THEN 'high' WHEN value > 42 THEN 'mid' ELSE NULL END AS c, coalesce(nullif(event_type, 'view'), 'seen') AS t, value IS NOT NULL AS has FROM events")
def _(spark, sf_dir):
    v = F.col("value")
    return _events(spark, sf_dir).select("event_id", F.when(v > 100, "high").when(v > 42, "mid").alias("c"), F.coalesce(F.nullif("event_type", F.lit("view")), F.lit("seen")).alias("t"), v.isNotNull().alias("has"))


@query("fn_string", "SELECT event_id, lpad(CAST(user_id AS VARCHAR), 6, '0') AS u, event_type || '-' || user_id AS k, event_type LIKE '%i%' AS i FROM events")
def _(spark, sf_dir):
    u = F.col("user_id").cast("string")
    return _events(spark, sf_dir).select("event_id", F.lpad(u, 6, "0").alias("u"), F.concat("event_type", F.lit("-"), u).alias("k"), F.col("event_type").like("%i%").alias("i"))


def _log10(x):
    """As the SQL has it: minus infinity of zero, NaN below zero, where Spark's is null."""
    return F.when(x > 0, F.log10(x)).when(x == 0, float("-inf")).when(x < 0, float("nan"))


def _rounded(x, digits):
    """As the SQL rounds: the scaled double, halves away from zero; Spark's rounds the shortest decimal that stands for x."""
    scaled = x * float(10**digits)
    near = F.rint(scaled)
    out = F.when(F.abs(scaled - near) == 0.5, scaled + F.signum(scaled) * 0.5).otherwise(near) / float(10**digits)
    return F.when(F.isnan(scaled) | (F.abs(scaled) == float("inf")), x).otherwise(out)


@query("fn_math", "SELECT event_id, round(log10(value), 6) AS l, abs(value - 50) AS a, round(value * 9.0 / 5.0 + 32.0, 4) AS f FROM events")
def _(spark, sf_dir):
    v = F.col("value")
    return _events(spark, sf_dir).select("event_id", _rounded(_log10(v), 6).alias("l"), F.abs(v - 50).alias("a"), _rounded(v * 9.0 / 5.0 + 32.0, 4).alias("f"))


@query("fn_json", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, json_extract_string(props, '$.none') AS none FROM events")
def _(spark, sf_dir):
    return _events(spark, sf_dir).select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"), F.get_json_object("props", "$.none").alias("none"))


@query("fn_cast", "SELECT event_id, TRY_CAST(event_type AS INTEGER) AS bad, CAST(user_id AS VARCHAR) AS s, CAST(trunc(value) AS BIGINT) AS whole FROM events")
def _(spark, sf_dir):
    return _events(spark, sf_dir).select("event_id", F.col("event_type").try_cast("int").alias("bad"), F.col("user_id").cast("string").alias("s"), F.col("value").cast("long").alias("whole"))


@query("fn_array", "SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE))), 4) AS sq, len(embedding)::INTEGER AS n FROM embeddings")
def _(spark, sf_dir):
    sq = F.aggregate(F.transform("embedding", lambda x: x.cast("double") * x.cast("double")), F.lit(0.0), lambda a, x: a + x)
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(sq, 4).alias("sq"), F.size("embedding").alias("n"))
