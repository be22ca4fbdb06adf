"""Projections, joins of series, temporal reduction and rollups."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from strandline.catalog import query
from strandline.catalog.sources import TYPES, by_type
from strandline.operators import joins, transforms
from strandline.operators.transforms import column
from strandline.plans import reduce, rollup, scratch
from strandline.plans.scratch import table

BUCKET = "time_bucket(INTERVAL '{}', ts, TIMESTAMP '1970-01-01')"
HOUR = BUCKET.format("1 hour")

# 2.4 projections


@query("rename_direct", "SELECT event_id AS id, value AS reading, user_id FROM events")
def _(spark, sf_dir):
    rules = [{"type": "direct", "from": "event_id", "to": "id"}, {"type": "direct", "from": "value", "to": "reading"}]
    return transforms.rename(table(spark, sf_dir, "events").select("event_id", "value", "user_id"), rules)


@query("rename_pattern", "SELECT l_orderkey AS orderkey, l_tax AS tax_l, l_discount AS discount FROM lineitem")
def _(spark, sf_dir):
    rules = [{"type": "pattern", "pattern": "^l_(t.*)$", "replacement": "$1_l"}, {"type": "pattern", "pattern": "^l_", "replacement": ""}]
    return transforms.rename(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_tax", "l_discount"), rules)


@query("rename_cast", "SELECT CAST(event_id AS VARCHAR) AS id, CAST(user_id AS INTEGER) AS u, CAST(value AS BIGINT) AS v FROM (SELECT event_id, user_id, floor(value) AS value FROM events)")
def _(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "user_id", F.floor("value").cast("double").alias("value"))
    return transforms.rename(e, [{"type": "direct", "from": "event_id", "to": "id", "cast": "utf8"}, {"type": "direct", "from": "user_id", "to": "u", "cast": "int32"}, {"type": "direct", "from": "value", "to": "v", "cast": "int64"}])


@query("rename_pushdown", "SELECT l_orderkey AS k, l_quantity AS q FROM lineitem WHERE l_quantity > 45")
def _(spark, sf_dir):
    return transforms.rename(table(spark, sf_dir, "lineitem"), [{"type": "direct", "from": "l_orderkey", "to": "k"}, {"type": "direct", "from": "l_quantity", "to": "q"}]).where("q > 45").select("k", "q")


@query("scope_prefix", 'SELECT ts, value AS "site.value", user_id AS "site.user_id" FROM events')
def _(spark, sf_dir):
    return transforms.scope(table(spark, sf_dir, "events").select("ts", "value", "user_id"), "site", "ts")


@query("null_padding", "SELECT event_id, value, NULL::DOUBLE AS humidity, NULL::VARCHAR AS note FROM events")
def _(spark, sf_dir):
    return transforms.pad(table(spark, sf_dir, "events").select("event_id", "value"), {"value": "double", "humidity": "double", "note": "string"})


@query("temporal_bounds_filter", "SELECT event_id, ts FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-10' AND TIMESTAMP '2024-01-12 12:00:00'")
def _(spark, sf_dir):
    return transforms.within(table(spark, sf_dir, "events").select("event_id", "ts"), "ts", "2024-01-10 00:00:00", "2024-01-12 12:00:00")


@query("temporal_bounds_batch", "SELECT event_id, CAST(floor(epoch(ts)) AS BIGINT) AS s FROM events WHERE CAST(floor(epoch(ts)) AS BIGINT) >= 1705000000")
def _(spark, sf_dir):
    from strandline.functions.timebin import epoch_seconds

    return transforms.within(table(spark, sf_dir, "events").select("event_id", epoch_seconds(F.col("ts")).alias("s")), "s", 1705000000)


@query("transform_chain", 'SELECT ts, value AS "a.reading", NULL::DOUBLE AS extra FROM events WHERE value > 42')
def _(spark, sf_dir):
    steps = [lambda d: d.where("value > 42"), lambda d: transforms.rename(d, [{"type": "direct", "from": "value", "to": "reading"}]), lambda d: transforms.scope(d, "a", "ts"), lambda d: transforms.pad(d, {"extra": "double"})]
    return transforms.chain(table(spark, sf_dir, "events").select("ts", "value"), steps)


# 2.5 joins


def _hourly(spark, sf_dir):
    return {t: df.groupBy(F.window("ts", "1 hour")["start"].alias("timestamp")).agg(F.max("value").alias("v")) for t, df in by_type(spark, sf_dir, "ts", "value").items()}


def _sql_hourly(t):
    return f"(SELECT {HOUR} AS t, max(value) AS v FROM events WHERE event_type = '{t}' GROUP BY 1)"


@query("ts_join", f'SELECT coalesce(a.t, b.t, c.t) AS timestamp, a.v AS "a.v", b.v AS "b.v", c.v AS "c.v" FROM {_sql_hourly("click")} a FULL OUTER JOIN {_sql_hourly("error")} b ON a.t = b.t FULL OUTER JOIN {_sql_hourly("signup")} c ON a.t = c.t')
def _(spark, sf_dir):
    h = _hourly(spark, sf_dir)
    return joins.series_join([{"df": h["signup"], "scope": "c"}, {"df": h["click"], "scope": "a"}, {"df": h["error"], "scope": "b"}])


@query("ts_join_coalesced", f'SELECT t AS timestamp, a.v AS "a.v", b.v AS "b.v", c.v AS "c.v" FROM {_sql_hourly("click")} a FULL OUTER JOIN {_sql_hourly("error")} b USING (t) FULL OUTER JOIN {_sql_hourly("signup")} c USING (t)')
def _(spark, sf_dir):
    h = _hourly(spark, sf_dir)
    return joins.series_join([{"df": h["click"], "scope": "a"}, {"df": h["error"], "scope": "b"}, {"df": h["signup"], "scope": "c"}], align="coalesce")


@query("ts_join_range", f'SELECT coalesce(a.t, b.t) AS timestamp, a.v AS "a.v", b.v AS "b.v" FROM (SELECT * FROM {_sql_hourly("click")} WHERE t >= TIMESTAMP \'2024-01-03\' AND t <= TIMESTAMP \'2024-01-09\') a FULL OUTER JOIN (SELECT * FROM {_sql_hourly("view")} WHERE t <= TIMESTAMP \'2024-01-05\') b ON a.t = b.t')
def _(spark, sf_dir):
    h = _hourly(spark, sf_dir)
    return joins.series_join([{"df": h["click"], "scope": "a", "begin": "2024-01-03 00:00:00", "end": "2024-01-09 00:00:00"}, {"df": h["view"], "scope": "b", "end": "2024-01-05 00:00:00"}])


@query("ts_join_same_scope", f"""WITH a AS (SELECT t, v, NULL::DOUBLE AS w FROM {_sql_hourly("click")} WHERE t <= TIMESTAMP '2024-01-10' UNION SELECT t, v, v * 2 AS w FROM {_sql_hourly("click")} WHERE t >= TIMESTAMP '2024-01-10')
SELECT coalesce(a.t, b.t) AS timestamp, a.v AS "a.v", a.w AS "a.w", b.v AS "b.v" FROM a FULL OUTER JOIN {_sql_hourly("view")} b ON a.t = b.t""")
def _(spark, sf_dir):
    h = _hourly(spark, sf_dir)
    first = {"df": h["click"], "scope": "a", "end": "2024-01-10 00:00:00"}
    second = {"df": h["click"], "scope": "a", "begin": "2024-01-10 00:00:00", "transforms": [lambda d: d.withColumn("w", F.col("v") * 2)]}
    return joins.series_join([first, second, {"df": h["view"], "scope": "b"}])


@query("ts_join_empty", f'SELECT t AS timestamp, v AS "a.v", NULL::DOUBLE AS "b.v" FROM {_sql_hourly("click")}')
def _(spark, sf_dir):
    h = _hourly(spark, sf_dir)
    return joins.series_join([{"df": h["click"], "scope": "a"}, {"df": h["view"].where("false"), "scope": "b"}])


@query("ts_pivot", f'WITH s AS (SELECT t FROM {_sql_hourly("click")} UNION SELECT t FROM {_sql_hourly("error")}) SELECT s.t AS timestamp, a.v AS "click.v", NULL::DOUBLE AS "click.w", b.v AS "error.v", NULL::DOUBLE AS "error.w" FROM s LEFT JOIN {_sql_hourly("click")} a ON s.t = a.t LEFT JOIN {_sql_hourly("error")} b ON s.t = b.t')
def _(spark, sf_dir):
    h = _hourly(spark, sf_dir)
    return joins.series_pivot({"click": h["click"], "error": h["error"]}, ["v", "w"])


@query("full_outer_coalesce", "SELECT coalesce(a.user_id, b.user_id) AS user_id, a.n AS n_click, b.n AS n_error FROM (SELECT user_id, CAST(count(*) AS BIGINT) AS n FROM events WHERE event_type = 'click' AND value > 100 GROUP BY 1) a FULL OUTER JOIN (SELECT user_id, CAST(count(*) AS BIGINT) AS n FROM events WHERE event_type = 'error' AND value > 100 GROUP BY 1) b ON a.user_id = b.user_id")
def _(spark, sf_dir):
    n = lambda t: by_type(spark, sf_dir, "user_id", "value")[t].where("value > 100").groupBy("user_id").agg(F.count(F.lit(1)).alias(f"n_{t}"))
    return n("click").join(n("error"), "user_id", "full")


@query("inner_join_filter_chain", "SELECT e.event_id, e.user_id FROM events e WHERE user_id IN (SELECT user_id FROM events GROUP BY user_id HAVING count(*) > 60) AND user_id IN (SELECT user_id FROM events GROUP BY user_id HAVING max(value) > 300)")
def _(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    ok = e.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.max("value").alias("top")).where("n > 60 and top > 300")
    return e.select("event_id", "user_id").join(ok, "user_id", "left_semi")


@query("in_subquery", "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def _(spark, sf_dir):
    c = table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return o.join(c, F.col("o_custkey") == F.col("c_custkey"), "left_semi")


@query("agg_join_back", "SELECT o.o_custkey, o.o_orderkey FROM orders o JOIN (SELECT o_custkey, max(o_orderkey) AS m FROM orders GROUP BY 1 HAVING count(*) > 5) x ON o.o_custkey = x.o_custkey AND o.o_orderkey = x.m")
def _(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.max("o_orderkey").alias("o_orderkey"), F.count(F.lit(1)).alias("n")).where("n > 5").drop("n")


@query("lookup_join", "SELECT s_suppkey, coalesce(n_name, '(unknown)') AS nation FROM supplier LEFT JOIN (SELECT * FROM nation WHERE n_nationkey < 20) ON s_nationkey = n_nationkey")
def _(spark, sf_dir):
    n = table(spark, sf_dir, "nation").where("n_nationkey < 20")
    return table(spark, sf_dir, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey"), "left").select("s_suppkey", F.coalesce("n_name", F.lit("(unknown)")).alias("nation"))


CYCLES = "(SELECT CAST(i AS INTEGER) AS cycle_id, CAST(DATE '1995-01-01' + to_months(CAST(3 * i AS INTEGER)) AS DATE) AS period_start, CAST(DATE '1995-01-01' + to_months(CAST(3 * i + 3 AS INTEGER)) - INTERVAL 1 DAY AS DATE) AS period_end FROM range(0, 24) r(i))"


def cycles(spark):
    start = F.expr("add_months(date'1995-01-01', cast(3 * id as int))")
    return spark.range(24).select(F.col("id").cast("int").alias("cycle_id"), start.alias("period_start"), F.date_sub(F.add_months(start, 3), 1).alias("period_end"))


@query("interval_join_asof_cycle", f"SELECT o_orderkey, cycle_id FROM orders LEFT JOIN {CYCLES} c ON CAST(o_orderdate AS DATE) BETWEEN period_start AND period_end")
def _(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("day"))
    return joins.valid_on(o, "day", cycles(spark), "period_start", "period_end").select("o_orderkey", "cycle_id")


@query("next_row_join", f"SELECT a.cycle_id, (SELECT min(b.period_start) FROM {CYCLES} b WHERE b.period_start > a.period_end) AS next_start FROM {CYCLES} a")
def _(spark, sf_dir):
    return cycles(spark).select("cycle_id", F.lead("period_start").over(Window.orderBy("period_start")).alias("next_start"))


RULES = "(SELECT CAST(i AS INTEGER) AS rule_id, CAST(DATE '1995-01-01' + to_months(CAST(10 * i AS INTEGER)) AS DATE) AS effective_from, CASE WHEN i % 2 = 0 THEN CAST(DATE '1995-01-01' + to_months(CAST(10 * i + 14 AS INTEGER)) AS DATE) END AS effective_to FROM range(0, 7) r(i))"


def rules(spark):
    start = F.expr("add_months(date'1995-01-01', cast(10 * id as int))")
    return spark.range(7).select(F.col("id").cast("int").alias("rule_id"), start.alias("effective_from"), F.when(F.col("id") % 2 == 0, F.add_months(start, 14)).alias("effective_to"))


@query("effective_dated_join", f"SELECT o_orderkey, rule_id FROM (SELECT o_orderkey, rule_id, row_number() OVER (PARTITION BY o_orderkey ORDER BY effective_from DESC NULLS LAST) AS rn FROM orders LEFT JOIN {RULES} r ON effective_from <= CAST(o_orderdate AS DATE) AND (effective_to IS NULL OR CAST(o_orderdate AS DATE) <= effective_to)) WHERE rn = 1")
def _(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("day"))
    return joins.as_of(o, "day", rules(spark), "effective_from", "effective_to", ["o_orderkey"]).select("o_orderkey", "rule_id")


TENANCIES = "(SELECT s_suppkey AS connection_id, s_suppkey % 7 AS customer_id, CAST(DATE '1995-01-01' + to_days(CAST(s_suppkey * 11 % 900 AS INTEGER)) AS DATE) AS start_date, CASE WHEN s_suppkey % 3 > 0 THEN CAST(DATE '1995-01-01' + to_days(CAST(s_suppkey * 11 % 900 + 400 AS INTEGER)) AS DATE) END AS end_date FROM supplier)"


def tenancies(spark, sf_dir):
    s = F.col("s_suppkey")
    start = F.date_add(F.lit("1995-01-01").cast("date"), (s * 11 % 900).cast("int"))
    return table(spark, sf_dir, "supplier").select(s.alias("connection_id"), (s % 7).alias("customer_id"), start.alias("start_date"), F.when(s % 3 > 0, F.date_add(start, 400)).alias("end_date"))


@query("validity_join", f"SELECT l_orderkey, l_linenumber, l_suppkey, customer_id FROM lineitem JOIN {TENANCIES} t ON l_suppkey = connection_id AND start_date <= CAST(l_shipdate AS DATE) AND (end_date IS NULL OR CAST(l_shipdate AS DATE) <= end_date)")
def _(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", F.col("l_suppkey").alias("connection_id"), F.col("l_shipdate").cast("date").alias("day"))
    return joins.valid_on(li, "day", tenancies(spark, sf_dir), "start_date", "end_date", ["connection_id"], how="inner").select("l_orderkey", "l_linenumber", "l_suppkey", "customer_id")


@query("anti_join_refs", "SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def _(spark, sf_dir):
    o, li = table(spark, sf_dir, "orders").select("o_orderkey"), table(spark, sf_dir, "lineitem")
    return o.join(li, F.col("o_orderkey") == F.col("l_orderkey"), "left_anti")


@query("self_range_join", f"SELECT a.customer_id, a.connection_id AS a_id, b.connection_id AS b_id FROM {TENANCIES} a JOIN {TENANCIES} b ON a.customer_id = b.customer_id AND a.connection_id < b.connection_id AND greatest(a.start_date, b.start_date) <= least(coalesce(a.end_date, DATE '9999-01-01'), coalesce(b.end_date, DATE '9999-01-01'))")
def _(spark, sf_dir):
    return joins.overlapping(tenancies(spark, sf_dir), "customer_id", "connection_id", "start_date", "end_date")


@query("array_contains_anti", f"SELECT connection_id FROM {TENANCIES} WHERE start_date <= DATE '1996-06-01' AND (end_date IS NULL OR DATE '1996-06-01' < end_date) AND connection_id NOT IN (3, 7, 11)")
def _(spark, sf_dir):
    from strandline.operators import ledger

    t = tenancies(spark, sf_dir).withColumnsRenamed({"start_date": "first_active", "end_date": "last_active"})
    return ledger.active(t, F.lit("1996-06-01").cast("date"), F.array(*[F.lit(x).cast("long") for x in (3, 7, 11)])).select("connection_id")


@query("left_join_chain", f"SELECT a.t AS timestamp, a.v AS va, b.v AS vb, c.v AS vc FROM {_sql_hourly('view')} a LEFT JOIN {_sql_hourly('click')} b ON a.t = b.t LEFT JOIN {_sql_hourly('error')} c ON b.t = c.t")
def _(spark, sf_dir):
    """Each table joins on the time of the one before it."""
    h = {k: d.select(F.col("timestamp").alias(f"t{k}"), F.col("v").alias(f"v{k}")) for k, d in zip("abc", (_hourly(spark, sf_dir)[t] for t in ("view", "click", "error")), strict=True)}
    out = h["a"].join(h["b"], F.col("ta") == F.col("tb"), "left").join(h["c"], F.col("tb") == F.col("tc"), "left")
    return out.select(F.col("ta").alias("timestamp"), "va", "vb", "vc")


# 2.6 temporal reduction


def _events(spark, sf_dir):
    return table(spark, sf_dir, "events").select("ts", "value", "user_id")


def _rounded(df, *names):
    # Averages of cents over up to a few hundred rows have exact halves at fewer digits, which engines round either way.
    return df.withColumns({n: F.round(column(n), 9 if n.endswith("avg") else 4) for n in names})


for _kind in reduce.AGGREGATES:
    _e = f"round({_kind}(value), {9 if _kind == 'avg' else 4})" if _kind in ("avg", "sum") else f"{_kind}(value)"

    def _one(spark, sf_dir, kind=_kind):
        out = reduce.single_pass(_events(spark, sf_dir), "ts", "1h", [{"type": kind, "columns": ["value"]}])
        return _rounded(out, f"value.{kind}") if kind in ("avg", "sum") else out

    query(f"tr_{_kind}", f'SELECT {HOUR} AS ts, {_e} AS "value.{_kind}" FROM events GROUP BY 1')(_one)


@query("tr_count_star", f'SELECT {BUCKET.format("6 hours")} AS ts, count(*) AS "timestamp.count" FROM events GROUP BY 1')
def _(spark, sf_dir):
    return reduce.single_pass(_events(spark, sf_dir), "ts", "6h", [{"type": "count", "columns": ["*"]}])


@query("tr_bucket", f'SELECT {BUCKET.format("4 hours")} AS ts, max(value) AS "value.max" FROM events GROUP BY 1')
def _(spark, sf_dir):
    return reduce.single_pass(_events(spark, sf_dir), "ts", "4 hours", [{"type": "max", "columns": ["v*"]}])


@query("tr_column_expand", f'SELECT {BUCKET.format("1 day")} AS ts, min(value) AS "value.min", min(user_id) AS "user_id.min", max(user_id) AS "user_id.max", count(value) AS "value.count" FROM events GROUP BY 1')
def _(spark, sf_dir):
    return reduce.single_pass(_events(spark, sf_dir), "ts", "1d", [{"type": "min"}, {"type": "max", "columns": ["*_id"]}, {"type": "count", "columns": ["v*", "value"]}])


@query("tr_output_names", f'SELECT {BUCKET.format("1 day")} AS ts, max(value) AS "value.max", min(value) AS "value.min", count(*) AS "timestamp.count" FROM events GROUP BY 1')
def _(spark, sf_dir):
    return reduce.single_pass(_events(spark, sf_dir), "ts", "1d", [{"type": "max", "columns": ["value"]}, {"type": "min", "columns": ["value"]}, {"type": "count", "columns": ["*"]}])


SPEC = [{"type": "count", "columns": ["*"]}, *({"type": k, "columns": ["value"]} for k in ("avg", "sum", "min", "max"))]
LEVELS = {"1h": "1 hour", "6h": "6 hours", "1d": "1 day"}


def _level_sql(name):
    b = BUCKET.format(LEVELS[name])
    return f"SELECT '{name}' AS resolution, {b} AS ts, count(*) AS \"timestamp.count\", round(avg(value), 9) AS \"value.avg\", round(sum(value), 4) AS \"value.sum\", min(value) AS \"value.min\", max(value) AS \"value.max\" FROM events GROUP BY {b}"


ALL_LEVELS = " UNION ALL ".join(_level_sql(n) for n in LEVELS)


def _levels(frames):
    return transforms.union_by_name([_rounded(df, "value.avg", "value.sum").select(F.lit(n).alias("resolution"), "*") for n, df in frames.items()])


@query("tr_multi_resolution", ALL_LEVELS)
def _(spark, sf_dir):
    return _levels(reduce.resolutions(_events(spark, sf_dir), "ts", list(LEVELS), SPEC, ordered=False))


@query("tr_partials", f'SELECT {HOUR} AS _bucket, count(*) AS "*#rows", round(sum(value), 4) AS "value#sum", count(value) AS "value#count" FROM events GROUP BY 1')
def _(spark, sf_dir):
    return _rounded(reduce.partials(_events(spark, sf_dir), "ts", "1h", [("count", "*"), ("avg", "value"), ("sum", "value")]), "value#sum")


@query("tr_partial_absent", f'SELECT {HOUR} AS ts, NULL::DOUBLE AS "gone.avg", CAST(0 AS BIGINT) AS "gone.count", max(value) AS "value.max" FROM events GROUP BY 1')
def _(spark, sf_dir):
    wanted = [("avg", "gone"), ("count", "gone"), ("max", "value")]
    return reduce.reconstruct(reduce.partials(_events(spark, sf_dir), "ts", "1h", wanted), wanted, "ts")


@query("tr_merge", f"SELECT {BUCKET.format('6 hours')} AS ts, round(avg(value), 9) AS \"value.avg\" FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-20' GROUP BY 1")
def _(spark, sf_dir):
    wanted = [("avg", "value")]
    parts = [reduce.partials(_events(spark, sf_dir).where(f"user_id % 3 = {k}"), "ts", "1h", wanted) for k in range(3)]
    merged = reduce.merge(transforms.union_by_name(parts), "6h", wanted, low=1704412800, high=1705708800)
    return _rounded(reduce.reconstruct(merged, wanted, "ts"), "value.avg")


@query("tr_reconstruct", _level_sql("1d").replace("'1d' AS resolution, ", ""))
def _(spark, sf_dir):
    wanted = reduce.expand(_events(spark, sf_dir), SPEC, "ts")
    return _rounded(reduce.reconstruct(reduce.partials(_events(spark, sf_dir), "ts", "1d", wanted), wanted, "ts"), "value.avg", "value.sum")


@query("tr_nesting_check", "SELECT * FROM (VALUES ('1h,6h,1d', '1h,6h,1d', NULL), ('1h,90m', NULL, '90m isn''t a multiple of 1h'), ('0s', NULL, 'resolutions must be a second or more')) t(asked, ordered, error)")
def _(spark, sf_dir):
    rows = []
    for names in (["1h", "6h", "1d"], ["1h", "90m"], ["0s"]):
        try:
            rows.append((",".join(names), ",".join(reduce.check_nesting(names)), None))
        except ValueError as e:
            rows.append((",".join(names), None, str(e)))
    return spark.createDataFrame(rows, "asked string, ordered string, error string")


@query("legacy_union_reduce", " UNION ALL ".join(f"SELECT '{t}' AS site, {BUCKET.format('1 day')} AS ts, round(avg(value), 9) AS a, min(value) AS lo, max(value) AS hi FROM events WHERE event_type = '{t}' GROUP BY 2" for t in TYPES))
def _(spark, sf_dir):
    parts = []
    for t, df in by_type(spark, sf_dir, "ts", "value").items():
        out = reduce.single_pass(df, "ts", "1d", [{"type": k} for k in ("avg", "min", "max")])
        parts.append(out.select(F.lit(t).alias("site"), "ts", F.round(column("value.avg"), 9).alias("a"), column("value.min").alias("lo"), column("value.max").alias("hi")))
    return transforms.union_by_name(parts)


@query("legacy_stitch", "SELECT ts, value FROM events WHERE event_type = 'click' AND ts >= (SELECT min(ts) FROM events WHERE event_type = 'click') AND ts < TIMESTAMP '2024-01-15' UNION ALL SELECT ts, value FROM events WHERE event_type = 'view' AND ts >= TIMESTAMP '2024-01-15' AND ts < (SELECT max(ts) FROM events WHERE event_type = 'view')")
def _(spark, sf_dir):
    """Files one after another, each up to where the next begins, the very last point left out."""
    e = by_type(spark, sf_dir, "ts", "value")
    last = e["view"].agg(F.max("ts").alias("last"))
    return e["click"].where("ts < timestamp_ntz'2024-01-15'").union(e["view"].where("ts >= timestamp_ntz'2024-01-15'").join(F.broadcast(last), F.col("ts") < F.col("last")).drop("last"))


# 2.7 rollups


def _versions(spark, sf_dir, n=4):
    """Disjoint slices of events in the order they would have arrived, as immutable versions."""
    e = _events(spark, sf_dir)
    return {f"v{k}": e.where(f"day(ts) > {8 * k} and day(ts) <= {8 * k + 8}") for k in range(n)}


def _rolled(spark, versions, lateness="1d", steps=None):
    r = rollup.Rollup(spark, scratch.folder(spark, "rollup"), "ts", list(LEVELS), SPEC, lateness)
    done = [r.build({k: versions[k] for k in part}) for part in (steps or [list(versions)])]
    return r, done


@query("st_cascade", ALL_LEVELS)
def _(spark, sf_dir):
    r, _ = _rolled(spark, _versions(spark, sf_dir))
    return _levels({n: r.read(n, ordered=False) for n in LEVELS})


@query("st_seal", _level_sql("6h"))
def _(spark, sf_dir):
    """Four builds, each with one version more: sealed runs and the hot part are the single pass."""
    v = _versions(spark, sf_dir)
    r, _ = _rolled(spark, v, steps=[list(v)[: k + 1] for k in range(len(v))])
    return _levels({"6h": r.read("6h", ordered=False)})


@query("st_hot", "SELECT '1h' AS resolution, CAST(count(*) AS BIGINT) AS n FROM (SELECT DISTINCT " + HOUR + " AS b FROM events) WHERE b >= (SELECT max(" + HOUR + ") - INTERVAL 1 DAY FROM events)")
def _(spark, sf_dir):
    r, _ = _rolled(spark, _versions(spark, sf_dir))
    return r._read([r.manifest()["levels"]["1h"]["hot"]]).agg(F.count(F.lit(1)).alias("n")).select(F.lit("1h").alias("resolution"), "n")


@query("st_version_partials", f"SELECT CAST(day(ts) - 1 AS BIGINT) // 8 AS version, CAST(count(DISTINCT {HOUR}) AS BIGINT) AS n FROM events GROUP BY 1")
def _(spark, sf_dir):
    v = _versions(spark, sf_dir)
    r, _ = _rolled(spark, v)
    known = r.manifest()["versions"]
    return transforms.union_by_name([r._read([known[f"v{k}"]]).agg(F.count(F.lit(1)).alias("n")).select(F.lit(k).cast("long").alias("version"), "n") for k in range(len(v))])


@query("st_watermark", "SELECT newest, lateness, step, (newest - lateness) // step * step AS sealed FROM (VALUES (100000::BIGINT, 86400::BIGINT, 3600::BIGINT), (7200, 0, 3600), (7199, 3600, 3600)) t(newest, lateness, step)")
def _(spark, sf_dir):
    rows = [(a, b, c, rollup.watermark(a, b, c)) for a, b, c in ((100000, 86400, 3600), (7200, 0, 3600), (7199, 3600, 3600))]
    return spark.createDataFrame(rows, "newest long, lateness long, step long, sealed long")


_SEALED = "(SELECT epoch(max(" + HOUR + "))::BIGINT - {0} FROM events WHERE day(ts) BETWEEN 17 AND 24)"


@query(
    "st_late_reject",
    "SELECT lateness, CASE WHEN (SELECT epoch(min(" + HOUR + "))::BIGINT FROM events WHERE day(ts) <= 8) < " + _SEALED.format("s") + " THEN 'refused' ELSE 'incremental' END AS outcome FROM (VALUES ('1d', 86400), ('60d', 5184000)) t(lateness, s)",
)
def _(spark, sf_dir):
    """Older data after newer: behind the watermark it is refused, with more lateness it is taken in."""
    v, rows = _versions(spark, sf_dir), []
    for lateness in ("1d", "60d"):
        r, _ = _rolled(spark, {"a": v["v2"]}, lateness)
        try:
            rows.append((lateness, r.build({"a": v["v2"], "b": v["v0"]})))
        except rollup.LateData:
            rows.append((lateness, "refused"))
    return spark.createDataFrame(rows, "lateness string, outcome string")


@query("st_plan", "SELECT * FROM (VALUES (0, 'rebuild'), (1, 'reuse'), (2, 'incremental'), (3, 'rebuild'), (4, 'rebuild'), (5, 'rebuild')) t(build, outcome)")
def _(spark, sf_dir):
    """The same members, more of them, others; then another aggregate, and another resolution, on the same folder."""
    v = _versions(spark, sf_dir)
    r, done = _rolled(spark, v, steps=[["v0"], ["v0"], ["v0", "v1"], ["v1", "v2"]])
    most = [{"type": "max", "columns": ["value"]}]
    for levels, spec in ((list(LEVELS), most), (["2h"], most)):
        other = rollup.Rollup(spark, r.folder, "ts", levels, spec)
        done.append(other.build({k: v[k] for k in ("v1", "v2")}))
        assert other.read(levels[-1]).columns == ["ts", "value.max"]
    return spark.createDataFrame(list(enumerate(done)), "build int, outcome string")


@query("st_frontier", "SELECT * FROM (VALUES ('series', 'incremental'), ('snapshot that restates', 'refused'), ('snapshot that goes on', 'incremental')) t(versions, outcome)")
def _(spark, sf_dir):
    """Versions of a series add up in any order; a version that restates its file must begin where the last one ended."""
    e, rows = _events(spark, sf_dir), []
    first, again, on = (e.where(f"day(ts) between {a} and {b}") for a, b in ((1, 8), (8, 16), (10, 16)))
    for what, snapshots, second in (("series", False, again), ("snapshot that restates", True, again), ("snapshot that goes on", True, on)):
        r = rollup.Rollup(spark, scratch.folder(spark, "rollup"), "ts", ["1h"], SPEC, "20d", snapshots)
        r.build({"a": first})
        try:
            rows.append((what, r.build({"a": first, "b": second})))
        except rollup.OverlappingVersion:
            rows.append((what, "refused"))
    return spark.createDataFrame(rows, "versions string, outcome string")


@query("st_rollup_preconditions", _level_sql("1d") + " UNION ALL " + _level_sql("1d"))
def _(spark, sf_dir):
    """With a transform in the way, or without a folder, there is no rollup: one pass, the same answer as the rollup's."""
    v = _versions(spark, sf_dir)
    folder = scratch.folder(spark, "rollup")
    rolled = rollup.reduced(spark, v, "ts", "1d", SPEC, folder, scheme="csv")
    plain = rollup.reduced(spark, v, "ts", "1d", SPEC, f"{folder}-none", [lambda d: transforms.rename(d, [])], "csv")
    store = scratch.Store(spark, folder)
    assert store.exists("manifest.json") and not scratch.Store(spark, f"{folder}-none").exists("manifest.json")
    return _levels({"1d": rolled}).union(_levels({"1d": plain}))


@query(
    "st_manifest",
    "SELECT 2 AS format, 86400::BIGINT AS lateness, resolution, (newest - 86400) // step * step AS sealed_hi, n AS rows FROM (SELECT resolution, step, epoch(max(b))::BIGINT AS newest, count(DISTINCT b)::BIGINT AS n FROM (SELECT r.resolution, r.step, time_bucket(to_seconds(r.step), ts, TIMESTAMP '1970-01-01') AS b FROM events, (VALUES ('1h', 3600), ('6h', 21600), ('1d', 86400)) r(resolution, step)) GROUP BY 1, 2)",
)
def _(spark, sf_dir):
    """What the manifest says of each level after builds with one version more each."""
    v = _versions(spark, sf_dir)
    r, _ = _rolled(spark, v, steps=[list(v)[: k + 1] for k in range(len(v))])
    m = r.manifest()
    rows = [(m["format"], m["lateness"], n, lv["sealed_hi"], sum(x["rows"] for x in r._parts(lv))) for n, lv in m["levels"].items()]
    return spark.createDataFrame(rows, "format int, lateness long, resolution string, sealed_hi long, rows long")


@query("st_corrupt_check", "SELECT * FROM (VALUES ('hot part lost', 'refused'), ('file of a run lost', 'refused')) t(damage, outcome)")
def _(spark, sf_dir):
    """A file that is gone is an error, never a hole."""
    rows = []
    for what in ("hot part lost", "file of a run lost"):
        r, _ = _rolled(spark, {"a": _versions(spark, sf_dir)["v0"]})
        level = r.manifest()["levels"]["1h"]
        run = level["runs"][0]["file"]
        r.store.delete(level["hot"]["file"] if what[0] == "h" else f"{run}/{r.store.files(run)[0][0]}")
        try:
            r.read("1h")
            rows.append((what, "read"))
        except rollup.CorruptRollup:
            rows.append((what, "refused"))
    return spark.createDataFrame(rows, "damage string, outcome string")


@query("st_drop_cache", "SELECT * FROM (VALUES (true)) t(gone)")
def _(spark, sf_dir):
    r, _ = _rolled(spark, {"a": _versions(spark, sf_dir)["v0"]})
    r.drop()
    return spark.createDataFrame([(r.manifest() is None,)], "gone boolean")
