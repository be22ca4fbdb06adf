"""Plain aggregates, versions and integrity."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandline.catalog import query
from strandline.operators import integrity, transforms, versions
from strandline.plans.scratch import table


@query("agg_group_by", "SELECT l_returnflag, l_linestatus, CAST(count(*) AS BIGINT) AS n, round(sum(l_quantity), 2) AS sum_qty, round(avg(l_discount), 9) AS avg_disc FROM lineitem GROUP BY 1, 2")
def _(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.avg("l_discount"), 9).alias("avg_disc"))


@query("agg_having", "SELECT o_custkey, CAST(count(*) AS BIGINT) AS n FROM orders GROUP BY 1 HAVING count(*) > 12")
def _(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n")).where("n > 12")


@query("agg_distinct", "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
def _(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderstatus", "o_orderpriority").distinct()


@query("agg_count_distinct", "SELECT event_type, CAST(count(DISTINCT user_id) AS BIGINT) AS users FROM events GROUP BY 1")
def _(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count_distinct("user_id").alias("users"))


@query("agg_conditional", "SELECT o_custkey, max(CASE WHEN o_orderstatus = 'F' THEN o_orderdate END) AS last_f, CAST(count(*) FILTER (o_orderstatus = 'O') AS BIGINT) AS n_open, CAST(count(DISTINCT CASE WHEN o_totalprice > 100000 THEN o_orderpriority END) AS BIGINT) AS big_priorities FROM orders GROUP BY 1")
def _(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(
        F.max(F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate"))).alias("last_f"), F.count_if(F.col("o_orderstatus") == "O").alias("n_open"),
        F.count_distinct(F.when(F.col("o_totalprice") > 100000, F.col("o_orderpriority"))).alias("big_priorities"),
    )


@query("agg_first_by_order", "SELECT user_id, arg_max(event_type, event_id) AS last_type, max(event_id) AS last_id FROM events GROUP BY 1")
def _(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.max_by("event_type", "event_id").alias("last_type"), F.max("event_id").alias("last_id"))


@query("agg_approx_percentile", "SELECT event_type, round(quantile_cont(value, 0.1), 4) AS p10, round(quantile_cont(value, 0.5), 4) AS p50, round(quantile_cont(value, 0.9), 4) AS p90 FROM events GROUP BY 1")
def _(spark, sf_dir):
    """Exact, for comparison; `percentile_approx` is the bounded-memory form."""
    return table(spark, sf_dir, "events").groupBy("event_type").agg(*[F.round(F.percentile("value", p), 4).alias(f"p{int(p * 100)}") for p in (0.1, 0.5, 0.9)])


@query("agg_null_counts", "SELECT o_orderstatus, CAST(count(*) AS BIGINT) AS n_rows, CAST(count(*) - count(nullif(o_orderkey % 3, 0)) AS BIGINT) AS k_nulls, CAST(0 AS BIGINT) AS o_orderdate_nulls FROM orders GROUP BY 1")
def _(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderstatus", F.nullif(F.col("o_orderkey") % 3, F.lit(0).cast("long")).alias("k"), "o_orderdate")
    return versions.null_counts(o, ["o_orderstatus"])


@query("agg_min_max_count_span", "SELECT event_type, CAST(count(*) AS BIGINT) AS n, min(ts) AS first_time, max(ts) AS last_time FROM events GROUP BY 1")
def _(spark, sf_dir):
    return versions.bounds(table(spark, sf_dir, "events"), "ts", ["event_type"])


_SETS = "SELECT l_returnflag, l_linestatus, CAST(count(*) AS BIGINT) AS n, round(sum(l_quantity), 2) AS q FROM lineitem GROUP BY "


def _lineitem(spark, sf_dir):
    return table(spark, sf_dir, "lineitem")


_SUMS = (F.count, F.sum)


@query("agg_rollup", _SETS + "ROLLUP (l_returnflag, l_linestatus)")
def _(spark, sf_dir):
    return _lineitem(spark, sf_dir).rollup("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 2).alias("q"))


@query("agg_cube", _SETS + "CUBE (l_returnflag, l_linestatus)")
def _(spark, sf_dir):
    return _lineitem(spark, sf_dir).cube("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 2).alias("q"))


@query("agg_grouping_sets", _SETS + "GROUPING SETS ((l_returnflag), (l_linestatus), ())")
def _(spark, sf_dir):
    sets = [[F.col("l_returnflag")], [F.col("l_linestatus")], []]
    return _lineitem(spark, sf_dir).groupingSets(sets, "l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 2).alias("q"))


# 2.8 versions: a slice of events by arrival is a version


def _versioned(spark, sf_dir):
    return table(spark, sf_dir, "events").select((F.col("event_id") % 4).cast("int").alias("_version"), "event_id", "ts", "value")


@query("ver_concat", "SELECT CAST(event_id % 4 AS INTEGER) AS _version, event_id, ts, value FROM events WHERE event_id % 4 > 1")
def _(spark, sf_dir):
    return versions.live(_versioned(spark, sf_dir), collapsed_through=1)


@query("ver_select", "SELECT CAST(3 AS INTEGER) AS _version, event_id, ts, value FROM events WHERE event_id % 4 = 3 UNION ALL SELECT 1, event_id, ts, value FROM events WHERE event_id % 4 = 1")
def _(spark, sf_dir):
    v = _versioned(spark, sf_dir)
    return versions.select(v, "latest").union(versions.select(v, 1))


@query("ver_prune", "SELECT CAST(day(ts) AS INTEGER) AS version, CAST(count(*) AS BIGINT) AS n, min(ts) AS first_time, max(ts) AS last_time FROM events GROUP BY 1 HAVING max(ts) >= TIMESTAMP '2024-01-05' AND version > 7")
def _(spark, sf_dir):
    manifest = versions.bounds(table(spark, sf_dir, "events").withColumn("version", F.day("ts")), "ts", ["version"])
    return versions.prune(manifest, F.expr("timestamp_ntz'2024-01-05'"), 7)


@query("ver_temporal_override", "SELECT event_id, ts FROM events WHERE event_type = 'click' AND ts >= TIMESTAMP '2024-01-02' AND ts <= TIMESTAMP '2024-01-28'")
def _(spark, sf_dir):
    one = table(spark, sf_dir, "events").where("event_type = 'click'").select("event_id", "ts")
    return transforms.within(one, "ts", "2024-01-02 00:00:00", "2024-01-28 00:00:00")


@query("ver_bounds_extract", "SELECT CAST(event_id % 4 AS INTEGER) AS _version, CAST(count(*) AS BIGINT) AS n, min(ts) AS first_time, max(ts) AS last_time FROM events GROUP BY 1")
def _(spark, sf_dir):
    return versions.bounds(_versioned(spark, sf_dir), "ts", ["_version"])


@query("kv_latest", "SELECT l_orderkey, l_linenumber, l_suppkey, l_returnflag FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber DESC, l_partkey DESC, l_suppkey DESC, l_extendedprice DESC, l_shipdate DESC) AS rn FROM lineitem) WHERE rn = 1 AND l_returnflag <> 'A'")
def _(spark, sf_dir):
    order = [F.desc(c) for c in ("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate")]
    return versions.latest_per_key(_lineitem(spark, sf_dir), ["l_orderkey"], order, F.col("l_returnflag") == "A").select("l_orderkey", "l_linenumber", "l_suppkey", "l_returnflag")


# 2.14 integrity

_DIGEST = "sha256(length(CAST({0} AS VARCHAR)) || ':' || CAST({0} AS VARCHAR) || '|' || length({1}) || ':' || {1})"


def _digests(spark, sf_dir, name, *columns):
    return table(spark, sf_dir, name).withColumn("digest", integrity.row_digest(list(columns)))


_TREE = "SELECT *, {} AS d, (SELECT r_name FROM region WHERE r_regionkey = n_regionkey) AS owner, CAST(n_nationkey % 2 AS INTEGER) AS part FROM nation".format(_DIGEST.format("n_nationkey", "n_name"))


@query(
    "ck_fsck",
    f"WITH t AS ({_TREE}), p AS (SELECT owner, part, CAST(count(*) AS BIGINT) AS n, sha256(string_agg(d, '' ORDER BY d)) AS digest FROM t GROUP BY ALL), o AS (SELECT owner, CAST(sum(n) AS BIGINT) AS n, sha256(string_agg(digest, '' ORDER BY digest)) AS digest FROM p GROUP BY 1) "
    "SELECT owner, part, n, digest FROM p UNION ALL SELECT owner, NULL, n, digest FROM o UNION ALL SELECT NULL, NULL, CAST(sum(n) AS BIGINT), sha256(string_agg(digest, '' ORDER BY digest)) FROM o",
)
def _(spark, sf_dir):
    """Digests of each part, each owner over its parts, and the root over all owners."""
    names = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("n_regionkey"), F.col("r_name").alias("owner"))
    rows = _digests(spark, sf_dir, "nation", "n_nationkey", "n_name").join(names, "n_regionkey").withColumn("part", (F.col("n_nationkey") % 2).cast("int"))
    return integrity.tree(rows, ["owner", "part"])


@query("ck_fsck_content", "SELECT c_custkey FROM customer WHERE c_custkey % 40 = 7 OR c_custkey % 90 = 11")
def _(spark, sf_dir):
    """The second pass: contents hashed again and held against stored digests, some of which were changed, some lost."""
    key = F.col("c_custkey")
    stored = _digests(spark, sf_dir, "customer", "c_custkey", "c_name").withColumn("digest", F.when(key % 40 == 7, F.reverse("digest")).when(key % 90 == 11, None).otherwise(F.col("digest")))
    return integrity.wrong_rows(stored, integrity.row_digest(["c_custkey", "c_name"]), "digest").select("c_custkey")


_LIMB_SQL = ", ".join(f"CAST(sum(CAST('0x' || substr(d, {1 + 8 * i}, 8) AS BIGINT)) AS BIGINT) AS limb{i}" for i in range(8))


@query("ck_set_hash", f"SELECT CAST(count(*) AS BIGINT) AS n, {_LIMB_SQL} FROM (SELECT {_DIGEST.format('c_custkey', 'c_name')} AS d FROM customer)")
def _(spark, sf_dir):
    return integrity.set_digest(_digests(spark, sf_dir, "customer", "c_custkey", "c_name"))


@query("ck_diff", "SELECT c_custkey, CASE WHEN c_custkey % 10 = 1 THEN 'removed' WHEN c_custkey % 10 = 2 THEN 'added' WHEN c_custkey % 10 = 3 THEN 'type_changed' ELSE 'modified' END AS change FROM customer WHERE c_custkey % 10 IN (1, 2, 3, 4)")
def _(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", F.lit("table").alias("kind"), F.sha2("c_name", 256).alias("digest"))
    old = c.where("c_custkey % 10 <> 2")
    new = c.where("c_custkey % 10 <> 1").withColumn("kind", F.when(F.col("c_custkey") % 10 == 3, "series").otherwise(F.col("kind"))).withColumn("digest", F.when(F.col("c_custkey") % 10 == 4, "x").otherwise(F.col("digest")))
    return integrity.diff(old, new, "c_custkey")


@query("ck_missing", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def _(spark, sf_dir):
    o = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return integrity.missing(table(spark, sf_dir, "customer").select("c_custkey"), o, "c_custkey")
