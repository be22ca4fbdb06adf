"""Sources, patterns and views."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandline.catalog import query
from strandline.operators import transforms
from strandline.plans import scratch, views
from strandline.plans.scratch import table
from strandline.sources import formats, synthetic, urls

TYPES = ("click", "error", "purchase", "signup", "view")


def by_type(spark, sf_dir, *columns):
    """Events as one table a type: the sites of the time series queries."""
    events = table(spark, sf_dir, "events")
    return {t: events.where(F.col("event_type") == t).select(*columns) for t in TYPES}


@query("src_url", "SELECT * FROM (VALUES ('csv:///a/b.csv?delimiter=;', 'csv', '/a/b.csv', false, NULL, NULL, '[(''delimiter'', '';'')]', NULL), ('host+jsonlogs+zstd:///log/*.zst', 'jsonlogs', '/log/*.zst', true, 'zstd', NULL, '[]', NULL), ('series:///x', 'file', '/x', false, NULL, 'series', '[]', NULL), ('oteljson+gzip+series:///m', 'oteljson', '/m', false, 'gzip', 'series', '[]', NULL), ('/plain/path', 'file', '/plain/path', false, NULL, NULL, '[]', NULL), ('csv://user@host/x', NULL, NULL, NULL, NULL, NULL, NULL, 'an address has no authority: ''csv://user@host/x'''), ('weblog:///a#f', NULL, NULL, NULL, NULL, NULL, NULL, 'an address has no fragment: ''weblog:///a#f''')) t(url, format, path, host, compression, entry_type, options, error)")
def _(spark, sf_dir):
    """How addresses are read."""
    texts = ["csv:///a/b.csv?delimiter=;", "host+jsonlogs+zstd:///log/*.zst", "series:///x", "oteljson+gzip+series:///m", "/plain/path", "csv://user@host/x", "weblog:///a#f"]
    rows = []
    for t in texts:
        try:
            u = urls.Url.parse(t)
            rows.append((t, u.format, u.path, u.host, u.compression, u.entry_type, str(sorted(u.options.items())), None))
        except ValueError as e:
            rows.append((t, None, None, None, None, None, None, str(e)))
    return spark.createDataFrame(rows, "url string, format string, path string, host boolean, compression string, entry_type string, options string, error string")


@query("src_scheme_dispatch", "SELECT * FROM (VALUES ('csv', 'format'), ('excelhtml', 'format'), ('jsonlogs', 'format'), ('oteljson', 'format'), ('weblog', 'format'), ('data', 'builtin'), ('file', 'builtin'), ('series', 'builtin'), ('table', 'builtin')) t(scheme, kind)")
def _(spark, sf_dir):
    return spark.createDataFrame([(n, urls.FORMATS.classify(n)) for n in [*urls.FORMATS.names(), *sorted(urls.BUILTIN)]], "scheme string, kind string")


@query("src_format_registry", "SELECT * FROM (VALUES ('csv'), ('excelhtml'), ('jsonlogs'), ('oteljson'), ('weblog')) t(format)")
def _(spark, sf_dir):
    return spark.createDataFrame([(n,) for n in urls.FORMATS.names()], "format string")


@query("src_table_provider", "SELECT n_nationkey, n_name, n_regionkey FROM nation")
def _(spark, sf_dir):
    return formats.read(spark, f"{sf_dir}/nation.parquet", one=True).select("n_nationkey", "n_name", "n_regionkey")


@query("src_glob_union", "SELECT n_nationkey, n_name, n_regionkey, NULL::INTEGER AS r_regionkey, NULL::VARCHAR AS r_name FROM nation UNION ALL SELECT NULL, NULL, NULL, r_regionkey, r_name FROM region")
def _(spark, sf_dir):
    frames = [table(spark, sf_dir, n) for n in ("nation", "region")]
    return transforms.union_by_name(frames).select("n_nationkey", "n_name", "n_regionkey", "r_regionkey", "r_name")


@query("src_parquet", "SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_acctbal > 1000 AND c_mktsegment = 'BUILDING'")
def _(spark, sf_dir):
    return formats.read(spark, f"series://{sf_dir}/customer.parquet").where("c_acctbal > 1000 and c_mktsegment = 'BUILDING'").select("c_custkey", "c_name", "c_acctbal")


@query("src_parquet_cast", "SELECT p_partkey, p_size FROM part")
def _(spark, sf_dir):
    return formats.read(spark, f"file+table://{sf_dir}/part.parquet").select("p_partkey", "p_size")


@query("src_csv", "SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier")
def _(spark, sf_dir):
    where = scratch.folder(spark, "csv")
    table(spark, sf_dir, "supplier").write.option("header", True).option("sep", ";").csv(where)
    url = urls.Url("csv", where, options={"delimiter": ";", "schema": "s_suppkey long, s_name string, s_nationkey int, s_acctbal double"})
    return formats.read(spark, url)


@query("src_jsonlines", "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events WHERE props LIKE '{%'")
def _(spark, sf_dir):
    lines = table(spark, sf_dir, "events").select("event_id", F.col("props").alias("value"))
    return formats.json_columns(lines, ["k"]).select("event_id", "k")


_GAUGE_LINE = (
    """concat('{"resourceMetrics":[{"scopeMetrics":[{"metrics":[{"name":"', event_type, '","gauge":{"dataPoints":[{"timeUnixNano":"', """
    """cast(timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01', ts) * 1000 as string), '","asDouble":', cast(value as string), '}]}}]}]}]}')"""
)


@query(
    "src_otel_json",
    "WITH e AS (SELECT *, row_number() OVER (PARTITION BY ts, event_type ORDER BY event_id DESC) AS rn FROM events) SELECT ts AS timestamp, "
    + ", ".join(f"max(CASE WHEN event_type = '{t}' THEN value END) AS \"{t}\"" for t in TYPES) + " FROM e WHERE rn = 1 GROUP BY ts",
)
def _(spark, sf_dir):
    lines = table(spark, sf_dir, "events").selectExpr("event_id", f"{_GAUGE_LINE} as value")
    return formats.gauges(lines, list(TYPES), order="event_id")


@query("src_weblog", "SELECT date_trunc('second', ts) AS timestamp, '10.0.0.' || (user_id % 256) AS remote_addr, '/' || event_type AS path, CAST(200 + event_id % 5 * 100 AS INTEGER) AS status, event_id AS body_bytes_sent FROM events")
def _(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    lines = e.select(F.format_string('10.0.0.%d - - [%s +0000] "GET /%s HTTP/1.1" %d %d "-" "agent"', F.col("user_id") % 256, F.date_format("ts", "dd/MMM/yyyy:HH:mm:ss"), "event_type", 200 + F.col("event_id") % 5 * 100, "event_id").alias("value"))
    return formats.web_log(lines).select(F.col("timestamp").cast("timestamp_ntz").alias("timestamp"), "remote_addr", "path", "status", "body_bytes_sent")


@query("src_excel_html", "SELECT strftime(ts, '%Y-%m-%d %H:%M:%S') AS \"Date Time\", CASE WHEN event_type <> 'view' THEN value END AS \"Level\", NULL::DOUBLE AS \"Note\", CASE WHEN event_type = 'view' THEN value END AS \"Flow\" FROM events")
def _(spark, sf_dir):
    """Exports with different columns: each event is a page, and those of views have a column that the others lack."""
    rows = table(spark, sf_dir, "events")
    view = F.col("event_type") == "view"
    page = F.format_string(
        '<table><tr class="dataHeader"><td>Date Time</td><td>%s</td></tr><tr class="data"><td>%s</td><td>%s</td><td>n/a</td></tr></table>',
        F.when(view, "Flow").otherwise("Level</td><td>Note"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.col("value").cast("string"),
    )
    pages = rows.select(page.alias("value"))
    return formats.html_table(pages, formats.html_headers(pages))


@query("src_line_clean", "SELECT event_id, trim(replace('  ' || event_type || chr(9731) || ' ', chr(9731), '')) AS line FROM events WHERE event_type <> 'view'")
def _(spark, sf_dir):
    lines = table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_type") == "view", "  ").otherwise(F.concat(F.lit("  "), "event_type", F.lit("\0 "))).alias("line"))
    return formats.clean_lines(lines, "line")


@query("src_compression", "SELECT how, CAST(r_regionkey AS VARCHAR) AS r_regionkey, r_name FROM region, (VALUES ('by name'), ('by address'), ('csv')) t(how)")
def _(spark, sf_dir):
    """Compressed files named as such, files whose names say nothing, which the address alone tells to be compressed, and a table of the same kind."""
    r = table(spark, sf_dir, "region").select("r_regionkey", "r_name")
    named, plain, sheet = (scratch.folder(spark, "zipped") for _ in range(3))
    r.select(F.to_json(F.struct("*")).alias("value")).write.option("compression", "gzip").text(named)
    r.write.option("compression", "gzip").option("header", True).csv(sheet)
    frames = [("by name", formats.read(spark, urls.Url("jsonlogs", named, compression="gzip")))]
    for source, target in ((named, plain), (sheet, f"{sheet}-plain")):
        store = scratch.Store(spark, source)
        for name, _ in store.files(""):
            store.copy(name, f"{target}/{name.split('.')[0]}.dat")
    frames.append(("by address", formats.read(spark, urls.Url("jsonlogs", plain, compression="gzip"))))
    frames.append(("csv", formats.read(spark, urls.Url("csv", f"{sheet}-plain", compression="gzip", options={"schema": "r_regionkey string, r_name string"}))))
    return transforms.union_by_name([df.select(F.lit(how).alias("how"), "r_regionkey", "r_name") for how, df in frames])


_SERIES = """WITH t AS (SELECT i, TIMESTAMP '2024-01-01' + INTERVAL 15 MINUTE * i AS timestamp, CAST(i * 900 AS DOUBLE) AS s FROM range(0, 97) r(i))
SELECT timestamp, round(CAST({} AS DOUBLE), 6) AS v FROM t"""
_WAVES = {
    "src_wave_sine": ([{"type": "sine", "amplitude": 10.0, "period": "24h", "offset": 20.0, "phase": 1.57}], "20.0 + 10.0 * sin(2 * pi() * s / 86400.0 + 1.57)"),
    "src_wave_triangle": ([{"type": "triangle", "amplitude": 15.0, "period": "8h", "offset": 60.0}], "60.0 + 15.0 * (CASE WHEN (s / 28800.0) % 1.0 < 0.5 THEN 4 * ((s / 28800.0) % 1.0) - 1 ELSE 3 - 4 * ((s / 28800.0) % 1.0) END)"),
    "src_wave_square": ([{"type": "square", "amplitude": 2.0, "period": "6h", "phase": 0.1}], "2.0 * (CASE WHEN sin(2 * pi() * s / 21600.0 + 0.1) >= 0 THEN 1.0 ELSE -1.0 END)"),
    "src_wave_line": ([{"type": "line", "slope": 0.0002, "offset": 5.0}], "5.0 + 0.0002 * s"),
    "src_synthetic": ([{"type": "sine", "amplitude": 10.0, "period": "24h", "offset": 20.0}, {"type": "line", "slope": 0.0002}], "20.0 + 10.0 * sin(2 * pi() * s / 86400.0) + 0.0002 * s"),
}


def _wave(parts):
    def run(spark, sf_dir):
        df = synthetic.series(spark, "2024-01-01 00:00:00", "2024-01-02 00:00:00", "15m", {"v": parts})
        return df.withColumn("v", F.round("v", 6))

    return run


for _name, (_parts, _sql) in _WAVES.items():
    query(_name, _SERIES.format(_sql))(_wave(_parts))


@query("src_device_api", "SELECT time_bucket(INTERVAL '1 hour', ts, TIMESTAMP '1970-01-01') AS timestamp, " + ", ".join(f"max(CASE WHEN event_type = '{t}' THEN value END) AS \"{t}\"" for t in TYPES) + " FROM events GROUP BY 1")
def _(spark, sf_dir):
    """Long readings to a wide series, a nullable double for each parameter, collected twice: the second time from the youngest one that is there."""
    where = scratch.folder(spark, "readings")
    readings = table(spark, sf_dir, "events").select("ts", "event_type", "value")
    for until in ("2024-01-15", "2025-01-01"):
        served = readings.where(F.col("ts") < F.lit(until).cast("timestamp_ntz"))
        youngest = formats.latest_time(spark.read.parquet(where), F.col("ts")).first()[0] if scratch.Store(spark, where).files("") else None
        (served if youngest is None else served.where(F.col("ts") > F.lit(youngest))).write.mode("append").parquet(where)
    long = spark.read.parquet(where).select(F.window("ts", "1 hour")["start"].alias("timestamp"), "event_type", "value")
    return long.groupBy("timestamp").pivot("event_type", list(TYPES)).agg(F.max("value"))


@query("src_youngest_ts", "SELECT event_type, max(ts) AS youngest FROM events GROUP BY event_type")
def _(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.max("ts").alias("youngest"))


@query("src_infinite_csv", "SELECT i AS id, i % 1000 AS c0, (i * 2) % 1000 AS c1 FROM range(0, 5000) r(i)")
def _(spark, sf_dir):
    return synthetic.generator(spark, 5000, 2)


@query("src_object_store", "SELECT owner, part, version, CAST(count(*) AS BIGINT) AS rows FROM (SELECT CASE WHEN event_id % 2 = 0 THEN 'a' ELSE 'b' END AS owner, event_type AS part, CAST(CASE WHEN day(ts) <= 15 THEN 1 ELSE 2 END AS INTEGER) AS version FROM events) WHERE part IN ('click', 'error') GROUP BY ALL")
def _(spark, sf_dir):
    """Objects under owner=/part=/version= paths of any store that Spark knows: a listing is pruned by the path, not read."""
    where = scratch.folder(spark, "objects")
    e = table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 2 == 0, "a").otherwise("b").alias("owner"), F.col("event_type").alias("part"), F.when(F.day("ts") <= 15, 1).otherwise(2).alias("version"))
    e.write.partitionBy("owner", "part", "version").parquet(where)
    return spark.read.parquet(where).where("part in ('click', 'error')").groupBy("owner", "part", "version").agg(F.count(F.lit(1)).alias("rows"))


@query("src_git_tree", "SELECT folder, CAST(sum(length(r_name) + 1) AS BIGINT) AS length, sha256(string_agg(r_name || chr(10), '' ORDER BY r_regionkey)) AS digest FROM region, (VALUES ('a/leaf'), ('a/b/leaf')) t(folder) GROUP BY 1")
def _(spark, sf_dir):
    """A checked-out tree, folders and all, as a table of paths, lengths and content digests."""
    where = scratch.folder(spark, "tree")
    for folder in ("a", "a/b"):
        table(spark, sf_dir, "region").orderBy("r_regionkey").select("r_name").coalesce(1).write.text(f"{where}/{folder}/leaf")
    tree = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(where)
    return tree.select(F.regexp_extract("path", "/tree-[^/]*/(.*)/[^/]*$", 1).alias("folder"), "length", F.sha2("content", 256).alias("digest"))


@query("src_information_schema", "SELECT CAST(row_number() OVER () - 1 AS INTEGER) AS position, column_name AS name, CASE data_type WHEN 'INTEGER' THEN 'int' WHEN 'VARCHAR' THEN 'string' ELSE data_type END AS type FROM (DESCRIBE nation) t(column_name, data_type, a, b, c, d)")
def _(spark, sf_dir):
    return views.describe(table(spark, sf_dir, "nation")).drop("nullable")


@query("src_hostmount", "SELECT 'host/region' AS path, CAST(count(*) AS BIGINT) AS n FROM region UNION ALL SELECT 'host/nation', count(*) FROM nation WHERE n_regionkey = 1 UNION ALL SELECT 'host/sums/by_region', count(DISTINCT n_regionkey) FROM nation")
def _(spark, sf_dir):
    """A folder mounted under a prefix, another mounted over it that hides one table, and a directory of views beside them."""
    over = scratch.folder(spark, "over")
    table(spark, sf_dir, "nation").where("n_regionkey = 1").write.parquet(f"{over}/nation.parquet")
    c = views.Catalog(spark)
    c.mount("all", sf_dir)
    c.mount("host", sf_dir)
    c.mount("host", over)
    c.define("host/sums", "dynamic-dir", {"entries": [{"name": "by_region", "factory": "sql-derived-table", "config": {"patterns": {"n": "all/nation"}, "query": "SELECT n_regionkey, count(*) AS n FROM n GROUP BY 1"}}]})
    found = c.match("host/*ion") | c.match("host/sums/*")
    return transforms.union_by_name([df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(n).alias("path"), "n") for n, df in found.items()])


_PATHS = ["/a/b.csv", "/a/b/c.csv", "/data/site1/temp.series", "/data/site2/temp.series", "/data/x/y/z.log"]


@query("glob_parse", "SELECT * FROM (VALUES ('/a/*.csv', 'a,*.csv'), ('/data/**/*.log', 'data,**,*.log'), ('/x/y', 'x,y')) t(pattern, parts)")
def _(spark, sf_dir):
    return spark.createDataFrame([(p, ",".join(urls.glob_segments(p))) for p in ("/a/*.csv", "/data/**/*.log", "/x/y")], "pattern string, parts string")


@query("glob_match_captures", "SELECT url, regexp_extract(url, '^https?://([^/]*)/([a-z]+)/(.*)$', 1) AS host, regexp_extract(url, '^https?://([^/]*)/([a-z]+)/(.*)$', 2) AS lang FROM pages WHERE regexp_matches(url, '^https?://([^/]*)/([a-z]+)/(.*)$')")
def _(spark, sf_dir):
    rx = "^https?://([^/]*)/([a-z]+)/(.*)$"
    return table(spark, sf_dir, "pages").where(F.col("url").rlike(rx)).select("url", F.regexp_extract("url", rx, 1).alias("host"), F.regexp_extract("url", rx, 2).alias("lang"))


@query("glob_collect", "SELECT * FROM (VALUES ('/a/b.csv', '/a/*.csv', 'b'), ('/a/b.csv', '/**', 'a/b.csv'), ('/a/b/c.csv', '/**', 'a/b/c.csv'), ('/data/site1/temp.series', '/data/*/temp.*', 'site1,series'), ('/data/site1/temp.series', '/**', 'data/site1/temp.series'), ('/data/site2/temp.series', '/data/*/temp.*', 'site2,series'), ('/data/site2/temp.series', '/**', 'data/site2/temp.series'), ('/data/x/y/z.log', '/data/**/*.log', 'x/y,z'), ('/data/x/y/z.log', '/**', 'data/x/y/z.log')) t(path, pattern, captures)")
def _(spark, sf_dir):
    rows = [(p, q, ",".join(found)) for p in _PATHS for q in ("/a/*.csv", "/data/*/temp.*", "/data/**/*.log", "/**") if (found := urls.glob_match(q, p)) is not None]
    return spark.createDataFrame(rows, "path string, pattern string, captures string")


@query("glob_host", "SELECT * FROM (VALUES ('nation.parquet', ',')) t(name, captures)")
def _(spark, sf_dir):
    root = sf_dir.removeprefix("file://")
    found = urls.glob_host(f"{root}/*nation*.parquet") if "://" not in root else []
    return spark.createDataFrame([(p.rsplit("/", 1)[-1], ",".join(c)) for p, c in found], "name string, captures string")


@query("url_type_filter", "SELECT * FROM (VALUES ('table:///a', 'table'), ('series:///b', 'series'), ('csv:///c', 'format'), ('csv+series:///d', 'series'), ('file:///e', 'builtin')) t(url, admits)")
def _(spark, sf_dir):
    rows = [(t, urls.Url.parse(t).entry_type or urls.FORMATS.classify(urls.Url.parse(t).format)) for t in ("table:///a", "series:///b", "csv:///c", "csv+series:///d", "file:///e")]
    return spark.createDataFrame(rows, "url string, admits string")


@query("column_glob", "SELECT * FROM (VALUES ('l_*', 'l_orderkey,l_partkey,l_suppkey,l_linenumber,l_quantity,l_extendedprice,l_discount,l_tax,l_returnflag,l_linestatus,l_shipdate'), ('*date', 'l_shipdate'), ('l_*key', 'l_orderkey,l_partkey,l_suppkey'), ('l_tax', 'l_tax'), ('*a*', ''), ('l_sh*date', 'l_shipdate')) t(pattern, names)")
def _(spark, sf_dir):
    names = table(spark, sf_dir, "lineitem").columns
    return spark.createDataFrame([(p, ",".join(transforms.column_glob(p, names))) for p in ("l_*", "*date", "l_*key", "l_tax", "*a*", "l_sh*date")], "pattern string, names string")


@query("out_pattern", "SELECT * FROM (VALUES ('reduced/series/site1', '/data/site1/temp.series'), ('reduced/series/site2', '/data/site2/temp.series')) t(name, paths)")
def _(spark, sf_dir):
    found = [(p, c) for p in _PATHS if (c := urls.glob_match("/data/*/temp.*", p)) is not None]
    return spark.createDataFrame([(name, ",".join(paths)) for name, paths in sorted(urls.group_outputs("reduced/$1/$0", found).items())], "name string, paths string")


@query("dynamic_dir", "SELECT 'hourly' AS entry, CAST(count(DISTINCT date_trunc('hour', ts)) AS BIGINT) AS n FROM events UNION ALL SELECT 'deep/renamed', count(*) FROM events")
def _(spark, sf_dir):
    c = views.Catalog(spark)
    c.add("events", table(spark, sf_dir, "events"))
    hourly = {"in": "events", "time_column": "ts", "resolution": "1h", "aggregations": [{"type": "count", "columns": ["*"]}]}
    renamed = {"name": "renamed", "factory": "column-rename", "config": {"in": "events", "rules": [{"type": "direct", "from": "value", "to": "v"}]}}
    c.define("dir", "dynamic-dir", {"entries": [{"name": "hourly", "factory": "temporal-reduce", "config": hourly}, {"name": "deep", "factory": "dynamic-dir", "config": {"entries": [renamed]}}]})
    found = c.match("dir/**")
    assert all(c.get(n) is df for n, df in found.items())  # built once
    return transforms.union_by_name([df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(n.removeprefix("dir/")).alias("entry"), "n") for n, df in found.items()])


@query("dedup_nodes", "SELECT DISTINCT user_id, event_type FROM events")
def _(spark, sf_dir):
    return table(spark, sf_dir, "events").select("user_id", "event_type").dropDuplicates()


@query("env_subst", "SELECT * FROM (VALUES ('${env:HOME_DIR}/x', '/h/x'), ('${env:MISSING:-none}', 'none'), ('cost $$5 ${env:N}', 'cost $5 3')) t(text, result)")
def _(spark, sf_dir):
    env = {"HOME_DIR": "/h", "N": "3"}
    texts = ["${env:HOME_DIR}/x", "${env:MISSING:-none}", "cost $$5 ${env:N}"]
    return spark.createDataFrame([(t, urls.substitute_env(t, env)) for t in texts], "text string, result string")


@query("sql_derived_table", "SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name <> 'ASIA'")
def _(spark, sf_dir):
    c = views.Catalog(spark)
    for n in ("nation", "region"):
        c.add(n, table(spark, sf_dir, n))
    c.define("joined", "sql-derived-table", {"patterns": {"a": "nation", "b": "region"}, "query": "SELECT n_name, r_name FROM a JOIN b ON n_regionkey = r_regionkey WHERE r_name <> 'ASIA'"})
    return c.get("joined")


@query("sql_derived_series", "SELECT user_id, CAST(count(*) AS BIGINT) AS n, round(sum(value), 4) AS total FROM events WHERE event_type IN ('click', 'view') GROUP BY user_id")
def _(spark, sf_dir):
    c = views.Catalog(spark)
    for t, df in by_type(spark, sf_dir, "user_id", "value").items():
        c.add(f"site/{t}", df)
    c.add("others/x", c.get("site/view"))
    c.define("v", "sql-derived-series", {"patterns": {"s": "site/*i*w", "c": "site/cl*"}, "query": "SELECT user_id, count(*) AS n, round(sum(value), 4) AS total FROM (SELECT * FROM s UNION ALL SELECT * FROM c) GROUP BY user_id"})
    return c.get("v")


@query("sql_default_query", "SELECT r_regionkey, r_name FROM region")
def _(spark, sf_dir):
    return views.sql_view(spark, {"only": table(spark, sf_dir, "region")}).select("r_regionkey", "r_name")


@query("sql_table_rename", "WITH r AS (SELECT * FROM region WHERE r_name LIKE 'A%') SELECT n.n_name FROM nation n JOIN r ON n.n_regionkey = r.r_regionkey WHERE EXISTS (SELECT 1 FROM region q WHERE q.r_regionkey = r.r_regionkey)")
def _(spark, sf_dir):
    tables = {"x": table(spark, sf_dir, "nation"), "y": table(spark, sf_dir, "region")}
    return views.sql_view(spark, tables, "WITH r AS (SELECT * FROM y WHERE r_name LIKE 'A%') SELECT x.n_name FROM x JOIN r ON x.n_regionkey = r.r_regionkey WHERE EXISTS (SELECT 1 FROM y q WHERE q.r_regionkey = r.r_regionkey)")


@query("sql_source_table", "SELECT event_type, CAST(count(*) AS BIGINT) AS n FROM events WHERE value > 42 GROUP BY event_type")
def _(spark, sf_dir):
    return views.query_source(table(spark, sf_dir, "events"), "SELECT event_type, count(*) AS n FROM source WHERE value > 42 GROUP BY event_type")


@query("sql_explain", "SELECT * FROM (VALUES ('source', 'event_id', 'bigint'), ('source', 'ts', 'timestamp_ntz'), ('source', 'user_id', 'bigint'), ('source', 'event_type', 'string'), ('source', 'value', 'double'), ('source', 'props', 'string'), ('result', 'user_id', 'bigint'), ('result', 'value', 'double'), ('read', 'user_id', 'bigint'), ('read', 'value', 'double'), ('pushed', 'value', '>')) t(what, name, type)")
def _(spark, sf_dir):
    """Sources and result of a query by name and type, and what of them is read and filtered at the scan, without running it."""
    return views.explain(table(spark, sf_dir, "events"), "SELECT user_id, value FROM source WHERE value > 42")


@query("sql_view_chain", "SELECT user_id, round(max(value) * 9.0 / 5.0 + 32.0, 4) AS top_f FROM events WHERE event_type = 'view' GROUP BY user_id")
def _(spark, sf_dir):
    first = views.query_source(table(spark, sf_dir, "events"), "SELECT user_id, value FROM source WHERE event_type = 'view'")
    second = views.query_source(first, "SELECT user_id, max(value) AS top FROM source GROUP BY user_id")
    return views.query_source(second, "SELECT user_id, round(top * 9D / 5D + 32D, 4) AS top_f FROM source")


@query("sql_empty_input", "SELECT event_id, ts, value FROM events WHERE event_type = 'view' UNION ALL SELECT event_id, ts, value FROM events WHERE false")
def _(spark, sf_dir):
    view = by_type(spark, sf_dir, "event_id", "ts", "value")["view"]
    return transforms.union_by_name([view, views.empty_like(spark, view)])


@query("sql_union_files", "SELECT user_id, value, NULL::VARCHAR AS props FROM events WHERE event_type = 'click' UNION ALL SELECT user_id, NULL, props FROM events WHERE event_type = 'error'")
def _(spark, sf_dir):
    e = by_type(spark, sf_dir, "*")
    return transforms.union_by_name([e["click"].select("user_id", "value"), e["error"].select("user_id", "props")])


@query("sql_time_args", "SELECT event_id, ts FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND ts <= TIMESTAMP '2024-01-06'")
def _(spark, sf_dir):
    return transforms.within(table(spark, sf_dir, "events").select("event_id", "ts"), "ts", "2024-01-05 00:00:00", "2024-01-06 00:00:00")


@query("ext_factory", "SELECT * FROM (VALUES ('column-rename', 'in,rules'), ('file', 'format,path'), ('sql-derived-series', 'patterns,query'), ('sql-derived-table', 'patterns,query'), ('synthetic-timeseries', 'end,interval,points,start,time_column'), ('temporal-reduce', 'aggregations,in,resolution,time_column'), ('timeseries-join', 'align,inputs,time_column'), ('timeseries-pivot', 'columns,pattern,time_column')) t(factory, keys)")
def _(spark, sf_dir):
    return spark.createDataFrame([(n, ",".join(sorted(k))) for n, (_, k) in sorted(views.FACTORIES.known.items())], "factory string, keys string")


@query("ext_format", "SELECT event_id, upper(event_type) AS shout FROM events")
def _(spark, sf_dir):
    """A reader of one's own, registered and used by its name."""
    own = urls.Registry()
    own.register("shout", lambda spark, url: table(spark, url.path, "events").select("event_id", F.upper("event_type").alias("shout")))
    return own.reader("shout")(spark, urls.Url("shout", sf_dir))


@query("ext_table_fn", "SELECT r_regionkey AS id, r_name AS name FROM region")
def _(spark, sf_dir):
    return table(spark, sf_dir, "region").transform(transforms.rename, [{"type": "direct", "from": "r_regionkey", "to": "id"}, {"type": "pattern", "pattern": "^r_", "replacement": ""}])
