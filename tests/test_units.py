"""Semantics that SQL over the tables doesn't reach."""

import datetime as dt
import decimal
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from strandline import catalog
from strandline.functions import money
from strandline.functions.timebin import seconds
from strandline.operators import integrity, joins, ledger, overlap, transforms
from strandline.plans import export, reduce, rollup, scratch, tablelog, views
from strandline.sources import formats, synthetic, urls
from strandline.streaming import fold

T0 = dt.datetime(2024, 1, 1)


def test_durations():
    assert [seconds(x) for x in ("1h", "90s", "4 hours", "1d12h", "15min", "2 days", "1500ms")] == [3600, 90, 14400, 129600, 900, 172800, 1]
    with pytest.raises(ValueError):
        seconds("soon")


def test_addresses():
    u = urls.Url.parse("host+csv+gzip+series:///a/*.gz?delimiter=;")
    assert (u.host, u.format, u.compression, u.entry_type, u.options, u.is_pattern) == (True, "csv", "gzip", "series", {"delimiter": ";"}, True)
    assert urls.Url.parse("/x/y").format == "file" and urls.Url.parse("table:///t").entry_type == "table"
    for bad in ("csv://host/x", "csv:///x#f", "csv+odd:///x"):
        with pytest.raises(ValueError):
            urls.Url.parse(bad)
    with pytest.raises(ValueError):
        urls.FORMATS.classify("nothing")


def test_patterns():
    assert urls.glob_match("/data/*/temp.*", "/data/s1/temp.series") == ["s1", "series"]
    assert urls.glob_match("/data/**/*.log", "/data/a/b/c.log") == ["a/b", "c"]
    assert urls.glob_match("/a/*b", "/a/bab") is None  # the first place where the text occurs, without going back
    assert urls.glob_match("/a/*", "/a/b/c") is None
    assert urls.out_name("out/$1-$0", ["x", "y"]) == "out/y-x"
    assert transforms.column_glob("a*a", ["a", "aa", "aba"]) == ["aa", "aba"]
    assert transforms.column_glob("*a*", ["aa", "*a*"]) == ["*a*"]
    assert urls.substitute_env("${env:A:-b}$$${env:C}", {"C": "d"}) == "b$d"
    with pytest.raises(KeyError):
        urls.substitute_env("${env:A}", {})


def test_synthetic_day_has_1441_minutes(spark):
    df = synthetic.series(spark, "2024-01-01 00:00:00", "2024-01-02 00:00:00", "1m", {"v": [{"type": "square", "amplitude": 2.0, "period": "6h"}]})
    assert df.count() == 1441
    assert df.orderBy("timestamp").first().v == 2.0  # zero counts as positive


def test_every_hour_of_high_frequency_data_is_full(spark):
    df = synthetic.series(spark, "2024-01-01 00:00:00", "2024-01-10 23:59:59", "1s", {"v": [{"type": "line", "slope": 1.0}]})
    out = reduce.single_pass(df, "timestamp", "1h", [{"type": "count", "columns": ["*"]}])
    assert out.count() == 240 and {r["timestamp.count"] for r in out.collect()} == {3600}


def test_gauges_out_of_order_versions(spark):
    line = lambda ns, v: f'{{"resourceMetrics":[{{"scopeMetrics":[{{"metrics":[{{"name":"t","gauge":{{"dataPoints":[{{"timeUnixNano":"{ns}","asDouble":{v}}}]}}}}]}}]}}]}}'
    hour = 3_600_000_000_000
    lines = spark.createDataFrame([(x,) for x in (line(hour + 1000, 44.0), line(hour + 2000, 44.2), line(1000, 42.0), line(2000, 42.4), "{broken")], "value string").coalesce(1)
    out = reduce.single_pass(formats.gauges(lines), "timestamp", "1h", [{"type": "avg", "columns": ["t"]}])
    assert [round(r["t.avg"], 6) for r in out.collect()] == [42.2, 44.1]


def test_web_log(spark):
    good = '1.2.3.4 - bob [10/Oct/2024:13:55:36 +0200] "GET /a HTTP/1.1" 200 - "-" "x y"'
    rows = formats.web_log(spark.createDataFrame([(good,), ("nonsense",)], "value string")).collect()
    assert len(rows) == 1
    r = rows[0]
    assert (r.remote_user, r.method, r.path, r.status, r.body_bytes_sent, r.http_referer, r.http_user_agent) == ("bob", "GET", "/a", 200, 0, None, "x y")
    assert r.timestamp == dt.datetime(2024, 10, 10, 11, 55, 36)


def test_html_rows():
    header, rows = formats.html_rows('<table><tr isi-data-table="1"><td>Date Time</td><td>x</td></tr><tr class="data"><td>t</td></tr><tr><td>no</td></tr></table>')
    assert header == ["Date Time", "x"] and rows == [["t", None]]


def test_join_of_three_scopes_keeps_both_rows(spark):
    def s(times):
        return spark.createDataFrame([(T0 + dt.timedelta(hours=h), float(h)) for h in times], "timestamp timestamp_ntz, v double")

    parts = [{"df": s([1]), "scope": "a"}, {"df": s([2]), "scope": "b"}, {"df": s([2]), "scope": "c"}]
    assert joins.series_join(parts).count() == 3
    assert joins.series_join(parts, align="coalesce").count() == 2
    with pytest.raises(ValueError):
        joins.series_join(parts[:1])


def test_config_errors(spark):
    c = views.Catalog(spark)
    c.add("e", spark.range(1))
    c.define("d", "column-rename", {"in": "e", "rules": [], "typo": 1})
    with pytest.raises(ValueError):
        c.get("d")
    with pytest.raises(ValueError):
        views.sql_view(spark, {"a": spark.range(1), "b": spark.range(1)})
    with pytest.raises(ValueError):
        reduce.expand(spark.createDataFrame([("x",)], "s string"), [{"type": "avg"}], "t")


def _points(spark, hours):
    return spark.createDataFrame([(T0 + dt.timedelta(hours=h), float(h % 7)) for h in hours], "ts timestamp_ntz, v double")


SPEC = [{"type": k, "columns": ["v"]} for k in ("avg", "sum", "min", "max", "count")]


def test_rollup_equals_single_pass_after_each_version(spark):
    r = rollup.Rollup(spark, scratch.folder(spark, "t"), "ts", ["1h", "1d"], SPEC, "6h")
    versions = {}
    for k in range(3):
        versions[f"v{k}"] = _points(spark, range(40 * k, 40 * k + 45 - 5 * (k == 2)))
        r.build(versions)
        for level in ("1h", "1d"):
            want = reduce.single_pass(transforms.union_by_name(list(versions.values())), "ts", level, SPEC).collect()
            assert r.read(level).collect() == want
    assert r.build(versions) == "reuse"


def test_rollup_is_keyed_by_its_configuration(spark):
    where, versions = scratch.folder(spark, "t"), {"a": _points(spark, range(30))}
    spec = lambda kind: [{"type": kind, "columns": ["v"]}]
    rollup.Rollup(spark, where, "ts", ["1h"], spec("avg")).build(versions)
    for levels, kind in ((["1h"], "max"), (["1h", "1d"], "max")):
        r = rollup.Rollup(spark, where, "ts", levels, spec(kind))
        with pytest.raises(rollup.CorruptRollup):
            r.read("1h")
        assert r.build(versions) == "rebuild" and r.build(versions) == "reuse"
        assert r.read(levels[-1]).collect() == reduce.single_pass(versions["a"], "ts", levels[-1], spec(kind)).collect()


def test_rollup_runs_stay_few(spark):
    """Runs are merged as they pile up, and what a version has written is not read again once it is sealed."""
    r, versions = rollup.Rollup(spark, scratch.folder(spark, "t"), "ts", ["1h"], SPEC, "2h"), {}
    for k in range(9):
        versions[f"v{k}"] = _points(spark, range(10 * k, 10 * k + 10))
        r.build(versions)
    level = r.manifest()["levels"]["1h"]
    assert len(level["runs"]) <= 4 and all(a["high"] == b["low"] for a, b in zip(level["runs"], level["runs"][1:], strict=False))
    assert r.read("1h").collect() == reduce.single_pass(transforms.union_by_name(list(versions.values())), "ts", "1h", SPEC).collect()
    files = {x["file"].split("/")[0] + "/" + x["file"].split("/")[1] for x in r._parts(level)}
    assert all(r.store.files(x) or r.store.exists(x) for x in files)
    r.store.delete(f"{r._version_file('v0')}")  # sealed long ago
    versions["v9"] = _points(spark, range(90, 100))
    assert r.build(versions) == "incremental" and r.read("1h").count() == reduce.single_pass(transforms.union_by_name(list(versions.values())), "ts", "1h", SPEC).count()


def test_rollup_refuses_late_data(spark):
    r = rollup.Rollup(spark, scratch.folder(spark, "t"), "ts", ["1h"], SPEC, "1h")
    first = {"a": _points(spark, range(10, 20))}
    r.build(first)
    with pytest.raises(rollup.LateData):
        r.build(first | {"b": _points(spark, [3])})
    assert r.build(first) == "reuse"
    r.store.delete(r.manifest()["levels"]["1h"]["hot"]["file"])
    with pytest.raises(rollup.CorruptRollup):
        r.read("1h")


def test_fifo_loses_credit_without_open_bills(spark):
    rng = random.Random(4)
    legs = [(c, T0 + dt.timedelta(days=d), d, 0, 1100, *((rng.randint(1, 900), 0) if rng.random() < 0.5 else (0, rng.randint(1, 900)))) for c in range(30) for d in range(25)]
    journal = spark.createDataFrame(legs, "customer_id int, txn_date timestamp_ntz, txn_id int, leg_seq int, account_code int, debit_cents long, credit_cents long")
    want = {}
    for c, day, _, _, _, debit, credit in legs:
        bills = want.setdefault(c, [])
        if debit:
            bills.append([day, debit])
        for b in bills:
            paid = min(b[1], credit)
            b[1] -= paid
            credit -= paid
    got = sorted((r.customer_id, r.bill_date, r.open_cents) for r in ledger.unpaid(journal).collect())
    assert got == sorted((c, d, n) for c, bills in want.items() for d, n in bills if n)


def test_money(spark):
    assert sum(money.allocate(1001, [1.0, 2.0, 3.0], 6.0, 5)) == 1001
    exact = spark.createDataFrame([(1_999_999_999, 1, 2_000_000_000), (-7, 1, 2), (7, -1, 2), (2**62, 3, 4), (9_007_199_254_740_993, 1, 1)], "a long, o long, u long")
    assert [r[0] for r in exact.select(money.scale_ratio(F.col("a"), F.col("o"), F.col("u"))).collect()] == [0, -3, -3, 3 * 2**60, 9_007_199_254_740_993]
    big = spark.createDataFrame([(9_007_199_254_740_993, i) for i in range(2)], "t long, p int").select(money.split(F.col("t"), F.lit(2), F.col("p")))
    assert [r[0] for r in big.collect()] == [4_503_599_627_370_497, 4_503_599_627_370_496]
    prices = spark.createDataFrame([(decimal.Decimal("90071992547409.93"),)], "d decimal(20,2)").select(money.cents(F.col("d"))).first()
    assert prices[0] == 9_007_199_254_740_993
    assert sorted(money.shuffled(50, 9)) == list(range(50)) and money.shuffled(50, 9) == money.shuffled(50, 9)
    df = spark.createDataFrame([(-100, i) for i in range(3)], "t long, p int").select(money.split(F.col("t"), F.lit(3), F.col("p")).alias("s"))
    assert [r.s for r in df.collect()] == [-34, -33, -33]
    with pytest.raises(ValueError):
        ledger.post(spark, 1, "2024-01-01", [{"account_code": 1, "debit_cents": 5}])


def test_overlap_scan():
    assert overlap.scan([(0, "a"), (1, "a"), (2, "a")]) == [("a", 0, 2, 3)]
    found = overlap.scan([(0, "a"), (10, "a"), (20, "b"), (100_000, "b")], 60_000)
    assert found[0] == ("a", 0, 10, 2) and found[1][0] == "overlap" and found[1][1:] == (10, 20, 2)
    assert overlap.scan([(0, "a"), (200_000, "b")], 60_000) == [("a", 0, 0, 1), ("b", 200_000, 200_000, 1)]


def test_checksums_find_any_change(spark):
    df = spark.createDataFrame([(i, str(i)) for i in range(50)], "k int, v string")

    def total(d):
        r = integrity.set_digest(d.withColumn("digest", integrity.row_digest(["k", "v"]))).first()
        return integrity.carried([r[f"limb{i}"] for i in range(integrity.LIMBS)])

    assert total(df) == total(df.orderBy(F.desc("k")))
    assert total(df) != total(df.withColumn("v", F.when(F.col("k") == 3, "x").otherwise(F.col("v"))))


def test_export(spark):
    with pytest.raises(ValueError):
        export.export(_points(spark, [1]).where("false"), scratch.folder(spark, "e"), "ts", ["year"])
    with pytest.raises(ValueError):
        export.partition_times("month=2")
    where = scratch.folder(spark, "e")
    assert export.export(_points(spark, range(30)), where, "ts", ["year", "month", "day"]) == ["year=2024/month=1/day=1", "year=2024/month=1/day=2"]
    assert len(spark.read.parquet(where).inputFiles()) == 2


def test_empty_tables(spark):
    none = _points(spark, [1]).where("false")
    assert reduce.single_pass(none, "ts", "1h", SPEC).count() == 0
    assert joins.series_pivot({"a": none, "b": none}, ["v"], "ts").count() == 0
    assert overlap.runs(none.select(F.lit("a").alias("origin"), F.col("ts").alias("time"))).count() == 0


def test_renames(spark):
    df = spark.createDataFrame([(1, 2, "3")], "a_x int, a_y int, b string")
    rules = [{"type": "direct", "from": "a_x", "to": "first"}, {"type": "pattern", "pattern": "^a_(.)", "replacement": "$1_"}, {"type": "direct", "from": "b", "to": "n", "cast": "odd"}]
    assert transforms.rename(df, rules).dtypes == [("first", "int"), ("y_", "int"), ("n", "string")]


def test_status_goes_on_after_a_restart(spark):
    where = scratch.folder(spark, "status")
    entries = lambda rows: spark.createDataFrame(rows, "key string, time timestamp_ntz, message string, version int")
    t = [T0 + dt.timedelta(hours=h) for h in range(9)]
    fold.StatusFold(spark, where).fold(entries([("a", t[5], "new", 1), ("b", t[1], "one", 1)]))
    fold.StatusFold(spark, where).fold(entries([("a", t[3], "old", 2), ("b", t[1], "later fold", 2)]))
    fold.StatusFold(spark, where).fold(entries([("a", t[8], "again", 1)]))  # a version that was folded
    assert {(r.key, r.message) for r in fold.StatusFold(spark, where).latest().collect()} == {("a", "new"), ("b", "later fold")}
    assert {(r.key, r.message) for r in fold.StatusFold(spark, where).newest().collect()} == {("a", "new"), ("a", "old"), ("b", "one"), ("b", "later fold")}
    hot = fold.StatusFold(spark, scratch.folder(spark, "status"), backfill=3600)
    hot.fold(entries([("a", t[8], "now", 1), ("b", t[1], "long ago", 1)]))
    assert [r.key for r in hot.latest().collect()] == ["a"]


def test_journal_takes_an_entry_once(spark):
    where = scratch.folder(spark, "journal")
    rows = [(i, T0 + dt.timedelta(minutes=i), f"unit{i % 3}", f"m{i}") for i in range(30)]
    entries = spark.createDataFrame(rows, "cursor long, time timestamp_ntz, series string, message string")
    assert [fold.JournalIngest(spark, where).ingest(entries.where(f"cursor < {n}")) for n in (10, 10, 30)] == [10, 0, 20]
    # A batch that broke off before the cursor moved has written files that no one reads, and is written again.
    broken = fold.JournalIngest(spark, where)
    entries.write.mode("overwrite").partitionBy("series").parquet(broken.store.at("batches/2"))
    assert fold.JournalIngest(spark, where).read().count() == 30
    more = spark.createDataFrame([(40, T0, "unit9", "m40")], entries.schema)
    assert fold.JournalIngest(spark, where).ingest(more) == 1
    assert {r.series: r.n for r in fold.JournalIngest(spark, where).spans().collect()} == {"unit0": 10, "unit1": 10, "unit2": 10, "unit9": 1}


def test_log_lines_come_once(spark):
    """A log that grows at random and rotates at random: the lines taken are the lines written."""
    rng, where = random.Random(3), scratch.folder(spark, "logs")
    files, written, current, archives = scratch.Store(spark, where), [], "", 0
    for _ in range(8):
        for _ in range(rng.randint(0, 4)):
            written.append(f"line {len(written)} {'x' * rng.randint(0, 5)}")
            current += written[-1] + "\n"
        if rng.random() < 0.4 and current:
            archives += 1
            files.put(f"app.log.{archives}", current)
            written.append(f"line {len(written)} after")
            current = written[-1] + "\n"
        files.put("app.log", current + ("unfinish" if rng.random() < 0.5 else ""))
        fold.LogTail(spark, f"{where}-tail").ingest(f"{where}/app.log", f"{where}/app.log.[0-9]*" if archives else None)
    files.put("app.log", current)
    fold.LogTail(spark, f"{where}-tail").ingest(f"{where}/app.log", f"{where}/app.log.[0-9]*" if archives else None)
    assert sorted(r.line for r in fold.LogTail(spark, f"{where}-tail").lines().collect()) == sorted(written)
    if archives:
        files.put("app.log.1", "changed\n")
        with pytest.raises(ValueError):
            fold.LogTail(spark, f"{where}-tail").ingest(f"{where}/app.log", f"{where}/app.log.[0-9]*")


def test_exports_don_t_reuse_lost_files(spark):
    where, df = scratch.folder(spark, "export"), _points(spark, range(0, 96))
    days = export.export_changed(df, where, "ts", ["year", "month", "day"])[1]
    assert len(days) == 4 and export.export_changed(df, where, "ts", ["year", "month", "day"]) == (days, [], [])
    store = scratch.Store(spark, where)
    store.delete(days[1])
    with pytest.raises(export.CorruptExport):
        export.export_changed(df, where, "ts", ["year", "month", "day"])
    more = df.union(_points(spark, [200]))
    kept, written, _ = export.export_changed(more, where, "ts", ["year", "month", "day"])
    assert days[1] in written and len(kept) == 3 and spark.read.parquet(where).count() == 97


def test_table_log(spark):
    log = tablelog.TableLog(spark, scratch.folder(spark, "log"))
    for k in range(5):
        log.append(spark.range(10 * k, 10 * k + 10).coalesce(1))
    ids = lambda df: sorted(r.id for r in df.collect())
    assert ids(log.read()) == list(range(50)) and ids(log.read(1)) == list(range(20))
    many = len(log.live())
    log.checkpoint()
    assert log.compact(1 << 20) == 5 and len(log.live()) == 1 and ids(log.read()) == list(range(50)) and ids(log.read(2)) == list(range(30))
    assert log.compact(1 << 20) is None
    with pytest.raises(tablelog.ConcurrentCommit):
        log._commit(5, "append", {}, [])
    assert len(log.vacuum()) == many and ids(log.read()) == list(range(50))
    log.append(spark.range(50, 60).coalesce(1))
    assert ids(log.read()) == list(range(60)) and log.history().where("not added").count() == many


def test_queries_hold_braces(spark):
    df = spark.createDataFrame([(1, '{"a": 5}')], "id int, j string")
    assert views.sql_view(spark, {"t": df}, """SELECT id, get_json_object(j, '$.a') AS a FROM t WHERE j = '{"a": 5}' AND '{x}' <> '}'""").collect() == [(1, "5")]
    assert views.sql_view(spark, {"t": df}, "with u as (select id + 1 as k from t) select k from u").first().k == 2
    assert not [v for v in spark.catalog.listTables() if v.name.startswith("strandline_")]


@pytest.mark.parametrize("kind", ["gzip", "bzip2", "zstd"])
def test_addresses_decide_on_compression(spark, tmp_path, kind):
    import bz2
    import gzip

    import zstandard

    pack = {"gzip": gzip.compress, "bzip2": bz2.compress, "zstd": zstandard.ZstdCompressor().compress}[kind]
    (tmp_path / "c.dat").write_bytes(pack(b'{"a": 1}\n{"a": "\xc3\xa9"}\n'))
    (tmp_path / "t.dat").write_bytes(pack(b"a;b\n1;2\n3;4\n"))
    (tmp_path / "p.dat").write_bytes(pack(b'<table><tr class="dataHeader"><td>Date Time</td><td>x</td></tr>\n<tr class="data"><td>d</td><td>2.5</td></tr></table>'))
    assert [r.a for r in formats.read(spark, f"jsonlogs+{kind}://{tmp_path}/c.dat").collect()] == ["1", "é"]
    assert [tuple(r) for r in formats.read(spark, f"csv+{kind}://{tmp_path}/t.dat?delimiter=;").collect()] == [(1, 2), (3, 4)]
    assert formats.read(spark, f"excelhtml+{kind}://{tmp_path}/p.dat").first().x == 2.5


def test_web_log_lines(spark):
    good = '1.2.3.4 - bob [10/Oct/2000:13:55:36 -0700] "GET /a.gif HTTP/1.0" 200 2326'
    lines = [good, good + ' "http://x/ y" "Mozilla/4.08 [en] (Win98; I)"', good + ' "-" "a \\"b\\" c"', good + ' "http://x"', good + " and more than that", "no log", good.replace("200", "ok"), good.replace("2326", "-"), good.replace("[", "")]
    got = formats.web_log(spark.createDataFrame([(x,) for x in lines], "value string")).collect()
    assert [r.http_user_agent for r in got] == [None, "Mozilla/4.08 [en] (Win98; I)", 'a "b" c', None, None]
    assert [r.http_referer for r in got] == [None, "http://x/ y", None, "http://x", None] and [r.body_bytes_sent for r in got] == [2326] * 4 + [0]
    assert all((r.remote_addr, r.remote_user, r.method, r.path, r.protocol, r.status) == ("1.2.3.4", "bob", "GET", "/a.gif", "HTTP/1.0", 200) for r in got)


def test_overlaps_match_brute_force(spark):
    rng = random.Random(6)
    day = lambda n: dt.date(2020, 1, 1) + dt.timedelta(days=n)
    rows = []
    for i in range(80):
        a = rng.randrange(900)
        rows.append((i % 5, i, day(a), None if rng.random() < 0.2 else day(a + rng.randrange(200))))
    got = {(r.k, r.a_id, r.b_id) for r in joins.overlapping(spark.createDataFrame(rows, "k int, i int, b date, e date"), "k", "i", "b", "e").collect()}
    far = dt.date(9999, 1, 1)
    assert got == {(x[0], x[1], y[1]) for x in rows for y in rows if x[0] == y[0] and x[1] < y[1] and x[2] <= (y[3] or far) and y[2] <= (x[3] or far)}
    assert joins.overlapping(spark.createDataFrame([], "k int, i int, b date, e date"), "k", "i", "b", "e").count() == 0


def test_bills_are_posted_and_undone(spark):
    bills = spark.createDataFrame([(1, 7, 500), (2, 8, 250)], "connection_id long, customer_id long, bill_cents long")
    legs = ledger.issue(bills, 9, "2024-01-31")
    assert [(r.leg_seq, r.account_code, r.customer_id, r.debit_cents, r.credit_cents) for r in legs.orderBy("leg_seq").collect()] == [(0, 1100, 7, 500, 0), (1, 4000, None, 0, 500), (2, 1100, 8, 250, 0), (3, 4000, None, 0, 250)]
    back = ledger.reverse(legs, 9, 10, "2024-02-01")
    assert ledger.unbalanced(back).count() == 0 and all(r.balance_cents == 0 for r in ledger.balances(legs.union(back)).collect())
    for wrong in (lambda: ledger.reverse(legs, 11, 12, "2024-02-01"), lambda: ledger.issue(bills.withColumn("customer_id", F.lit(None).cast("long")), 1, "2024-01-31")):
        with pytest.raises(ValueError):
            wrong()


def test_logarithms_and_halves_as_sql_has_them(spark, tmp_path):
    odd = [0.0, -0.0, -2.5, None, float("nan"), float("inf"), float("-inf"), 1.7e308, 5e-324, 430.88075, 121.81925, -318.61625, 0.00003, 1000.0]
    con = duckdb.connect()
    con.execute("CREATE TABLE events AS SELECT unnest(range(len($v))) AS event_id, unnest($v::DOUBLE[]) AS value", {"v": odd})
    con.execute(f"COPY events TO '{tmp_path}/events.parquet'")
    queries, sql = catalog.load()
    got = {r.event_id: tuple(map(repr, r)) for r in queries["fn_math"](spark, str(tmp_path)).collect()}
    assert got == {r[0]: tuple(map(repr, r)) for r in con.execute(sql["fn_math"]).fetchall()}
