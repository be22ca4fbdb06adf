"""Every query against its SQL on the smallest tables."""

import datetime
import decimal
import glob
import os

import duckdb
import pytest

from strandline import catalog

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = catalog.load()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def plain(v):
    if isinstance(v, bool) or v is None:
        return repr(v)
    if isinstance(v, (float, decimal.Decimal)):
        return repr(float(v) + 0.0)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return repr(v)


def rows(found, columns):
    order = [columns.index(c) for c in sorted(columns)]
    return sorted(tuple(plain(r[i]) for i in order) for r in found)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(name, spark, duck):
    df = QUERIES[name](spark, SF)
    result = duck.execute(ORACLES[name])
    columns = [c[0] for c in result.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows([tuple(r) for r in df.collect()], df.columns) == rows(result.fetchall(), columns)


def splitmix(seed):
    """The published generator, as its definition has it."""
    state = seed
    while True:
        state = (state + 0x9E3779B97F4A7C15) % 2**64
        z = state
        z = (z ^ z >> 30) * 0xBF58476D1CE4E5B9 % 2**64
        z = (z ^ z >> 27) * 0x94D049BB133111EB % 2**64
        yield z ^ z >> 31


def shuffled(n, seed):
    out, draw = list(range(n)), splitmix(seed)
    for i in range(n - 1, 0, -1):
        j = next(draw) % (i + 1)
        out[i], out[j] = out[j], out[i]
    return out


def shares(total, weights, seed):
    whole = [int(total * w / sum(weights)) for w in weights]
    for i in shuffled(len(weights), seed)[: total - sum(whole)]:
        whole[i] += 1
    return whole


def allocate(duck):
    n = duck.execute("SELECT s_suppkey FROM supplier ORDER BY 1").fetchall()
    weights = [float(k % 5 + 1) for (k,) in n]
    return [(i, w, x) for i, (w, x) in enumerate(zip(weights, shares(1_234_567 + 123_456, weights, 820454400000000000), strict=True))]


def bill(duck):
    from strandline.catalog.series import TENANCIES

    live = duck.execute(f"SELECT connection_id, customer_id FROM {TENANCIES} WHERE start_date <= DATE '1996-06-30' AND (end_date IS NULL OR DATE '1996-06-30' < end_date) AND connection_id <> 3 ORDER BY 1").fetchall()
    return [(a, b, x) for (a, b), x in zip(live, shares(1_000_000, [float(a % 4 + 1) for a, _ in live], 836092800000000000), strict=True)]


def finished_windows(duck):
    rows = duck.execute("SELECT time_bucket(INTERVAL '4 hours', ts, TIMESTAMP '1970-01-01') AS t, count(*) FROM events GROUP BY 1").fetchall()
    last = duck.execute("SELECT max(ts) - INTERVAL 1 DAY FROM events").fetchone()[0]
    return [(t, n) for t, n in rows if t + datetime.timedelta(hours=4) <= last]


#: What queries that SQL can't express give, worked out row by row.
EXPECTED = {"ac_allocate": allocate, "ac_bill_compute": bill, "ac_shuffle": lambda duck: [(s, shuffled(12, s)) for s in (0, 1, 820454400000000000)], "st_tumbling_append": finished_windows}


@pytest.mark.parametrize("name", sorted(EXPECTED))
def test_matches_expected(name, spark, duck):
    got = sorted(map(tuple, QUERIES[name](spark, SF).collect()), key=repr)
    assert got == sorted(EXPECTED[name](duck), key=repr)


def test_segments_hold_every_event(spark, duck):
    rows = QUERIES["ov_segments"](spark, SF).collect()
    assert all(r.first_ms <= r.last_ms and r.n > 0 for r in rows) and {r.user_id for r in rows} == {u for (u,) in duck.execute("SELECT DISTINCT user_id FROM events").fetchall()}


def test_every_query_is_held_against_something():
    assert set(QUERIES) - set(ORACLES) - set(EXPECTED) == {"ov_segments"}
