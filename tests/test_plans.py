"""The plans that the operators should get: what reaches the scan, and which joins are never planned."""

import re

import pytest
from pyspark.sql import functions as F

from strandline import catalog
from strandline.operators import transforms
from strandline.plans import export, reduce, scratch

SF = "/root/testdata/sf0.001"
QUERIES, _ = catalog.load()


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_filters_and_columns_reach_the_scan(spark):
    df = transforms.rename(spark.read.parquet(f"{SF}/lineitem.parquet"), [{"type": "pattern", "pattern": "^l_", "replacement": ""}])
    df = transforms.scope(transforms.pad(df, {"more": "double"}), "s", "shipdate").where("`s.quantity` > 45").select("`s.orderkey`")
    text = plan(df)
    assert re.search(r"PushedFilters: \[[^\]]*GreaterThan\(l_quantity,45", text)
    assert re.search(r"ReadSchema: struct<l_orderkey:bigint,l_quantity:double>", text)


def test_reduction_reads_two_columns_and_shuffles_once(spark):
    out = reduce.single_pass(spark.read.parquet(f"{SF}/events.parquet"), "ts", "1h", [{"type": "avg", "columns": ["value"]}])
    text = plan(out.select("ts", "`value.avg`"))
    assert "ReadSchema: struct<ts:timestamp_ntz,value:double>" in text
    assert text.count("Exchange hashpartitioning") == 1


def test_calendar_partitions_are_pruned(spark):
    where = scratch.folder(spark, "p")
    export.export(spark.read.parquet(f"{SF}/events.parquet"), where, "ts", ["year", "month", "day"])
    text = plan(spark.read.parquet(where).where("day = 3"))
    assert re.search(r"PartitionFilters: \[[^\]]*day#\d+ = 3", text)


@pytest.mark.parametrize("name", ["ts_join", "validity_join", "effective_dated_join", "self_range_join", "ac_aging", "ac_cycle_totals", "q_duty_cycle", "kv_latest", "interval_join_asof_cycle"])
def test_no_pairwise_joins(name, spark):
    text = plan(QUERIES[name](spark, SF))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_pushed_bound_of_a_merge(spark):
    where = scratch.folder(spark, "m")
    wanted = [("avg", "value")]
    reduce.partials(spark.read.parquet(f"{SF}/events.parquet"), "ts", "1h", wanted).write.parquet(where)
    text = plan(reduce.merge(spark.read.parquet(where), "6h", wanted, low=1705000000))
    assert "GreaterThanOrEqual(_bucket" in text
    assert reduce.merge(spark.read.parquet(where), "6h", wanted, low=4_000_000_000).agg(F.count(F.lit(1))).first()[0] == 0


def test_allocation_covers_every_supplier(spark):
    sf = "/root/testdata/sf0.01"
    rows = QUERIES["ac_allocate"](spark, sf).collect()
    assert len(rows) == scratch.table(spark, sf, "supplier").count() > 20
    assert sum(r.share_cents for r in rows) == 1_234_567 + 123_456
