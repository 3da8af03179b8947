"""Every query with SQL gives the rows that DuckDB gives, on the smallest tables."""

from pathlib import Path

import pytest

import parity
from eventloom.plans import registry

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return parity.connect(FOLDER)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_parity(spark, con, name):
    ok, note = parity.compare(spark, con, registry.queries()[name], registry.oracle_sql()[name], FOLDER)
    assert ok, note


def test_scans_are_pruned_and_filters_pushed(spark):
    plan = registry.queries()["raw_events_lookback"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "payload:" not in plan and "GreaterThanOrEqual(event_timestamp" in plan


def test_first_arrivals_shuffles_once(spark):
    plan = registry.queries()["p1_found"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "payload" not in plan.split("ReadSchema")[1].split("\n")[0] and "Cartesian" not in plan


def test_sessions_are_the_same_without_pushdown(spark, tmp_path):
    """The filter on user events skips row groups; what is skipped holds none of them."""
    src = spark.read.parquet(f"{FOLDER}/raw_events.parquet").orderBy("event_type")
    src.coalesce(1).write.option("parquet.block.size", 20_000).option("parquet.page.size.row.check.min", 10).option("parquet.block.size.row.check.min", 10).parquet(str(tmp_path / "raw_events.parquet"))
    import pyarrow.parquet as pq

    (file,) = (tmp_path / "raw_events.parquet").glob("*.parquet")
    assert pq.ParquetFile(file).num_row_groups > 3
    read = lambda: sorted(map(tuple, registry.queries()["p2_found"](spark, str(tmp_path)).collect()))
    with_it = read()
    spark.conf.set("spark.sql.parquet.filterPushdown", "false")
    try:
        assert read() == with_it and len(with_it) > 50
    finally:
        spark.conf.unset("spark.sql.parquet.filterPushdown")


def test_small_dimensions_are_broadcast_and_large_sides_are_not(spark):
    plan = lambda q: registry.queries()[q](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan("active_tenant_view") and "Cartesian" not in plan("active_tenant_view")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert "SortMergeJoin" in plan("p6_found") and "Broadcast" not in plan("enriched_events")
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_window_metrics_scan_no_more_than_they_use(spark):
    plan = registry.queries()["metric_churn"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "marketing_spend" not in plan.split("ReadSchema")[1].split("\n")[0]
