"""Plan shape of every registered query (physical plan before execution):
the properties that matter at 100 TB, checked on the small fixture."""

import pytest

from airlake.plans import registry
from conftest import SF_MID

FACTS = ("lineitem", "orders", "events")
# keys that run jobs while they are built: checkpoints of a shared table (lines
# numbered once for several readers), tables written and read back, a drained
# stream, a probe of the region dimension or of one city's rows
EAGER = {"model_backtest", "model_forecast", "forecast_verdict", "forecast_status", "event_headline",
         "stream_daily_mean", "stream_closed_days", "region_filter", "hourly_parse", "curated_split",
         "city_table_rerun", "recent_clean", "station_registry", "one_city", "interval_coverage"}
QUERIES = registry.all_queries()
KEYS = sorted(QUERIES)


def _walk(node):
    yield node
    ch = node.children()
    for i in range(ch.size()):
        yield from _walk(ch.apply(i))


def _leaves(node):
    return [n for n in _walk(node) if n.children().size() == 0]


def _tables(node):
    out = set()
    for leaf in _leaves(node):
        s = leaf.toString()
        out |= {t for t in FACTS if f"/{t}.parquet" in s}
    return out


@pytest.fixture(scope="module")
def plans(spark):
    return {k: QUERIES[k](spark, SF_MID)._jdf.queryExecution().sparkPlan() for k in KEYS}


@pytest.mark.parametrize("key", sorted(set(KEYS) - EAGER))
def test_building_starts_no_job(spark, key):
    sc = spark.sparkContext
    sc.setJobGroup(f"build {key}", key)
    QUERIES[key](spark, SF_MID)
    assert not sc.statusTracker().getJobIdsForGroup(f"build {key}")


@pytest.mark.parametrize("key", KEYS)
def test_no_cartesian_no_nested_loop_no_row_udf(plans, key):
    names = {n.nodeName() for n in _walk(plans[key])}
    assert not names & {"CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython"}, names


@pytest.mark.parametrize("key", KEYS)
def test_fact_tables_never_broadcast(plans, key):
    for n in _walk(plans[key]):
        if n.nodeName() == "BroadcastHashJoin":
            side = n.buildSide().toString()
            build = n.left() if "Left" in side else n.right()
            if _tables(build):
                # allowed only when reduced by an aggregate first: its size is
                # then bounded by groups and Spark's size check applies
                assert any("Aggregate" in m.nodeName() for m in _walk(build)), \
                    f"{key}: raw fact rows on the build side"


CUT = "LessThan(l_shipdate,2001-04-01T00:00)"


def test_splice_cutoff_reaches_the_scan(plans):
    assert f"PushedFilters: [IsNotNull(l_shipdate), {CUT}" in plans["splice_sources"].toString()


@pytest.mark.parametrize("key", sorted(set(KEYS) - {"splice_sources"}))
def test_only_the_splice_cuts_its_base(plans, key):
    assert CUT not in plans[key].toString()


@pytest.mark.parametrize("key", ["station_daily_8h", "city_daily", "city_headline", "region_filter"])
def test_raw_table_is_scanned_once(plans, key):
    leaves = [n.toString() for n in _leaves(plans[key])]
    assert sum("/lineitem.parquet" in s or "/events.parquet" in s for s in leaves) == 1


def test_scan_reads_only_needed_columns(plans):
    text = plans["sub_indices"].toString()
    scan = [l for l in text.splitlines() if "lineitem.parquet" in l][0]
    assert "l_returnflag" not in scan and "l_linestatus" not in scan


def test_radius_search_is_an_equi_join(plans):
    joins = [n for n in _walk(plans["nearby_sensors"]) if "Join" in n.nodeName()]
    assert joins and all(n.nodeName() in ("BroadcastHashJoin", "SortMergeJoin", "ShuffledHashJoin")
                         for n in joins)


def test_event_window_join_is_an_equi_join(plans):
    names = [n.nodeName() for n in _walk(plans["festival_effect"])]
    assert "BroadcastHashJoin" in names


def test_splice_is_one_aggregate_not_chained_full_joins(plans):
    names = [n.nodeName() for n in _walk(plans["splice_sources"])]
    assert not any("Join" in n and "Broadcast" not in n for n in names), names


def test_top_n_is_limited_before_the_shuffle(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = QUERIES["nearby_sensors"](spark, SF_MID)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    lines = plan.splitlines()
    partial = [i for i, l in enumerate(lines) if "WindowGroupLimit" in l and "Partial" in l]
    exch = [i for i, l in enumerate(lines) if "Exchange hashpartitioning(city" in l]
    assert partial and exch and min(partial) > min(exch)   # partial limit sits below the exchange
