"""Differential test: every registered query vs its DuckDB oracle (sf0.001),
plus plan-shape assertions on the physical plans."""

import re

import duckdb
import pytest

from orrery.plans import catalog
from orrery.sources.tables import DRIVER_TABLES
from tools.oracle_check import rows

SF = "/root/testdata/sf0.001"
catalog.load_all()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in DRIVER_TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_matches_oracle(spark, con, name):
    sp = catalog.QUERIES[name](spark, SF).toPandas()
    dd = con.execute(catalog.ORACLES[name]).df()
    assert sorted(sp.columns) == sorted(dd.columns)
    assert len(sp) == len(dd)
    assert rows(sp, 6) == rows(dd, 6)


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_plan_has_no_cross_join_or_python(spark, name):
    p = _plan(catalog.QUERIES[name](spark, SF))
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython",
                "FlatMapGroupsInPandas"):
        assert bad not in p, f"{name}: {bad}"


def test_scan_prunes_columns(spark):
    p = _plan(catalog.QUERIES["semi_join"](spark, SF))
    schemas = re.findall(r"ReadSchema: (struct<[^>]*>)", p)
    assert schemas and all("c_acctbal" not in x and "o_totalprice" not in x for x in schemas)
    p = _plan(catalog.QUERIES["hourly_buckets"](spark, SF))
    assert re.findall(r"ReadSchema: (struct<[^>]*>)", p) == ["struct<ts:timestamp_ntz,user_id:bigint,event_type:string>"]


def test_filter_pushed_to_scan(spark):
    p = _plan(catalog.QUERIES["semi_join"](spark, SF))
    assert "PushedFilters: [IsNotNull(o_orderstatus), EqualTo(o_orderstatus,F)" in p


def test_spatial_join_is_equi_join_on_cells(spark):
    p = _plan(catalog.QUERIES["spatial_support"](spark, SF))
    assert "Join" in p and "__cx" in p and "CartesianProduct" not in p


def test_clean_series_single_exchange(spark):
    p = _plan(catalog.QUERIES["clean_series"](spark, SF))
    assert p.count("Exchange hashpartitioning") == 1


@pytest.mark.parametrize("name", ["clean_series_chunked", "state_sessions_chunked", "rolling_8h_rate_chunked",
                                  "lag_deltas", "cycle_history"])
def test_chunked_windows_partition_by_entity_and_chunk(spark, name):
    """Row-level windows are partitioned by (user, chunk); windows partitioned
    by the user alone only run over the per-(user, chunk) boundary tables,
    ordered by chunk."""
    p = _plan(catalog.QUERIES[name](spark, SF))
    specs = re.findall(r"Window \[.*?\], \[([^\]]*)\], \[([^\]]*)\]", p)
    entity = [(part, order) for part, order in specs if "user_id" in part]
    assert entity, specs
    assert any("__chunk" in part for part, _ in entity)
    assert all("__chunk" in part or order.startswith("__chunk") for part, order in entity), entity
