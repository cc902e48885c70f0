"""Every registered query of the condition-monitoring part against its SQL; without SQL, that it has rows."""

import pytest

from compare import rows_of_frame, rows_of_sql, views
from tremora.plans import catalogue

QUERIES, SQL = catalogue.queries(), catalogue.oracle_sql()


@pytest.fixture(scope="module")
def connection(sf):
    return views(sf)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, sf, connection):
    frame = QUERIES[name](spark, sf)
    names = sorted(frame.columns)
    got = rows_of_frame(frame, names)
    if name in SQL:
        assert sorted(connection.sql(SQL[name]).columns) == names
        assert got == rows_of_sql(connection, SQL[name], names)
    assert got or name in (
        "electrical_vibration_interval",
        "stream_interval_join",
        "rate_limit_1m",
        "outlier_mad",
        "stream_silent_devices",
        "criticality_page"
    )


def test_entry_has_a_query_for_every_sql():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_filters_and_columns_reach_the_scan(spark, sf):
    plan = QUERIES["workorder_filter"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull" in plan and "o_totalprice" not in plan
    assert "Python" not in QUERIES["window_features_sliding"](spark, sf)._jdf.queryExecution().executedPlan().toString()
