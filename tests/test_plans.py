"""Plan shape: pushed date ranges, pruned scans, no Python UDF, no unpartitioned window."""

import contextlib
import io
import re

import pytest

from __spark_entry__ import queries

SF = "/root/testdata/sf0.001"


def _plan(df, mode="formatted"):
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain(mode)
    return buf.getvalue()


def test_monthly_report_pushes_year_range(spark):
    p = _plan(queries()["monthly_lesson_summary"](spark, SF))
    assert "GreaterThanOrEqual(o_orderdate" in p and "LessThan(o_orderdate" in p
    assert "ReadSchema: struct<o_orderkey:bigint,o_orderdate:timestamp_ntz>" in p


def test_instructor_report_pushes_month_range(spark):
    p = _plan(queries()["instructor_lesson_summary"](spark, SF))
    assert "GreaterThanOrEqual(l_shipdate" in p and "LessThan(l_shipdate" in p


@pytest.mark.parametrize("key", ["monthly_lesson_summary", "lesson_history", "payment_denorm", "seat_status",
                                 "ensembles_next_week", "sibling_histogram", "fk_violations", "cascade_delete",
                                 "stock_admission", "assign_ids", "price_currency"])
def test_no_python_and_no_global_window(spark, key):
    p = _plan(queries()[key](spark, SF), "extended")
    assert "BatchEvalPython" not in p and "ArrowEvalPython" not in p
    # a global aggregate may finish in one partition after partial aggregation; a window may not
    assert not re.search(r"Window \[.*\], \[\], \[", p)


def test_prefix_count_plan_is_bucketed_and_bounded(spark):
    from cadenza.operators.scan import earlier_count

    li = spark.read.parquet(f"{SF}/lineitem.parquet").select("l_partkey", "l_orderkey", "l_linenumber")
    p = _plan(earlier_count(li, ["l_partkey"], ["l_orderkey", "l_linenumber"], out="e"), "extended")
    # the window is partitioned by the pinned range and the key, never by the key alone
    assert re.search(r"Window \[.*\], \[_scan_bucket#\d+, l_partkey#\d+L?\]", p), p
    assert "SortAggregate" not in p and "BroadcastHashJoin" in p
    assert "BatchEvalPython" not in p and "PythonMapInArrow" not in p and "MapInArrow" not in p
