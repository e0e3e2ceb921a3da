"""Sorted tables: the order across files, positions without a sort, pages, pruning; and keys as text."""

import os
import random

import pytest
from pyspark.sql import functions as F

from cadenza.operators import denorm, integrity
from cadenza.sources import sorted_store


def _plan(df):
    spark = df.sparkSession
    return df._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


@pytest.fixture(scope="module")
def history(spark):
    """One student holds 40 % of the rows."""
    rng = random.Random(4)
    rows = [(k, 7 if rng.random() < 0.4 else rng.randrange(100), rng.choice(["Group", "Ensemble"]), None, "x", None, f"n{k}", "m")
            for k in range(4000)]
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "lesson_id int, student_id int, lesson_type string, genre string, instrument string, "
                                       "lesson_price decimal(10,2), student_name string, student_email string")


@pytest.fixture(scope="module")
def stored(spark, history, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("history") / "sorted")
    denorm.store_lesson_history(history, path, ranges=12)
    return path


def test_files_are_in_order_and_split_a_hot_student(spark, history, stored):
    files = sorted_store.sorted_files(spark, stored).orderBy("first").collect()
    assert len(files) > 6 and sum(f.n for f in files) == 4000
    assert all(tuple(a.high) <= tuple(b.low) for a, b in zip(files, files[1:]))
    assert sum(f.low.student_id <= 7 <= f.high.student_id for f in files) >= 4
    assert max(f.n for f in files) < 1200


def test_positions_come_without_sort_or_shuffle(spark, history, stored):
    got = sorted_store.read_sorted(spark, stored)
    plan = _plan(got)
    assert "Sort" not in plan and "Window" not in plan and "hashpartitioning" not in plan and "rangepartitioning" not in plan
    want = sorted(map(tuple, history.select(*denorm.HISTORY_ORDER).collect()))
    rows = got.collect()
    assert sorted(r.position for r in rows) == list(range(4000))
    assert all(want[r.position] == (r.student_id, r.lesson_id, r.lesson_type, r.student_email) for r in rows)


def test_pages_read_their_files_only(spark, history, stored):
    want = sorted(map(tuple, history.select(*denorm.HISTORY_ORDER).collect()))
    page = sorted_store.read_page(spark, stored, 1990, 25)
    assert [tuple(r) for r in page.select(*denorm.HISTORY_ORDER).collect()] == want[1990:2015]
    assert len([f for f in page.inputFiles() if "/_files/" not in f]) <= 2      # of 12
    assert [r.position for r in sorted_store.read_page(spark, stored, 3995, 50).collect()] == list(range(3995, 4000))
    assert sorted_store.read_page(spark, stored, 4000, 5).count() == 0


def test_files_in_order_give_the_sorted_rows(spark, history, stored):
    rows = [tuple(r) for df in sorted_store.files_in_order(spark, stored) for r in df.select(*denorm.HISTORY_ORDER).collect()]
    assert rows == sorted(map(tuple, history.select(*denorm.HISTORY_ORDER).collect()))


def test_one_student_reads_few_rows(spark, stored):
    one = spark.read.parquet(stored).filter("student_id = 93").select("student_id", "lesson_id")
    rows = one.collect()
    read = one._jdf.queryExecution().executedPlan().collectLeaves().head().metrics().apply("numOutputRows").value()
    assert rows and read <= 800


def test_nulls_come_last_and_an_empty_table_is_empty(spark, tmp_path):
    path = str(tmp_path / "t")
    sorted_store.write_sorted(spark.createDataFrame([(None, 1), (2, 2), (1, 3), (None, 0)], "a int, b int"), path, ["a", "b"], 2)
    got = sorted_store.read_sorted(spark, path, "at").orderBy("at").collect()
    assert [(r.a, r.b) for r in got] == [(1, 3), (2, 2), (None, 0), (None, 1)]
    sorted_store.write_sorted(spark.createDataFrame([], "a int, b int"), path, ["a", "b"])
    assert sorted_store.read_sorted(spark, path).count() == 0 and sorted_store.read_page(spark, path, 0, 5).count() == 0
    assert "_files" in os.listdir(path)


def test_composite_keys_as_text_are_told_apart(spark):
    rows = spark.createDataFrame([("a,b", "c"), ("a", "b,c"), ("a\\", ",b")], "x string, y string")
    assert len({r[0] for r in rows.select(integrity.key_text(["x", "y"])).collect()}) == 3
    assert rows.select(integrity.key_text(["x"])).first()[0] == "a,b"
    assert spark.createDataFrame([(1, "ADDR")], "x int, y string").select(integrity.key_text(["x", "y"])).first()[0] == "1,ADDR"
