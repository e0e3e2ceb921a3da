"""Sinks: append of the three history inserts, partitioned write of the generated columns."""

import contextlib
import io

from pyspark.sql import functions as F

from cadenza.operators import denorm, reports
from cadenza.sources.schemas import PRIMARY_KEYS
from cadenza.sources.sinks import write_snapshot


def test_three_inserts_appended_equal_one_pass(fx, spark, tmp_path):
    whole = denorm.lesson_history(fx["lesson"], fx["individual_lesson"], fx["group_lesson"],
                                  fx["ensembles_lesson"], fx["student_lessons"], fx["student"], fx["person"],
                                  fx["person_email"], fx["email"], fx["lesson_price_history"])
    path = str(tmp_path / "history")
    for kind in ("Individual", "Group", "Ensemble"):       # INSERT INTO ... SELECT, one per subtype
        write_snapshot(whole.filter(F.col("lesson_type") == kind), path, keys=PRIMARY_KEYS["history_lesson"],
                       mode="append")
    back = spark.read.parquet(path)
    assert back.count() == 31
    from cadenza.sources.sinks import KeyViolation
    try:                                                    # re-running one insert hits the key
        write_snapshot(whole.filter(F.col("lesson_type") == "Group"), path, keys=PRIMARY_KEYS["history_lesson"],
                       mode="append")
        raise AssertionError("expected a key violation")
    except KeyViolation:
        pass
    assert back.exceptAll(whole).count() == 0 and whole.exceptAll(back).count() == 0


def test_generated_columns_prune_partitions(fx, spark, tmp_path):
    path = str(tmp_path / "lessons")
    write_snapshot(reports.lesson_generated_cols(fx["lesson"]), path, partition_by=["lesson_year", "lesson_month"])
    q = spark.read.parquet(path).filter((F.col("lesson_year") == 2024) & (F.col("lesson_month") == 11))
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        q.explain("formatted")
    assert "PartitionFilters" in buf.getvalue() and "lesson_month" in buf.getvalue()
    assert q.count() == 12
