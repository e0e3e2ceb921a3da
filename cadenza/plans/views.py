"""SQL access: the domain tables and the reports as temporary views.

The source defines its reports as views (MonthlyLessonSummary,
StudentSiblingSummary, InstructorLessonSummary, EnsemblesNextWeekSummary) and
reads them with plain SELECTs. ``register_views`` does the same for a Spark
session: every domain table passed in becomes a view, and each report becomes a
view over them, so ``spark.sql("SELECT * FROM MonthlyLessonSummary ORDER BY
Month_Num")`` works. The views are lazy plans; Catalyst inlines them.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame

from cadenza.operators import reports


def register_views(tables: dict[str, DataFrame], year: int, as_of: _dt.date | str | None = None,
                   min_lessons: int = 0, instructor_lesson: DataFrame | None = None) -> list[str]:
    """Register ``tables`` (domain names) and the report views; returns the view names.

    ``instructor_lesson``: the lessons that instructors are counted by, if not ``lesson``.
    """
    for name, df in tables.items():
        df.createOrReplaceTempView(name)
    t = tables
    views = {
        "MonthlyLessonSummary": reports.monthly_lesson_summary(
            t["lesson"], t["individual_lesson"], t["group_lesson"], t["ensembles_lesson"], year),
        "StudentSiblingSummary": reports.student_sibling_summary(t["student"], t["sibling"]),
        "InstructorLessonSummary": reports.instructor_lesson_summary(
            t["instructor"], t["person"], t["lesson"] if instructor_lesson is None else instructor_lesson, as_of, min_lessons),
        "EnsemblesNextWeekSummary": reports.ensembles_next_week(
            t["lesson"], t["ensembles_lesson"], t["student_lessons"], as_of),
    }
    for name, df in views.items():
        df.createOrReplaceTempView(name)
    return list(tables) + list(views)
