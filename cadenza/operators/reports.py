"""The four reports, the sibling summaries and the generated columns.

Every function takes domain DataFrames and parameters and returns a lazy
DataFrame. Date parameters become half-open ranges so the scan receives both
bounds as PushedFilters; aggregations that feed a join are computed first, so a
lesson or student with many rows never fans out through a join.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.functions import day_abbrev, dow_sunday0, in_month, in_year, month_abbrev, to_date


def monthly_lesson_summary(lesson: DataFrame, individual: DataFrame, group: DataFrame,
                           ensemble: DataFrame, year: int) -> DataFrame:
    """Lessons per month of ``year``: Total and the count per subtype.

    Three left joins on unique subtype keys act as membership flags (no fan-out);
    a lesson without a subtype still counts in Total.
    """
    l = lesson.select("lesson_id", "start_date").filter(in_year("start_date", year))
    i = individual.select(F.col("lesson_id").alias("_i"))
    g = group.select(F.col("lesson_id").alias("_g"))
    e = ensemble.select(F.col("lesson_id").alias("_e"))
    joined = (l.join(i, l.lesson_id == i._i, "left")
              .join(g, l.lesson_id == g._g, "left")
              .join(e, l.lesson_id == e._e, "left"))
    agg = (joined.groupBy(F.month("start_date").alias("Month_Num"))
           .agg(F.min("start_date").alias("_any"),
                F.count(F.lit(1)).alias("Total"),
                F.count("_i").alias("Individual"),
                F.count("_g").alias("Group"),
                F.count("_e").alias("Ensemble")))
    return (agg.select(month_abbrev("_any").alias("Month"), "Month_Num", "Total", "Individual",
                       "Group", "Ensemble")
            .orderBy("Month_Num"))


def sibling_closure(edges: DataFrame) -> DataFrame:
    """Symmetric closure of the sibling relation: every (a, b) also as (b, a); no self pairs."""
    e = edges.select("student_id", "sibling_id").filter(F.col("student_id") != F.col("sibling_id"))
    swapped = e.select(F.col("sibling_id").alias("student_id"), F.col("student_id").alias("sibling_id"))
    return e.unionByName(swapped).distinct()


def student_sibling_summary(student: DataFrame, sibling: DataFrame) -> DataFrame:
    """student_id, number of distinct siblings (0 when none)."""
    counts = (sibling.select("student_id", "sibling_id").distinct()
              .groupBy("student_id").agg(F.count("sibling_id").alias("_n")))
    return (student.select("student_id").join(counts, "student_id", "left")
            .select("student_id", F.coalesce("_n", F.lit(0)).cast("bigint").alias("sibling_count")))


def sibling_histogram(student: DataFrame, sibling: DataFrame) -> DataFrame:
    """How many students have 0, 1, 2, ... siblings."""
    s = student_sibling_summary(student, sibling)
    return (s.groupBy(F.coalesce("sibling_count", F.lit(0)).alias("No_of_Siblings"))
            .agg(F.count("student_id").alias("No_of_Students"))
            .select("No_of_Students", "No_of_Siblings")
            .orderBy("No_of_Siblings"))


def instructor_lesson_summary(instructor: DataFrame, person: DataFrame, lesson: DataFrame,
                              as_of: _dt.date | str | None = None, min_lessons: int = 0) -> DataFrame:
    """Instructors with more than ``min_lessons`` lessons in the month of ``as_of``."""
    day = to_date(as_of)
    counts = (lesson.select("lesson_id", "start_date", "instructor_id")
              .filter(in_month("start_date", day))
              .groupBy("instructor_id").agg(F.count("lesson_id").alias("No_of_Lessons"))
              .filter(F.col("No_of_Lessons") > F.lit(min_lessons)))
    named = (instructor.select("instructor_id", "person_id")
             .join(person.select("person_id", "first_name", "last_name"), "person_id", "inner"))
    return (counts.join(named, "instructor_id", "inner")
            .select(F.col("instructor_id").alias("Instructor_ID"),
                    F.col("first_name").alias("First_Name"),
                    F.col("last_name").alias("Last_Name"),
                    "No_of_Lessons")
            .orderBy(F.desc("No_of_Lessons"), "Instructor_ID"))


def free_seat_band(free) -> F.Column:
    return (F.when(free <= 0, "No Seats").when(free <= 2, "1 or 2 Seats").otherwise("Many Seats"))


def ensembles_next_week(lesson: DataFrame, ensemble: DataFrame, enrolments: DataFrame,
                        as_of: _dt.date | str | None = None) -> DataFrame:
    """Ensembles starting between ``as_of`` and ``as_of + 7 days`` (inclusive) with a free-seat band.

    Enrolments are reduced to the week's lessons before counting, so the count
    never aggregates the whole enrolment table.
    """
    day = to_date(as_of)
    week = (lesson.select("lesson_id", "start_date")
            .filter(F.col("start_date").between(F.lit(day), F.lit(day + _dt.timedelta(days=7))))
            .join(ensemble.select("lesson_id", "genre", "max_students"), "lesson_id", "inner"))
    counts = (enrolments.select("lesson_id", "student_id")
              .join(week.select("lesson_id"), "lesson_id", "left_semi")
              .groupBy("lesson_id").agg(F.count("student_id").alias("_n")))
    out = week.join(counts, "lesson_id", "left")
    free = F.col("max_students") - F.coalesce("_n", F.lit(0))
    return (out.select(F.col("lesson_id").alias("Lesson_ID"),
                       day_abbrev("start_date").alias("Day"),
                       F.col("genre").alias("Genre"),
                       free_seat_band(free).alias("No_of_Free_Seats"),
                       dow_sunday0("start_date").alias("_day_order"))
            .orderBy("_day_order", "Genre", "Lesson_ID")
            .drop("_day_order"))


def lesson_generated_cols(lesson: DataFrame) -> DataFrame:
    """The stored generated columns lesson_year / lesson_month (usable as partition columns)."""
    return (lesson.select("lesson_id", "start_date")
            .withColumn("lesson_year", F.year("start_date"))
            .withColumn("lesson_month", F.month("start_date")))


def seat_status(ensemble: DataFrame, enrolments: DataFrame | None = None) -> DataFrame:
    """Seat status of every ensemble: 'No Seats' / 'Few Seats' / 'Many Seats'.

    With ``enrolments`` the live enrolment count replaces the stored
    ``current_students`` (which defaults to 0 and is never maintained).
    """
    e = ensemble.select("lesson_id", "max_students",
                        F.coalesce(F.col("current_students"), F.lit(0)).alias("current_students"))
    if enrolments is not None:
        live = enrolments.groupBy("lesson_id").agg(F.count("student_id").cast("int").alias("_n"))
        e = (e.join(live, "lesson_id", "left")
             .withColumn("current_students", F.coalesce("_n", F.lit(0))).drop("_n"))
    cur, mx = F.col("current_students"), F.col("max_students")
    status = (F.when(cur >= mx, "No Seats").when(cur >= mx - 2, "Few Seats").otherwise("Many Seats"))
    return e.withColumn("seat_status", status)
