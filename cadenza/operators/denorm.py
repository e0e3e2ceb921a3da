"""Denormalisation jobs: lesson history and payment enrichment.

The three per-subtype INSERT ... SELECT statements of the lesson history share
seven joins; here the subtypes are first stacked into one tagged table, so the
enrolment fact is joined once. A lesson listed under two subtypes still yields
one row per subtype, exactly like the three separate inserts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.functions import pg_concat, whole_days
from cadenza.sources.sorted_store import write_sorted

HISTORY_COLUMNS = ("lesson_id", "student_id", "lesson_type", "genre", "instrument", "lesson_price",
                   "student_name", "student_email")
HISTORY_ORDER = ("student_id", "lesson_id", "lesson_type", "student_email")


def _tagged_subtypes(individual: DataFrame, group: DataFrame, ensemble: DataFrame) -> DataFrame:
    none = F.lit(None).cast("string")
    return (individual.select("lesson_id", F.lit("Individual").alias("lesson_type"), none.alias("genre"),
                              F.lit(True).alias("_keep_instrument"))
            .unionByName(group.select("lesson_id", F.lit("Group").alias("lesson_type"), none.alias("genre"),
                                      F.lit(True).alias("_keep_instrument")))
            .unionByName(ensemble.select("lesson_id", F.lit("Ensemble").alias("lesson_type"),
                                         F.col("genre").cast("string").alias("genre"),
                                         F.lit(False).alias("_keep_instrument"))))


def lesson_history(lesson: DataFrame, individual: DataFrame, group: DataFrame, ensemble: DataFrame,
                   enrolments: DataFrame, student: DataFrame, person: DataFrame, person_email: DataFrame,
                   email: DataFrame, lesson_price: DataFrame) -> DataFrame:
    """One row per (enrolment, subtype of its lesson) with price, student name and email.

    Inner joins throughout, as in the source: students without an email, and
    lessons without a subtype or price row, drop out.
    """
    lessons = (lesson.select("lesson_id", "instrument_type", "lesson_price_id")
               .join(_tagged_subtypes(individual, group, ensemble), "lesson_id", "inner")
               .join(lesson_price.select("lesson_price_id", "skill_level_price", "lesson_type_price"),
                     "lesson_price_id", "inner")
               .select("lesson_id", "lesson_type", "genre",
                       F.when(F.col("_keep_instrument"), F.col("instrument_type").cast("string"))
                       .alias("instrument"),
                       (F.col("skill_level_price") + F.col("lesson_type_price")).cast("decimal(10,2)")
                       .alias("lesson_price")))
    people = (student.select("student_id", "person_id")
              .join(person.select("person_id", "first_name", "last_name"), "person_id", "inner")
              .join(person_email.select("person_id", "email_id"), "person_id", "inner")
              .join(email.select("email_id", "email"), "email_id", "inner")
              .select("student_id", pg_concat("first_name", F.lit(" "), "last_name").alias("student_name"),
                      F.col("email").alias("student_email")))
    return (enrolments.select("lesson_id", "student_id")
            .join(lessons, "lesson_id", "inner")
            .join(people, "student_id", "inner")
            .select(*HISTORY_COLUMNS))


def lesson_history_report(history: DataFrame) -> DataFrame:
    """SELECT * FROM history_lesson ORDER BY student_id (lesson_id breaks ties for a stable order)."""
    return history.orderBy("student_id", "lesson_id", "lesson_type")


def store_lesson_history(history: DataFrame, path: str, ranges: int | None = None) -> None:
    """Write the history sorted across files; ``sorted_store.read_sorted`` and ``read_page`` read it without a sort."""
    write_sorted(history, path, HISTORY_ORDER, ranges)


def payment_denorm(payment: DataFrame, rental: DataFrame, instrument: DataFrame,
                   check_rental_key: bool = True) -> DataFrame:
    """Adds instrument_name and rental_duration (whole days) to each payment.

    Both correlated updates of the source read the same rental row, so one left
    join on the rental key serves both; no match leaves both columns NULL. A
    scalar subquery returning two rows is an error in SQL: unless
    ``check_rental_key`` is off, rentals are counted per key on their way to the
    join (the same exchange serves both) and a payment that meets two of them
    fails the query.
    """
    r = rental.select("rental_id", "instrument_id", "rental_start_time", "lease_expiry_time")
    if check_rental_key:
        r = r.groupBy("rental_id").agg(*[F.any_value(c).alias(c) for c in r.columns if c != "rental_id"],
                                       F.count(F.lit(1)).alias("_n"))
    else:
        r = r.withColumn("_n", F.lit(1))
    r = (r.join(instrument.select("instrument_id", "instrument_type"), "instrument_id", "left")
         .select("rental_id", "_n",
                 F.col("instrument_type").cast("string").alias("instrument_name"),
                 whole_days("rental_start_time", "lease_expiry_time").alias("rental_duration")))
    twice = F.when(F.col("_n") > 1, F.raise_error(F.lit("more than one rental for the rental key of a payment")))
    return payment.join(r, "rental_id", "left").select(
        *payment.columns, *[twice.otherwise(F.col(c)).alias(c) for c in ("instrument_name", "rental_duration")])
