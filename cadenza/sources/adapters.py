"""Adapters: present the driver's TPC-H-like tables as the lesson/rental domain.

The operators in ``cadenza.operators`` only know domain column names
(lesson_id, student_id, max_students, ...). These functions build those
DataFrames from the test tables with projections and joins, so everything the
operators do scales with the real tables. The same mapping is written as SQL
CTEs in ``cadenza.plans.oracle`` for the DuckDB cross-check.

Mapping (all row-preserving; nothing is sampled or capped):

* lesson            <- orders   (lesson_id = o_orderkey, start_date = date(o_orderdate),
                                 instrument_type = o_orderpriority, lesson_price_id = o_custkey)
* subtype tables    <- orders   priority digit d = first char of o_orderpriority;
                                 d = 5 ('5-LOW') has no subtype, else status F -> individual,
                                 O -> group (max 2d+2, min 2), P -> ensemble (max d+2, min 1,
                                 genre by d)
* student_lessons   <- lineitem (lesson_id = l_orderkey, student_id = l_suppkey)
* student           <- supplier (student_id = s_suppkey, person_id = s_nationkey)
* person            <- nation   (first/last name = the two halves of n_name)
* person_email      <- nation   (person_id = n_nationkey, email_id = n_regionkey)
* email             <- region   (email = lower(r_name) || '@example.com')
* lesson_price_history <- customer (skill_level_price = c_nationkey,
                                    lesson_type_price = floor(c_acctbal))
* instructor        <- supplier; instructor lessons <- lineitem by ship date
* sibling           <- customer (k, k+1) when both have the same market segment
* instrument        <- part     (available_stock = p_size, instrument_type = p_type)
* instrument_rental <- lineitem joined to its order (start = o_orderdate, expiry = l_shipdate,
                                 instrument = l_partkey, student = o_custkey)
* student_payment   <- orders; its rental <- lineitem aggregated per order
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.sources.tables import Tables

# Genre per priority digit for ensembles (the reference's genres).
GENRES = ("Classical", "Jazz", "Rock", "Pop")

# Row order of the test rental/enrolment batches: a unique key of lineitem.
LINE_KEY = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")


def _digit():
    return F.substring("o_orderpriority", 1, 1).cast("int")


def lessons(t: Tables) -> DataFrame:
    return t.orders.select(
        F.col("o_orderkey").alias("lesson_id"),
        F.col("o_orderdate").cast("date").alias("start_date"),
        F.col("o_orderpriority").alias("instrument_type"),
        F.col("o_custkey").alias("lesson_price_id"),
        F.col("o_custkey").alias("instructor_id"),
    )


def _typed_orders(t: Tables) -> DataFrame:
    return (t.orders.select("o_orderkey", "o_orderstatus", "o_orderpriority")
            .withColumn("_d", _digit()).filter(F.col("_d") < 5))


def individual_lessons(t: Tables) -> DataFrame:
    return (_typed_orders(t).filter(F.col("o_orderstatus") == "F")
            .select(F.col("o_orderkey").alias("lesson_id"), F.lit("10:00:00").alias("time_slot")))


def group_lessons(t: Tables) -> DataFrame:
    return (_typed_orders(t).filter(F.col("o_orderstatus") == "O")
            .select(F.col("o_orderkey").alias("lesson_id"),
                    (F.col("_d") * 2 + 2).alias("max_students"),
                    F.lit(2).alias("min_students")))


def ensemble_lessons(t: Tables) -> DataFrame:
    genre = F.element_at(F.array(*[F.lit(g) for g in GENRES]), F.col("_d"))
    return (_typed_orders(t).filter(F.col("o_orderstatus") == "P")
            .select(F.col("o_orderkey").alias("lesson_id"), genre.alias("genre"),
                    (F.col("_d") + 2).alias("max_students"), F.lit(1).alias("min_students"),
                    F.lit(0).alias("current_students")))


def lesson_types(t: Tables) -> DataFrame:
    """One row per lesson with its subtype and capacity (NULL when it has no subtype)."""
    o = t.orders.select("o_orderkey", "o_orderstatus", "o_orderpriority").withColumn("_d", _digit())
    typed = F.col("_d") < 5
    kind = (F.when(typed & (F.col("o_orderstatus") == "F"), "individual")
            .when(typed & (F.col("o_orderstatus") == "O"), "group")
            .when(typed & (F.col("o_orderstatus") == "P"), "ensemble"))
    cap = (F.when(kind == "individual", 1).when(kind == "group", F.col("_d") * 2 + 2)
           .when(kind == "ensemble", F.col("_d") + 2))
    return o.select(F.col("o_orderkey").alias("lesson_id"), kind.alias("lesson_type"),
                    cap.alias("capacity"))


def enrolments(t: Tables) -> DataFrame:
    return t.lineitem.select(F.col("l_orderkey").alias("lesson_id"), F.col("l_suppkey").alias("student_id"))


def students(t: Tables) -> DataFrame:
    return t.supplier.select(F.col("s_suppkey").alias("student_id"), F.col("s_nationkey").alias("person_id"))


def persons(t: Tables) -> DataFrame:
    return t.nation.select(F.col("n_nationkey").alias("person_id"),
                           F.split_part(F.col("n_name"), F.lit("_"), F.lit(1)).alias("first_name"),
                           F.split_part(F.col("n_name"), F.lit("_"), F.lit(2)).alias("last_name"))


def person_emails(t: Tables) -> DataFrame:
    return t.nation.select(F.col("n_nationkey").alias("person_id"), F.col("n_regionkey").alias("email_id"))


def emails(t: Tables) -> DataFrame:
    return t.region.select(F.col("r_regionkey").alias("email_id"),
                           F.concat(F.lower("r_name"), F.lit("@example.com")).alias("email"))


def lesson_prices(t: Tables) -> DataFrame:
    return t.customer.select(F.col("c_custkey").alias("lesson_price_id"),
                             F.col("c_nationkey").alias("skill_level_price"),
                             F.floor("c_acctbal").cast("int").alias("lesson_type_price"))


def instructors(t: Tables) -> DataFrame:
    return t.supplier.select(F.col("s_suppkey").alias("instructor_id"), F.col("s_nationkey").alias("person_id"))


def instructor_lessons(t: Tables) -> DataFrame:
    return t.lineitem.select(F.col("l_orderkey").alias("lesson_id"),
                             F.col("l_shipdate").cast("date").alias("start_date"),
                             F.col("l_suppkey").alias("instructor_id"))


def customer_students(t: Tables) -> DataFrame:
    return t.customer.select(F.col("c_custkey").alias("student_id"))


def sibling_edges(t: Tables) -> DataFrame:
    """One direction only: (k, k+1) for neighbouring customers in the same segment."""
    a = t.customer.select(F.col("c_custkey").alias("student_id"), F.col("c_mktsegment").alias("_seg"))
    b = t.customer.select((F.col("c_custkey") - 1).alias("student_id"),
                          F.col("c_custkey").alias("sibling_id"), F.col("c_mktsegment").alias("_seg"))
    return a.join(b, ["student_id", "_seg"], "inner").select("student_id", "sibling_id")


def instruments(t: Tables) -> DataFrame:
    return t.part.select(F.col("p_partkey").alias("instrument_id"), F.col("p_type").alias("instrument_type"),
                         F.col("p_size").alias("available_stock"))


def rentals(t: Tables) -> DataFrame:
    """Every lineitem as a rental of part l_partkey by customer o_custkey."""
    o = t.orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey", "o_orderdate")
    li = t.lineitem.select(*LINE_KEY, "l_shipdate", "l_linestatus")
    return (li.join(o, "l_orderkey", "inner")
            .withColumnRenamed("o_custkey", "student_id")
            .withColumnRenamed("o_orderdate", "rental_start_time")
            .withColumnRenamed("l_shipdate", "lease_expiry_time")
            .withColumn("instrument_id", F.col("l_partkey")))


def system_config(t: Tables) -> DataFrame:
    """The rules' settings from two regions' keys: 12 months (region 1), 2 active rentals (region 2)."""
    key = F.col("r_regionkey")
    return t.region.filter(key.isin(1, 2)).select(
        F.when(key == 1, "max_rental_duration_months").otherwise("max_active_rentals_per_student").alias("config_type"),
        F.when(key == 1, key * 12).otherwise(key).cast("int").alias("config_value"))


def rental_prices(t: Tables) -> DataFrame:
    """Every order as a price of the instrument o_custkey; open orders are current."""
    return t.orders.select(F.col("o_orderkey").alias("rental_price_id"), F.col("o_custkey").alias("instrument_id"),
                           (F.col("o_orderstatus") == "O").alias("is_current"))


def payment_rentals(t: Tables) -> DataFrame:
    """One rental per order: first and last ship time, lowest part key."""
    return (t.lineitem.groupBy(F.col("l_orderkey").alias("rental_id"))
            .agg(F.min("l_shipdate").alias("rental_start_time"),
                 F.max("l_shipdate").alias("lease_expiry_time"),
                 F.min("l_partkey").alias("instrument_id")))


def payments(t: Tables) -> DataFrame:
    return t.orders.select(F.col("o_orderkey").alias("payment_id"),
                           F.col("o_orderdate").cast("date").alias("payment_date"),
                           F.col("o_orderkey").alias("rental_id"),
                           F.col("o_custkey").alias("student_id"),
                           F.col("o_totalprice").cast("decimal(10,2)").alias("amount"))
