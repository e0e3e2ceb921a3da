"""Row-level ingest rules re-stated as set-based batch jobs.

The source fires a trigger per inserted row. Here a batch carries an explicit
order (``order``: a list of columns giving a total order) and each function says
which rows are accepted, why the others are not, and what the target looks like
afterwards. Two modes exist where it matters:

* row mode: every row is its own statement; failing rows are skipped and the
  rest go on, seeing only the accepted rows before them.
* statement mode: the batch (or each group of ``statement`` rows) is one
  statement; the first failing row aborts all of it. Before that row every row
  was accepted, so flags computed as if all earlier rows were accepted are
  exact up to the first failure.

Counting "earlier rows of the same key" uses ``earlier_count``, which stays
balanced when one student, instrument or lesson holds a large share of rows.
Rejection reasons, in the order the source's triggers fire (they fire by name):
'active_rentals' (active-rental limit), 'out_of_stock', 'duration'.
"""

from __future__ import annotations

import datetime as _dt
import logging
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadenza.functions import plus_months, to_date
from cadenza.operators.scan import earlier_count, earlier_counts, split_hot_keys
from cadenza.staging import Stages

log = logging.getLogger(__name__)

# Rule defaults and configuration keys of the source.
DEFAULT_MAX_MONTHS = 12
DEFAULT_MAX_ACTIVE = 2
CONFIG_MAX_MONTHS = "max_rental_duration_months"
CONFIG_MAX_ACTIVE = "max_active_rentals_per_student"

R_ACTIVE = "active_rentals"
R_STOCK = "out_of_stock"
R_DURATION = "duration"
R_NO_TYPE = "no_type"
R_FULL = "full"
R_DUPLICATE = "duplicate"


class ConfigMissing(LookupError):
    pass


def config_value(system_config: DataFrame, key: str) -> int:
    """The number that ``system_config`` holds for ``key``; none, null or several rows are errors."""
    found = (system_config.filter(F.col("config_type") == key)
             .agg(F.count(F.lit(1)).alias("n"), F.max("config_value").alias("value")).first())
    if found["n"] != 1 or found["value"] is None:
        raise ConfigMissing(f"system_config needs one value for {key!r}; it has {found['n']} rows")
    return int(found["value"])


def _setting(value: int | DataFrame, key: str) -> int:
    """``value`` itself, or what the system_config table given in its place holds for ``key``."""
    return config_value(value, key) if isinstance(value, DataFrame) else value


# --------------------------------------------------------------------------- R1 is reports.sibling_closure

# --------------------------------------------------------------------------- R3 duration

def duration_ok(start: Column | str, expiry: Column | str, max_months: int = DEFAULT_MAX_MONTHS) -> Column:
    """expiry <= start + max_months months (equality passes; month ends clamp)."""
    s = F.col(start) if isinstance(start, str) else start
    e = F.col(expiry) if isinstance(expiry, str) else expiry
    return e <= plus_months(s, max_months)


def rental_duration_check(rentals: DataFrame, max_months: int | DataFrame = DEFAULT_MAX_MONTHS) -> DataFrame:
    """Flags every rental whose lease runs past ``max_months`` after its start."""
    max_months = _setting(max_months, CONFIG_MAX_MONTHS)
    return rentals.withColumn("violates", ~duration_ok("rental_start_time", "lease_expiry_time", max_months))


# --------------------------------------------------------------------------- R4 stock

def stock_admission(batch: DataFrame, instrument: DataFrame, order: list) -> DataFrame:
    """Row mode stock check: the n-th rental of an instrument is accepted while n <= stock.

    Rejected rows do not take stock; an unknown instrument is out of stock.
    Adds ``available_stock``, ``accepted`` and ``reason``.
    """
    s = instrument.select("instrument_id", "available_stock")
    b = earlier_count(batch, ["instrument_id"], order, out="_before")
    b = b.join(s, "instrument_id", "left")
    ok = F.coalesce(F.col("_before") < F.col("available_stock"), F.lit(False))
    return (b.withColumn("accepted", ok)
            .withColumn("reason", F.when(~ok, F.lit(R_STOCK)))
            .drop("_before"))


def stock_after_inserts(instrument: DataFrame, batch: DataFrame) -> DataFrame:
    """Stock per instrument after ``batch`` under the stock rule alone: as many rows are accepted as there is stock."""
    wanted = batch.groupBy("instrument_id").agg(F.count(F.lit(1)).alias("_wanted"))
    rented = F.least(F.coalesce("_wanted", F.lit(0)), F.greatest(F.coalesce("available_stock", F.lit(0)), F.lit(0)).cast("long"))
    return (instrument.select("instrument_id", "available_stock").join(wanted, "instrument_id", "left")
            .select("instrument_id", "available_stock", rented.alias("rented"),
                    (F.col("available_stock") - rented).cast("int").alias("stock_after")))


def stock_after(instrument: DataFrame, admitted: DataFrame) -> DataFrame:
    """Stock per instrument after the accepted rentals of ``stock_admission``."""
    taken = (admitted.filter("accepted").groupBy("instrument_id").agg(F.count(F.lit(1)).alias("rented")))
    return (instrument.select("instrument_id", "available_stock")
            .join(taken, "instrument_id", "left")
            .select("instrument_id", "available_stock",
                    F.coalesce("rented", F.lit(0)).alias("rented"),
                    (F.col("available_stock") - F.coalesce("rented", F.lit(0))).cast("int").alias("stock_after")))


# --------------------------------------------------------------------------- R2 active rentals

def is_active(expiry: str, as_of: _dt.date) -> Column:
    """Whether a rental is active on the day; NULL without an expiry."""
    # lease_expiry_time >= CURRENT_DATE: the date compares as midnight of as_of
    # a DATE literal, so neither the session's nor the driver's time zone moves the edge
    return F.col(expiry) >= F.lit(as_of).cast("timestamp_ntz")


def active_counts(existing: DataFrame, as_of: _dt.date) -> DataFrame:
    return (existing.filter(is_active("lease_expiry_time", as_of))
            .groupBy("student_id").agg(F.count(F.lit(1)).alias("_existing_active")))


def active_rental_limit(existing: DataFrame, batch: DataFrame, order: list, as_of=None,
                        limit: int | DataFrame = DEFAULT_MAX_ACTIVE) -> DataFrame:
    """Row mode active-rental limit.

    A row is accepted when the student's active rentals (existing ones plus
    accepted earlier batch rows that are themselves active) are below ``limit``.
    Counting every earlier active batch row is exact: once earlier rows reach
    the limit, this row fails either way. So a student with p places left
    accepts the rows up to the p-th active one of the batch; at most ``limit``
    rows per student and task are shuffled to find it. Rows without a student
    count as one student without existing rentals.
    """
    day = to_date(as_of)
    limit = _setting(limit, CONFIG_MAX_ACTIVE)
    seq = F.struct(*[F.col(c) for c in order])
    first = (batch.filter(is_active("lease_expiry_time", day)).select("student_id", seq.alias("_last"))
             .withColumn("_n", F.row_number().over(Window.partitionBy("student_id").orderBy("_last")))
             .filter(F.col("_n") <= F.lit(limit)))
    counts = active_counts(existing.filter(F.col("student_id").isNotNull()), day)
    places = F.lit(limit) - F.coalesce("_existing_active", F.lit(0))
    last = (first.join(counts, "student_id", "left").filter(F.col("_n") == places)
            .select("student_id", "_last"))
    student = (counts.join(last, "student_id", "full")
               .select(F.col("student_id").alias("_student"), "_existing_active", "_last"))
    b = batch.join(student, F.col("student_id").eqNullSafe(F.col("_student")), "left")
    ok = (places > 0) & F.coalesce(seq <= F.col("_last"), F.lit(True))
    return (b.withColumn("accepted", ok)
            .withColumn("reason", F.when(~F.col("accepted"), F.lit(R_ACTIVE)))
            .drop("_student", "_existing_active", "_last"))


# --------------------------------------------------------------------------- R5 capacity

def lesson_capacity_table(individual: DataFrame, group: DataFrame, ensemble: DataFrame,
                          lesson_ids: DataFrame) -> DataFrame:
    """Capacity per lesson id: group max, else ensemble max, else 1 for an individual lesson, else NULL."""
    g = group.select("lesson_id", F.col("max_students").alias("_g"))
    e = ensemble.select("lesson_id", F.col("max_students").alias("_e"))
    i = individual.select("lesson_id", F.lit(True).alias("_i"))
    return (lesson_ids.join(g, "lesson_id", "left").join(e, "lesson_id", "left").join(i, "lesson_id", "left")
            .withColumn("capacity", F.coalesce("_g", "_e", F.when(F.col("_i"), F.lit(1))))
            .drop("_g", "_e", "_i"))


def lesson_capacity(existing: DataFrame, batch: DataFrame, individual: DataFrame, group: DataFrame,
                    ensemble: DataFrame, order: list) -> DataFrame:
    """Row mode enrolment check with reasons 'no_type', 'full', 'duplicate' (in that precedence).

    The capacity trigger runs before the primary key check, so a duplicate in
    a full lesson reads 'full'. A duplicate (pair already enrolled, or earlier
    in the batch) is rejected by the key and takes no seat. So a lesson with k
    seats left is full after the k-th new student's first row: a bounded top-k
    per lesson, which each task cuts to k before rows are dealt by lesson. First
    rows per (lesson, student) are found before that by partial minima, dealt by
    both, so one crowded lesson is spread over all tasks. ``order`` must be a
    unique row key.
    """
    seq = F.struct(*[F.col(c) for c in order])
    enrolled = existing.groupBy("lesson_id").agg(F.count(F.lit(1)).alias("_existing"))
    typed = reduce(DataFrame.unionByName, [t.select("lesson_id") for t in (individual, group, ensemble)]).distinct()
    lessons = (lesson_capacity_table(individual, group, ensemble, typed).join(enrolled, "lesson_id", "left")
               .withColumn("_left", F.greatest(F.col("capacity") - F.coalesce("_existing", F.lit(0)), F.lit(0)).cast("long"))
               .select("lesson_id", "capacity", "_left"))
    # a seat goes to a new student's first row; only the first so many of a lesson matter
    most = lessons.agg(F.max("_left")).first()[0] or 0
    seats = lessons.filter("_left > 0").select("lesson_id", "_left")
    firsts = (batch.select("lesson_id", "student_id", seq.alias("_first")).join(seats.select("lesson_id"), "lesson_id", "left_semi")
              .groupBy("lesson_id", "student_id").agg(F.min("_first").alias("_first"))
              .join(existing.select("lesson_id", "student_id"), ["lesson_id", "student_id"], "left_anti")
              .withColumn("_n", F.row_number().over(Window.partitionBy("lesson_id").orderBy("_first")))
              .filter(F.col("_n") <= F.lit(most)))
    seated = firsts.join(seats, "lesson_id").filter("_n <= _left")
    full_after = seated.filter("_n = _left").select("lesson_id", F.col("_first").alias("_last"))
    b = (batch.join(lessons.join(full_after, "lesson_id", "left"), "lesson_id", "left")
         .join(seated.select(F.col("lesson_id").alias("_lesson"), F.col("student_id").alias("_student"), "_first"),
               (F.col("lesson_id") == F.col("_lesson")) & F.col("student_id").eqNullSafe(F.col("_student")), "left"))
    reason = (F.when(F.col("capacity").isNull(), F.lit(R_NO_TYPE))
              .when((F.col("_left") == 0) | F.coalesce(seq > F.col("_last"), F.lit(False)), F.lit(R_FULL))
              .when(~F.coalesce(seq == F.col("_first"), F.lit(False)), F.lit(R_DUPLICATE)))
    return (b.withColumn("reason", reason)
            .withColumn("accepted", F.col("reason").isNull())
            .drop("_left", "_last", "_lesson", "_student", "_first"))


# --------------------------------------------------------------------------- R6 current price

def current_price_flags(existing: DataFrame, batch: DataFrame, order: list,
                        statement: str | None = None) -> DataFrame:
    """is_current after inserting ``batch`` into the price history.

    Each TRUE insert clears is_current on every other row of its instrument.
    Row mode (``statement`` None): the last TRUE row per instrument stays
    current. Statement mode: the triggers of a statement run after all its rows
    are in, so the last statement with TRUE rows for an instrument keeps its
    TRUE row only if it has exactly one; two or more clear each other.
    Instruments without a TRUE insert keep their existing flags.

    ``existing``: instrument_id, is_current, other columns kept.
    ``batch``: instrument_id, is_current, the ``order`` columns, others kept.
    Returns existing rows then batch rows with a ``source`` column.
    """
    seq = F.struct(*[F.col(c) for c in order])
    stmt = F.col(statement) if statement else seq
    if statement is None:
        # row mode: every row is its own statement, so the last TRUE row per instrument wins
        winner = (batch.filter(F.col("is_current")).groupBy("instrument_id")
                  .agg(F.max(seq).alias("_w_last"))
                  .select("instrument_id", F.col("_w_last").alias("_w_stmt"), F.lit(1).cast("long").alias("_w_k"),
                          "_w_last"))
    else:
        true_rows = batch.filter(F.col("is_current")).select("instrument_id", stmt.alias("_stmt"),
                                                             seq.alias("_seq"))
        per_stmt = true_rows.groupBy("instrument_id", "_stmt").agg(F.count(F.lit(1)).alias("_k"),
                                                                   F.max("_seq").alias("_last"))
        winner = (per_stmt.groupBy("instrument_id")
                  .agg(F.max(F.struct("_stmt", "_k", "_last")).alias("_w"))
                  .select("instrument_id", F.col("_w._stmt").alias("_w_stmt"), F.col("_w._k").alias("_w_k"),
                          F.col("_w._last").alias("_w_last")))
    ex = (existing.join(winner.select("instrument_id", F.lit(True).alias("_hit")), "instrument_id", "left")
          .withColumn("is_current", F.when(F.col("_hit"), F.lit(False)).otherwise(F.col("is_current")))
          .drop("_hit").withColumn("source", F.lit("existing")))
    new = (batch.join(winner, "instrument_id", "left")
           .withColumn("is_current",
                       F.coalesce(F.col("is_current") & (F.col("_w_k") == 1) & (stmt == F.col("_w_stmt"))
                                  & (seq == F.col("_w_last")), F.lit(False)))
           .drop("_w_stmt", "_w_k", "_w_last").withColumn("source", F.lit("new")))
    return ex.unionByName(new, allowMissingColumns=True)


def current_price_updates(prices: DataFrame, updates: DataFrame, order: list) -> DataFrame:
    """is_current after ``updates`` (rental_price_id, is_current, ``order``) of the price history, row by row.

    An update that turns a row's flag on clears the other rows of its
    instrument; one that leaves it on clears nothing. Per instrument it
    therefore matters only whether any update turned a flag on, and which row
    was last set to TRUE: before the first such turn flags only go out, after it
    at most one row is on. A null flag counts as FALSE; updates of unknown rows
    are ignored.
    """
    flag, seq = F.coalesce("is_current", F.lit(False)), F.struct(*[F.col(c) for c in order])
    per_row = (updates.select("rental_price_id", F.when(flag, seq).alias("_on"), F.when(~flag, seq).alias("_off"))
               .groupBy("rental_price_id")
               .agg(F.max("_on").alias("_on"), F.min("_off").alias("_first_off"), F.max("_off").alias("_off")))
    rows = prices.withColumn("is_current", flag).join(per_row, "rental_price_id", "left")
    turned = F.col("_on").isNotNull() & (~F.col("is_current") | F.coalesce(F.col("_first_off") < F.col("_on"), F.lit(False)))
    per_instrument = (rows.filter(F.col("_on").isNotNull()).groupBy("instrument_id")
                      .agg(F.max("_on").alias("_last"), F.bool_or(turned).alias("_turned")))
    kept = F.col("is_current") & F.col("_off").isNull()
    is_last = F.coalesce(F.col("_on") == F.col("_last"), F.lit(False))
    after = (F.when(is_last, F.coalesce(F.col("_off") < F.col("_on"), F.lit(True)))
             .when(F.col("_turned"), F.lit(False)).otherwise(kept))
    return (rows.join(per_instrument, "instrument_id", "left").withColumn("is_current", after)
            .select(*prices.columns))


# --------------------------------------------------------------------------- R8 all rental rules

def _rental_flags(b: DataFrame, instrument: DataFrame, existing_active: DataFrame | None, as_of: _dt.date,
                  limit: int, max_months: int, order: list, scope: list[str]) -> DataFrame:
    """Per-row first failing trigger, counting every earlier row of the same ``scope``
    as accepted (exact up to a statement's first failure)."""
    b = b.withColumn("_is_active", is_active("lease_expiry_time", as_of))
    b = earlier_count(b, scope + ["student_id"], order, flag="_is_active", out="_act_before")
    b = earlier_count(b, scope + ["instrument_id"], order, out="_ins_before")
    b = b.join(instrument.select("instrument_id", "available_stock"), "instrument_id", "left")
    if existing_active is not None:
        b = b.join(existing_active, "student_id", "left")
    else:
        b = b.withColumn("_existing_active", F.lit(None).cast("long"))
    active_fail = (F.coalesce("_existing_active", F.lit(0)) + F.col("_act_before")) >= F.lit(limit)
    stock_fail = ~F.coalesce(F.col("_ins_before") < F.col("available_stock"), F.lit(False))
    duration_fail = ~duration_ok("rental_start_time", "lease_expiry_time", max_months)
    reason = (F.when(active_fail, F.lit(R_ACTIVE)).when(stock_fail, F.lit(R_STOCK))
              .when(duration_fail, F.lit(R_DURATION)))
    return (b.withColumn("_reason", reason)
            .drop("_is_active", "_act_before", "_ins_before", "available_stock", "_existing_active"))


def rental_admission_statement(batch: DataFrame, instrument: DataFrame, order: list, statement: str,
                               existing: DataFrame | None = None, as_of=None,
                               limit: int = DEFAULT_MAX_ACTIVE,
                               max_months: int = DEFAULT_MAX_MONTHS) -> DataFrame:
    """Statement mode: each ``statement`` group is one INSERT evaluated against the same snapshot.

    The first failing row (in ``order``) aborts its statement. Returns one row
    per statement: rows, accepted, reason and the order key of the first
    failing row (NULL when accepted).
    """
    day = to_date(as_of)
    ea = active_counts(existing, day) if existing is not None else None
    needed = dict.fromkeys([statement, *order, "student_id", "instrument_id", "rental_start_time", "lease_expiry_time"])
    flagged = _rental_flags(batch.select(*needed), instrument, ea, day, limit, max_months, order, [statement])
    rows = batch.groupBy(statement).agg(F.count(F.lit(1)).alias("n_rows"))
    # first failure per statement, looked for among failing rows only
    first = (flagged.filter(F.col("_reason").isNotNull()).groupBy(statement)
             .agg(F.min(F.struct(*[F.col(c) for c in order], F.col("_reason"))).alias("_first")))
    res = rows.join(first, statement, "left")
    return res.select(statement, "n_rows", F.col("_first").isNull().alias("accepted"),
                      F.col("_first._reason").alias("reason"),
                      *[F.col(f"_first.{c}").alias(f"failed_{c}") for c in order])


def admission_rows(batch: DataFrame, columns: list, instrument: DataFrame, existing: DataFrame | None,
                   day: _dt.date, limit: int, max_months: int) -> DataFrame:
    """``columns`` of the batch with student and instrument, whether the lease passes the duration rule (``_r3``) and is
    active, and what its student (``_places``) and its instrument (``_stock``) have left before the batch."""
    rows = batch.select(
        "student_id", "instrument_id", *[c for c in dict.fromkeys(columns) if c not in ("student_id", "instrument_id")],
        F.coalesce(duration_ok("rental_start_time", "lease_expiry_time", max_months), F.lit(True)).alias("_r3"),
        F.coalesce(is_active("lease_expiry_time", day), F.lit(False)).alias("_is_active"))
    rows = (rows.join(instrument.select("instrument_id", F.col("available_stock").cast("long").alias("_stock")),
                      "instrument_id", "left")
            .withColumn("_stock", F.coalesce("_stock", F.lit(0))))
    if existing is None:
        return rows.withColumn("_places", F.lit(limit).cast("long"))
    return (rows.join(active_counts(existing, day), "student_id", "left")
            .withColumn("_places", F.lit(limit) - F.coalesce("_existing_active", F.lit(0)))
            .drop("_existing_active"))


def rental_admission_row(batch: DataFrame, instrument: DataFrame, order: list,
                         existing: DataFrame | None = None, as_of=None, limit: int = DEFAULT_MAX_ACTIVE,
                         max_months: int = DEFAULT_MAX_MONTHS) -> DataFrame:
    """Row mode with all three rental triggers.

    Acceptance of a row depends on accepted earlier rows of its student *and*
    of its instrument, so no single window decides it. Row i depends only on
    earlier rows, so the system has exactly one solution, the sequential run.

    A row is open until bounds settle it. On each side (student, instrument) an
    open row knows what is left there after the settled rows before it, and the
    open rows before it that count on this side: ``_free`` of them have room on
    their other side whatever happens, ``_unsure`` do not know yet.

    * It has room on a side for certain once ``free + unsure < left``, and is
      accepted once it has room on both.
    * It is rejected once ``free >= left`` on a side: if there were still room,
      all free rows before it would have been accepted and used it up.
    * With ``unsure = 1`` and ``free = left - 1`` it has room exactly if that one
      unsure row is rejected. Rows that wait for one other row like this, with
      room on the other side, form chains; when a round settles less than half
      of the open rows, the chains are followed by pointer doubling, so a chain
      of n rows takes log n joins and not n rounds.

    Settled rows leave the working table, which holds keys, order and counts
    only. Rows that can change no key's end never enter it: those that fail the
    duration rule, those of instruments without stock, and inactive rows of
    instruments with more stock than rows. The earliest open row settles in every
    round, so the loop ends by itself. Afterwards a student and an instrument are
    each known by the row that took their last place: a row fails on a side
    exactly if it comes later, so one join a side gives the reasons.

    Students and instruments of very many rows are split over several tasks
    (``split_hot_keys``, pinned once); a round ends in a written table of the rows
    still open at its start, the one before is deleted, and only the number of
    open rows reaches the driver. ``order`` must be a unique row key; rows that
    share one are taken in a fixed order. Rows without a student (or instrument)
    count as one student (instrument); a lease without a start or an end passes
    the duration rule. Where an instrument id repeats, each of its rows judges
    the rentals, as a plain join has it.
    """
    day = to_date(as_of)
    stages = Stages(batch.sparkSession, "rental-admission")
    pinned = stages.keep(batch.withColumn("_rid", F.monotonically_increasing_id()))
    if not instrument.filter(F.col("instrument_id").isNotNull()).groupBy("instrument_id").count().filter("count > 1").isEmpty():
        return _admitted_by_counts(pinned, instrument, order, existing, day, limit, max_months, stages)
    stocks = instrument.select("instrument_id", F.coalesce(F.col("available_stock").cast("long"), F.lit(0)).alias("_stock"))
    order = [*order, "_rid"]
    r3 = F.coalesce(duration_ok("rental_start_time", "lease_expiry_time", max_months), F.lit(True))
    fits = pinned.filter(r3).select(*dict.fromkeys(["student_id", "instrument_id", *order]),
                                    F.coalesce(is_active("lease_expiry_time", day), F.lit(False)).alias("_is_active"))
    # an instrument with more stock than rows never runs out; only its active rows matter, to their students
    wanted = fits.groupBy("instrument_id").agg(F.count(F.lit(1)).alias("_wanted"))
    stocked = stocks.filter("_stock > 0").join(wanted, "instrument_id").withColumn("_ample", F.col("_wanted") < F.col("_stock"))
    work = stages.keep(fits.join(stocked.drop("_wanted"), "instrument_id").filter("_is_active OR NOT _ample"))
    had = None if existing is None else active_counts(existing.filter(F.col("student_id").isNotNull()), day)
    laid = (work.withColumn("_places", F.lit(limit).cast("long")) if had is None else
            work.join(had, "student_id", "left").withColumn("_places", F.lit(limit) - F.coalesce("_existing_active", F.lit(0)))
            .drop("_existing_active"))
    laid = split_hot_keys(split_hot_keys(laid, ["student_id"], order, "_b_student", "_e_student"),
                          ["instrument_id"], order, "_b_instrument", "_e_instrument")
    accepted = _settled(laid.withColumnRenamed("_ample", "_room_instrument"), order, stages)

    # who is full, and since which row
    at = F.struct(*[F.col(c) for c in order])
    students = accepted.filter("_is_active").groupBy("student_id").agg(F.count(F.lit(1)).alias("_taken"), F.max(at).alias("_last"))
    if had is not None:
        students = students.withColumnRenamed("student_id", "_of").join(had, F.col("_of").eqNullSafe(F.col("student_id")), "full").select(
            F.coalesce("_of", "student_id").alias("student_id"), "_taken", "_last", "_existing_active")
        places = F.lit(limit) - F.coalesce("_existing_active", F.lit(0))
    else:
        places = F.lit(limit)
    students = students.select(F.col("student_id").alias("_student"), (places <= 0).alias("_never"),
                               F.when(F.col("_taken") >= places, F.col("_last")).alias("_last"))
    rented = accepted.groupBy("instrument_id").agg(F.count(F.lit(1)).alias("_taken"), F.max(at).alias("_end"))
    ends = stocks.filter("_stock > 0").join(rented, "instrument_id", "left").select(
        "instrument_id", F.lit(True).alias("_any"), F.when(F.col("_taken") >= F.col("_stock"), F.col("_end")).alias("_end"))
    # both parts below read one shuffle of the rows: the flag keeps the join an outer one in each, and nothing is computed before it
    late = (F.lit(limit <= 0) | F.coalesce(F.col("_never"), F.lit(False)) | F.coalesce(at > F.col("_last"), F.lit(False)))
    rows = pinned.join(students, F.col("student_id").eqNullSafe(F.col("_student")), "left").withColumn("_late", late)
    out = [c for c in batch.columns if c not in ("accepted", "reason")]
    rejected = rows.filter("_late").select(*out, F.lit(False).alias("accepted"), F.lit(R_ACTIVE).alias("reason"))
    reason = (F.when(F.col("_any").isNull() | F.coalesce(at > F.col("_end"), F.lit(False)), F.lit(R_STOCK))
              .when(~r3, F.lit(R_DURATION)))
    others = (rows.filter("NOT _late").join(ends, "instrument_id", "left").withColumn("reason", reason)
              .select(*out, F.col("reason").isNull().alias("accepted"), "reason"))
    return rejected.unionByName(others)


def _admitted_by_counts(pinned: DataFrame, instrument: DataFrame, order: list, existing: DataFrame | None, day: _dt.date,
                        limit: int, max_months: int, stages: Stages) -> DataFrame:
    """``rental_admission_row`` of rows joined to every row of their instrument, with a count per side for the reasons."""
    rows = stages.keep(admission_rows(pinned, ["_rid", *order], instrument, existing, day, limit, max_months))
    rows = split_hot_keys(split_hot_keys(rows, ["student_id"], order, "_b_student", "_e_student"),
                          ["instrument_id"], order, "_b_instrument", "_e_instrument")
    accepted = _settled(rows.filter("_r3").drop("_r3").withColumn("_room_instrument", F.lit(False)), order, stages).select("_rid")
    by_student, by_instrument = _sides(order)
    # _places and _stock are still those before the batch here, so these counts decide exactly
    rows = (rows.join(accepted.withColumn("accepted", F.lit(True)), "_rid", "left")
            .withColumn("accepted", F.coalesce("accepted", F.lit(False))))
    rows = earlier_count(rows, flag=F.col("accepted") & F.col("_is_active"), out="_act_before", **by_student)
    rows = earlier_count(rows, flag="accepted", out="_ins_before", **by_instrument)
    reason = (F.when(F.col("_act_before") >= F.col("_places"), F.lit(R_ACTIVE))
              .when(F.col("_ins_before") >= F.col("_stock"), F.lit(R_STOCK))
              .when(~F.col("_r3"), F.lit(R_DURATION)))
    return pinned.drop("accepted", "reason").join(rows.select("_rid", "accepted", reason.alias("reason")),
                                                  "_rid").drop("_rid")


def _sides(order: list) -> tuple[dict, dict]:
    return ({"keys": ["student_id"], "order": order, "bucket": "_b_student", "edges": "_e_student"},
            {"keys": ["instrument_id"], "order": order, "bucket": "_b_instrument", "edges": "_e_instrument"})


def _settled(rows: DataFrame, order: list, stages: Stages) -> DataFrame:
    """The rounds of ``rental_admission_row``: the accepted ones of ``rows`` (keys, order, _rid, _is_active, _places, _stock,
    the layouts of both sides, and _room_instrument: certain from the start)."""
    by_student, by_instrument = _sides(order)
    # _new: accepted in the last round, still to be taken off what later rows have left
    work = rows.withColumns({"_new": F.lit(False), "_room_student": F.lit(False)})
    accepted, last, rnd = [], None, 0
    was_open = work.count()
    while True:
        rnd += 1
        seen = _settle_side(work, by_student, "_places", "_student", "_room_instrument", ~F.col("_new"), F.col("_is_active"))
        # rows that their student rejects count on neither side from here on
        seen = stages.keep(seen.filter("_status_student IS NULL"))
        done = _settle_side(seen, by_instrument, "_stock", "_instrument", "_room_student",
                            ~F.col("_new"), F.lit(True)).filter(~F.col("_new"))
        room = F.col("_room_student") & F.col("_room_instrument")
        done = stages.keep(done.drop("_new", "_status_student").withColumn(
            "_status", F.coalesce("_status_instrument", F.when(room, F.lit(True)))))
        stages.drop(seen, *([last] if last is not None else []))
        n_open = done.filter("_status IS NULL").count()
        if n_open and 2 * n_open > was_open:
            last = _follow_chains(done, stages)
            stages.drop(done)
            n_open = last.filter("_status IS NULL").count()
        else:
            last = done
        was_open = n_open
        log.info("row-mode admission: %d rows open after round %d", n_open, rnd)
        accepted.append(stages.keep(last.filter("_status").select(*dict.fromkeys(["student_id", "instrument_id", *order, "_rid"]),
                                                                  "_is_active")))
        if n_open == 0:
            break
        work = last.filter("_status IS NULL OR _status").withColumn("_new", F.col("_status").isNotNull()).drop("_status")
    stages.drop(last)
    return stages.together(accepted)


def _settle_side(work: DataFrame, layout: dict, left: str, side: str, other_room: str, is_open: Column,
                 counts: Column) -> DataFrame:
    """One side of a round of ``rental_admission_row``: takes the new rows off ``left`` and sets, for this side,
    ``_status`` (False: rejected), ``_room`` (certain), ``_waits`` (room exactly if the key's first unsure row is
    rejected) and ``_first`` (that row). ``counts`` says which rows take something on this side."""
    unsure = is_open & counts & ~F.col(other_room)
    d = earlier_counts(work, flags={"_taken": F.col("_new") & counts, "_free": is_open & counts & F.col(other_room),
                                    "_unsure": unsure}, **layout)
    d = d.withColumn(left, F.col(left) - F.col("_taken"))
    return d.withColumns({
        f"_status{side}": F.when(is_open & (F.col("_free") >= F.col(left)), F.lit(False)),
        f"_room{side}": F.col("_free") + F.col("_unsure") < F.col(left),
        f"_waits{side}": is_open & (F.col("_unsure") == 1) & (F.col("_free") == F.col(left) - 1),
        f"_first{side}": unsure & (F.col("_unsure") == 0)}).drop("_taken", "_free", "_unsure")


def _follow_chains(done: DataFrame, stages: Stages) -> DataFrame:
    """``done`` with the rows settled that wait, over a chain of single rows, for a settled one.

    Each link negates (a row that waits has room exactly if the other is rejected), so a row's end is that of its
    chain's root, negated once per link. Roots that are still open leave their chain open.
    """
    links = []
    for side, key in (("_student", "student_id"), ("_instrument", "instrument_id")):
        other = "_room_instrument" if side == "_student" else "_room_student"
        first = done.filter(f"_first{side}").select(F.col(key).alias("_key"), F.col("_rid").alias("_to"))
        waiting = done.filter(F.col("_status").isNull() & F.col(f"_waits{side}") & F.col(other)).select("_rid", key)
        links.append(waiting.join(first, F.col(key).eqNullSafe(F.col("_key"))).select(
            "_rid", "_to", F.lit(True).alias("_odd")))
    # a row with room on one side waits on the other alone, so no row has two links
    links = stages.keep(links[0].unionByName(links[1]))
    while True:
        ahead = links.select(F.col("_rid").alias("_to"), F.col("_to").alias("_far"), F.col("_odd").alias("_far_odd"))
        jumped = stages.keep(links.join(ahead, "_to", "left").select(
            "_rid", F.coalesce("_far", "_to").alias("_to"),
            (F.col("_odd") != F.coalesce("_far_odd", F.lit(False))).alias("_odd"),
            F.col("_far").isNotNull().alias("_moved")))
        stages.drop(links)
        links = jumped
        if jumped.filter("_moved").isEmpty():
            break
    roots = done.select(F.col("_rid").alias("_to"), F.col("_status").alias("_root"))
    ends = (links.join(roots, "_to").filter("_root IS NOT NULL")
            .select("_rid", (F.col("_root") != F.col("_odd")).alias("_end")))
    out = stages.keep(done.join(ends, "_rid", "left").withColumn("_status", F.coalesce("_status", "_end")).drop("_end"))
    stages.drop(links)
    return out


def rental_update_check(existing: DataFrame, updates: DataFrame, as_of=None,
                        limit: int | DataFrame = DEFAULT_MAX_ACTIVE,
                        max_months: int | DataFrame = DEFAULT_MAX_MONTHS, exclude_self: bool = False) -> DataFrame:
    """The two rental triggers that also fire on UPDATE (active-rental limit, then duration).

    ``updates`` holds the new version of existing rows (``rental_id`` plus the
    rental columns). The source counts the student's active rentals including
    the row being updated, so a student at the limit cannot update any rental;
    that is the default, and ``exclude_self=True`` leaves the row itself out.
    Each update is checked against ``existing`` (updates are independent rows).
    """
    day = to_date(as_of)
    limit, max_months = _setting(limit, CONFIG_MAX_ACTIVE), _setting(max_months, CONFIG_MAX_MONTHS)
    act = existing.filter(is_active("lease_expiry_time", day)).select("student_id", "rental_id")
    counts = act.groupBy("student_id").agg(F.count(F.lit(1)).alias("_n"))
    u = updates.join(counts, "student_id", "left")
    if exclude_self:
        self_active = act.select("rental_id", F.col("student_id").alias("_self_student"),
                                 F.lit(1).alias("_self"))
        u = (u.join(self_active, "rental_id", "left")
             .withColumn("_n", F.col("_n") - F.when(F.col("_self_student") == F.col("student_id"), F.col("_self"))
                         .otherwise(F.lit(0)))
             .drop("_self", "_self_student"))
    active_fail = F.coalesce(F.col("_n"), F.lit(0)) >= F.lit(limit)
    duration_fail = ~duration_ok("rental_start_time", "lease_expiry_time", max_months)
    reason = F.when(active_fail, F.lit(R_ACTIVE)).when(duration_fail, F.lit(R_DURATION))
    return u.withColumn("reason", reason).withColumn("accepted", F.col("reason").isNull()).drop("_n")


def admit_rentals(batch: DataFrame, instrument: DataFrame, order: list, existing: DataFrame | None = None,
                  as_of=None, limit: int | DataFrame = DEFAULT_MAX_ACTIVE,
                  max_months: int | DataFrame = DEFAULT_MAX_MONTHS,
                  mode: str = "row", statement: str | None = None) -> DataFrame:
    """INSERT INTO instrument_rental with all rental triggers, in ``row`` or ``statement`` mode.

    Row mode returns every row with accepted / reason. Statement mode returns
    one row per ``statement`` value (the whole batch when None). ``limit`` and
    ``max_months`` are numbers or the system_config table that holds them.
    """
    limit, max_months = _setting(limit, CONFIG_MAX_ACTIVE), _setting(max_months, CONFIG_MAX_MONTHS)
    if mode == "row":
        return rental_admission_row(batch, instrument, order, existing, as_of, limit, max_months)
    if mode != "statement":
        raise ValueError("mode is 'row' or 'statement'")
    if statement is None:
        batch, statement = batch.withColumn("_statement", F.lit(0)), "_statement"
    return rental_admission_statement(batch, instrument, order, statement, existing, as_of, limit, max_months)
