"""Whole statements on the rental table: inserts one after the other, and updates of many rows.

``admit_statements`` runs INSERT statements in sequence. A statement goes in with
all its rows or not at all; its rows see the accepted statements before it and
the earlier rows of their own statement.

``rental_update_statements`` checks UPDATE statements. A row sees what the
statement has already done to earlier rows: each of them took an active rental
from its old student and gave one to its new student, so the count a row sees is
a running sum of signed events.

Both count with ``operators.scan``, so a student, an instrument or a statement
with a large share of the rows is spread over many tasks.
"""

from __future__ import annotations

import logging
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cadenza.functions import to_date
from cadenza.operators import rules
from cadenza.operators.scan import earlier_counts, hot_keys, mark_edges, range_buckets, same_keys, split_hot_keys
from cadenza.staging import Stages

log = logging.getLogger(__name__)

KEYS = ["_on_student", "student_id", "instrument_id"]       # of a claim: its side and its key; the other side's key is null
FREE_LEVELS = (0, 1, 2)
TAIL_ROWS = 1 << 18             # so many claims at most are settled by one task, in order
_TIES = 30                      # bits of a row's place that tell rows of one order key apart


def _first_failures(rows: DataFrame, statement: str, order: list, reason: str) -> DataFrame:
    """One row per statement: n_rows, accepted, reason and the order key of its first failing row."""
    counts = rows.groupBy(F.col(statement).alias("_counted")).agg(F.count(F.lit(1)).alias("n_rows"))
    first = (rows.filter(F.col(reason).isNotNull()).groupBy(statement)
             .agg(F.min(F.struct(*[F.col(c).alias(f"_{i}") for i, c in enumerate(order)], F.col(reason).alias("_r"))).alias("_f")))
    return counts.join(first, F.col("_counted").eqNullSafe(F.col(statement)), "left").select(
        F.col("_counted").alias(statement), "n_rows", F.col("_f").isNull().alias("accepted"), F.col("_f._r").alias("reason"),
        *[F.col(f"_f._{i}").alias(f"failed_{c}") for i, c in enumerate(order)])


def admit_statements(batch: DataFrame, instrument: DataFrame, order: list, statement: str,
                     existing: DataFrame | None = None, as_of=None, limit: int | DataFrame = rules.DEFAULT_MAX_ACTIVE,
                     max_months: int | DataFrame = rules.DEFAULT_MAX_MONTHS) -> DataFrame:
    """INSERT statements run in the order of ``statement``, each all or nothing, rows in ``order``.

    To the others a statement is a set of claims, one on each of its students and
    instruments: how much it takes there (``_take``), and before how many taken by
    others it must come (``_slack``). Its last row there says both. Claims alone go
    through the rounds (``_settled``). Then the accepted claims before each one are
    counted once more; where a claim finds too little left, so does the first row
    that claims as much, and the first such row of a statement is looked up.

    Returns one row per statement: n_rows, accepted, and for a rejected one the
    reason and order key of the first row that fails in the sequential run. Rows
    without a student (or instrument) count as one student (instrument); a null
    statement is the first one. Where an instrument id repeats, each of its rows
    judges the rentals, as a plain join has it.
    """
    day = to_date(as_of)
    limit, max_months = rules._setting(limit, rules.CONFIG_MAX_ACTIVE), rules._setting(max_months, rules.CONFIG_MAX_MONTHS)
    stages = Stages(batch.sparkSession, "statements")
    stocks = instrument.filter(F.col("instrument_id").isNotNull()).select("instrument_id", F.col("available_stock").cast("long").alias("_left"))
    repeated = not stocks.groupBy("instrument_id").count().filter("count > 1").isEmpty()
    had = None if existing is None else (rules.active_counts(existing.filter(F.col("student_id").isNotNull()), day)
                                         .select("student_id", (F.lit(limit) - F.col("_existing_active")).alias("_left")))
    sequence = [statement] + [c for c in order if c != statement]
    plain = batch.select(
        "student_id", "instrument_id", *[c for c in dict.fromkeys(sequence) if c not in ("student_id", "instrument_id")],
        F.coalesce(rules.duration_ok("rental_start_time", "lease_expiry_time", max_months), F.lit(True)).alias("_r3"),
        F.coalesce(rules.is_active("lease_expiry_time", day), F.lit(False)).alias("_is_active"))
    if repeated:
        plain = plain.join(stocks, "instrument_id", "left").withColumn("_left", F.coalesce("_left", F.lit(0)))

    crowded = hot_keys(plain, [statement])
    rows = _numbered(plain, statement, sequence, crowded, stages)
    left = {"student_id": (had, limit), "instrument_id": (None if repeated else stocks, 0)}
    claims = [_laid(_claims(rows, statement, key, repeated), key, *left[key]) for key in left]
    split = any("_b" in d.columns for d in claims)
    settled = _settled([d if "_b" in d.columns or not split else d.withColumns({"_b": F.lit(-1), "_e": F.lit(False)}) for d in claims],
                       split, crowded is not None, stages)

    # accepted claims before each claim, and before the rows that claim less than their statement's last one on that key
    checks = [settled.withColumns({"_take": F.when(F.col("_sure"), F.col("_take")).otherwise(F.lit(0)), "_whole": F.lit(True)})]
    for key in left:
        less = _with_left(_smaller_claims(rows, statement, key, repeated), key, *left[key])
        checks.append(_both_keys(less, key, rows).withColumns({"_take": F.lit(0), "_whole": F.lit(False)}))
    checks = reduce(DataFrame.unionByName, [d.select(*KEYS, "_stmt", "_slack", "_take", "_pos", "_whole") for d in checks])
    if split:
        checks = split_hot_keys(stages.keep(checks), KEYS, ["_stmt", "_whole"], "_b", "_e")
    checks = earlier_counts(checks, KEYS, ["_stmt", "_whole"], {"_before": F.col("_take")}, **_layout(split))
    fails = (checks.filter("_pos IS NOT NULL AND _before >= _slack")
             .select("_stmt", "_pos", F.when(F.col("_on_student"), 0).otherwise(1).alias("_why"))
             .unionByName(rows.filter("NOT _r3").select(F.col(statement).alias("_stmt"), "_pos", F.lit(2).alias("_why"))))
    # a row has the reason of the first trigger; of rows that share an order key, the first reason by name counts
    names = [rules.R_ACTIVE, rules.R_STOCK, rules.R_DURATION]
    by_name = F.array(*[F.lit(sorted(names).index(n)) for n in names])
    first = (fails.groupBy("_stmt", "_pos").agg(F.min("_why").alias("_why")).groupBy("_stmt")
             .agg(F.min(F.shiftleft(F.shiftright("_pos", _TIES), 2) + F.get(by_name, F.col("_why"))).alias("_at")))
    rejected, reasons = F.col("_at").isNotNull(), F.array(*[F.lit(n) for n in sorted(names)])
    return (rows.join(first, F.col(statement).eqNullSafe(F.col("_stmt")), "left")
            .filter(F.col("_pos") == F.coalesce(F.shiftleft(F.shiftright("_at", 2), _TIES), F.lit(0)))
            .select(statement, F.col("_n_rows").alias("n_rows"), (~rejected).alias("accepted"),
                    F.when(rejected, F.get(reasons, (F.col("_at") % 4).cast("int"))).alias("reason"),
                    *[F.when(rejected, F.col(c)).alias(f"failed_{c}") for c in order]))


def _layout(split: bool) -> dict:
    return {"bucket": "_b", "edges": "_e"} if split else {"edges": False}


def _numbered(plain: DataFrame, statement: str, sequence: list, crowded: DataFrame | None, stages: Stages) -> DataFrame:
    """The rows, written, with their place in their statement (``_pos``: the earlier rows of other order keys, then those of its
    own in the last ``_TIES`` bits), its size (``_n_rows``) and whether all its rows pass the duration rule (``_fits``), what
    its earlier rows take of the row's student and instrument (``_own_active``, ``_own_rows``), whether a row is the last on
    its student or instrument (``_last_``), and whether it is the first to claim as much of its student (``_step``).

    One shuffle by statement does for all windows; statements of over HOT_ROWS rows (``crowded``) are counted over ranges.
    """
    whole, active = Window.partitionBy(statement), F.col("_is_active").cast("long")
    in_order = whole.orderBy(*sequence)

    def place(number, rank):
        return F.shiftleft(rank.cast("long"), _TIES) + (number - rank)

    of = {key: Window.partitionBy(statement, key).orderBy("_pos") for key in ("student_id", "instrument_id")}
    few = plain if crowded is None else plain.join(F.broadcast(crowded), same_keys([statement], "_h_"), "left_anti")
    few = few.withColumns({"_pos": place(F.row_number().over(in_order) - 1, F.rank().over(in_order) - 1),
                           "_n_rows": F.count(F.lit(1)).over(whole), "_fits": F.bool_and("_r3").over(whole)})
    few = few.withColumns({
        "_own_active": F.coalesce(F.sum(active).over(of["student_id"].rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
        "_step": F.coalesce(F.lag("_is_active").over(of["student_id"]), F.lit(True)),
        "_last_student_id": F.lead("_pos").over(of["student_id"]).isNull()})
    few = stages.keep(few.withColumns({"_own_rows": F.row_number().over(of["instrument_id"]).cast("long") - 1,
                                       "_last_instrument_id": F.lead("_pos").over(of["instrument_id"]).isNull()}))
    if crowded is None:
        return few

    def marked(rows, name, keys, of_group, mark=F.col("_pos") == F.col("_g")):
        groups = rows.groupBy(*[F.col(k).alias(f"_g_{k}") for k in keys]).agg(of_group.alias("_g"))
        return rows.join(groups, same_keys(keys, "_g_"), "left").withColumn(name, mark).drop("_g", *[f"_g_{k}" for k in keys])

    many = stages.keep(plain.join(F.broadcast(crowded), same_keys([statement], "_h_"), "left_semi"))
    sizes = many.groupBy(F.col(statement).alias("_of")).agg(F.count(F.lit(1)).alias("_n_rows"), F.bool_and("_r3").alias("_fits"))
    many = stages.keep(earlier_counts(many, [statement], sequence, {"_pos": F.lit(True)}))
    many = (marked(many, "_pos", sequence, F.min("_pos"), place(F.col("_pos"), F.col("_g")))
            .join(F.broadcast(sizes), F.col(statement).eqNullSafe(F.col("_of"))).drop("_of"))
    many = earlier_counts(many, [statement, "student_id"], ["_pos"], {"_own_active": active})
    many = stages.keep(earlier_counts(many, [statement, "instrument_id"], ["_pos"], {"_own_rows": F.lit(True)}))
    many = marked(many, "_step", [statement, "student_id", "_own_active"], F.min("_pos"))
    many = marked(many, "_last_student_id", [statement, "student_id"], F.max("_pos"))
    many = marked(many, "_last_instrument_id", [statement, "instrument_id"], F.max("_pos"))
    return stages.together([few, stages.keep(many.select(*few.columns))])


def _claims(rows: DataFrame, statement: str, key: str, repeated: bool) -> DataFrame:
    """One claim per statement and ``key``; ``_pos`` is the first row that claims as much, where the last row is that one."""
    if key == "instrument_id" and repeated:
        # rows of several stocks: the one that leaves least counts, and any of them may fail first
        return rows.groupBy(key, F.col(statement).alias("_stmt")).agg(
            F.min(F.col("_left") - F.col("_own_rows")).alias("_slack"), F.lit(None).cast("long").alias("_own"), F.count(F.lit(1)).alias("_take"),
            F.lit(None).cast("long").alias("_pos"), (~F.bool_and("_fits")).alias("_fails"))
    own, takes, pos = ((F.col("_own_active"), F.col("_is_active").cast("long"), F.when(F.col("_step"), F.col("_pos")))
                       if key == "student_id" else (F.col("_own_rows"), F.lit(1), F.col("_pos")))
    return rows.filter(f"_last_{key}").select(key, F.col(statement).alias("_stmt"), own.alias("_own"), (own + takes).alias("_take"),
                                              pos.alias("_pos"), (~F.col("_fits")).alias("_fails"))


def _smaller_claims(rows: DataFrame, statement: str, key: str, repeated: bool) -> DataFrame:
    """The rows other than a claim's last that are the first to claim as much as they do."""
    if key == "student_id":
        return rows.filter("_step AND NOT _last_student_id").select(key, F.col(statement).alias("_stmt"), F.col("_own_active").alias("_own"), "_pos")
    if repeated:
        return rows.select(key, F.col(statement).alias("_stmt"), (F.col("_left") - F.col("_own_rows")).alias("_slack"), "_pos")
    return rows.filter("NOT _last_instrument_id").select(key, F.col(statement).alias("_stmt"), F.col("_own_rows").alias("_own"), "_pos")


def _with_left(claims: DataFrame, key: str, left: DataFrame | None, rest: int) -> DataFrame:
    """Add ``_slack`` from what ``left`` says a key has before the batch, ``rest`` where it does not name the key."""
    if "_slack" in claims.columns:
        return claims
    if left is None:
        return claims.withColumn("_slack", F.lit(rest).cast("long") - F.col("_own"))
    return (claims.join(left, key, "left")
            .withColumn("_slack", F.coalesce("_left", F.lit(rest)) - F.col("_own")).drop("_left"))


def _laid(claims: DataFrame, key: str, left: DataFrame | None, rest: int) -> DataFrame:
    """``claims`` with their slack; if a key has over HOT_ROWS of them, also with ranges (``_b``, ``_e``) as ``split_hot_keys``."""
    hot = hot_keys(claims, [key])
    if hot is None:
        return _with_left(claims, key, left, rest)
    on = same_keys([key], "_h_")
    ranges = mark_edges(range_buckets(claims.join(F.broadcast(hot), on, "left_semi"), [key], ["_stmt"], "_b"), [key], "_b", "_e")
    few = None if left is None else F.broadcast(left.join(F.broadcast(hot), on, "left_semi"))
    return (_with_left(claims.join(F.broadcast(hot), on, "left_anti"), key, left, rest)
            .withColumns({"_b": F.lit(-1), "_e": F.lit(False)}).unionByName(_with_left(ranges, key, few, rest)))


def _both_keys(claims: DataFrame, key: str, rows: DataFrame) -> DataFrame:
    other = "instrument_id" if key == "student_id" else "student_id"
    return claims.withColumns({"_on_student": F.lit(key == "student_id"), other: F.lit(None).cast(rows.schema[other].dataType)})


def _settled(sides: list[DataFrame], split: bool, crowded: bool, stages: Stages) -> DataFrame:
    """The claims on students and those on instruments, each statement's with its end (``_sure``: accepted).

    A statement is open until bounds settle it, by what accepted statements took
    before each of its claims and what open ones may take.

    * It is accepted once each claim has room even if every open statement before
      it went in.
    * It is rejected once a claim finds too little left after the accepted ones.
      An open statement whose other claims all have room for certain counts as
      accepted here, if it claims no more of the key than this one: had it been
      rejected, it would have found too little left on this key, and so will this one.

    The earliest open statement settles in every round. A round is one shuffle by
    key and one by statement; its table holds the statements open at its start.
    Claims on keys with room for every statement that could go in are certain and
    limit nobody: they leave in the first round, and are not in the result. What
    is left when no more than TAIL_ROWS claims are open is run in order by one task.
    Only the numbers of open and accepted claims reach the driver.
    """
    tables, rnd, work = [], 0, None
    while True:
        rnd += 1
        if rnd == 1:
            seen = []
            for key, d in zip(("student_id", "instrument_id"), sides, strict=True):
                d = _bounds(d.withColumns({"_sure": F.lit(False), "_taken": F.lit(0).cast("long")}), [key], split, True)
                # a key that is split over ranges stays, whatever room it has
                roomy = F.bool_and("_ok").over(Window.partitionBy(*(["_b"] if split else []), key))
                d = d.withColumn("_roomy", roomy & (F.col("_b") == -1) if split else roomy).filter("NOT _roomy").drop("_roomy")
                seen.append(_both_keys(d, key, sides[1 if key == "student_id" else 0]))
            seen = seen[0].unionByName(seen[1])
        else:
            seen = _bounds(work, KEYS, split, False).filter("NOT _sure")
        if crowded:
            seen = stages.keep(seen)
            ends = seen.groupBy(F.col("_stmt").alias("_of")).agg(F.bool_or(F.col("_fails") | F.col("_bad")).alias("_out"),
                                                                 F.count_if(~F.col("_ok")).alias("_unsure"))
            done = seen.join(ends, F.col("_stmt").eqNullSafe(F.col("_of"))).drop("_of")
        else:
            of = Window.partitionBy("_stmt")
            done = seen.withColumns({"_out": F.bool_or(F.col("_fails") | F.col("_bad")).over(of), "_unsure": F.count_if(~F.col("_ok")).over(of)})
        done = done.withColumns({"_fails": F.col("_out"), "_sure": ~F.col("_out") & (F.col("_unsure") == 0),
                                 "_free": F.col("_unsure") == F.when(F.col("_ok"), 0).otherwise(1)})
        done = stages.keep(done.drop("_out", "_unsure", "_bad", "_ok"))
        if crowded:
            stages.drop(seen)
        tables.append(done)
        n = done.agg(F.count_if(~F.col("_fails") & ~F.col("_sure")).alias("open"), F.count_if("_sure").alias("new")).first()
        log.info("statements in sequence: %d claims open after round %d", n["open"], rnd)
        work = done.filter("NOT _fails")
        if n["open"] and n["open"] + n["new"] <= TAIL_ROWS:
            tables.append(stages.keep(_in_order(work)))
        if n["open"] == 0 or n["open"] + n["new"] <= TAIL_ROWS:
            return stages.together(tables).filter("_fails OR _sure")


def _bounds(claims: DataFrame, keys: list, split: bool, first: bool) -> DataFrame:
    """Add whether a claim finds too little left for certain (``_bad``) or has room for certain (``_ok``); takes what the claims
    accepted in the last round took off its slack."""
    is_open, take = ~F.col("_fails") & ~F.col("_sure"), F.col("_take")
    flags = {"_maybe": F.when(is_open, take)}
    if not first:
        flags["_new"] = F.when(F.col("_sure"), take)
        flags |= {f"_free_{n}": F.when(is_open & F.col("_free") & (F.col("_own") <= n), take) for n in FREE_LEVELS}
    seen = earlier_counts(claims, keys, ["_stmt"], flags, **_layout(split))
    if not first:
        seen = seen.withColumn("_taken", F.col("_taken") + F.col("_new"))
    bad = F.col("_taken") >= F.col("_slack")
    for n in () if first else FREE_LEVELS:
        bad = bad | F.coalesce((F.col("_own") >= n) & (F.col("_taken") + F.col(f"_free_{n}") >= F.col("_slack")), F.lit(False))
    return seen.withColumns({"_bad": bad, "_ok": F.col("_taken") + F.col("_maybe") < F.col("_slack")}).drop(*flags)


def _in_order(work: DataFrame) -> DataFrame:
    """``work`` (claims open, and accepted in the last round) settled statement by statement; the open ones' rows."""
    columns = work.columns

    def run(batches):
        import pyarrow as pa

        batches = list(batches)
        if not batches:
            return
        t = pa.Table.from_batches(batches)
        of, key, take, taken, slack, sure = (t[c].to_pylist() for c in ("_s", "_k", "_take", "_taken", "_slack", "_sure"))
        ends, used, i = [], {}, 0
        while i < len(of):
            j = i
            while j < len(of) and of[j] == of[i]:
                j += 1
            room = sure[i] or all(taken[x] + used.get(key[x], 0) < slack[x] for x in range(i, j))
            for x in range(i, j) if room else ():
                used[key[x]] = used.get(key[x], 0) + take[x]
            ends += [room] * (j - i)
            i = j
        was_open = pa.array([not x for x in sure])
        for name, values in (("_sure", ends), ("_fails", [not x for x in ends])):
            t = t.set_column(t.column_names.index(name), name, pa.array(values))
        yield from t.select(columns).filter(was_open).to_batches()

    ranked = (work.withColumn("_k", F.dense_rank().over(Window.orderBy(*KEYS)))
              .withColumn("_s", F.dense_rank().over(Window.orderBy("_stmt"))))
    return ranked.sortWithinPartitions("_s").mapInArrow(run, work.schema)


def rental_update_statements(existing: DataFrame, updates: DataFrame, order: list, statement: str, as_of=None,
                             limit: int | DataFrame = rules.DEFAULT_MAX_ACTIVE,
                             max_months: int | DataFrame = rules.DEFAULT_MAX_MONTHS, exclude_self: bool = False) -> DataFrame:
    """UPDATE statements under the two rental rules that fire on UPDATE, each against the same ``existing`` rentals.

    ``updates`` holds the new versions (``rental_id`` and the rental columns), at
    most one per rental and statement as in SQL; updates of unknown rentals touch
    no row. A row fails the active-rental rule if its new student has ``limit``
    active rentals by then: those in ``existing``, plus those that earlier rows
    of the statement gave, minus those they took. The row's own old version
    counts too, unless ``exclude_self``. The first failing row aborts its
    statement, so counting all earlier rows as done is exact up to it. A rental
    without a student counts for nobody; one without a start or an end passes
    the duration rule and is not active.

    Returns one row per statement: n_rows, accepted, reason and the order key of the first failing row.
    """
    day = to_date(as_of)
    limit, max_months = rules._setting(limit, rules.CONFIG_MAX_ACTIVE), rules._setting(max_months, rules.CONFIG_MAX_MONTHS)
    active = F.coalesce(rules.is_active("lease_expiry_time", day), F.lit(False))
    old = existing.select("rental_id", F.col("student_id").alias("_old_student"), active.alias("_old_active"))
    sequence = [c for c in order if c != statement]
    done = updates.join(old, "rental_id").select(
        statement, *sequence, F.col("student_id").alias("_student"), "_old_student", "_old_active", active.alias("_active"),
        F.coalesce(rules.duration_ok("rental_start_time", "lease_expiry_time", max_months), F.lit(True)).alias("_r3"))
    itself = F.coalesce(F.col("_old_active") & (F.col("_old_student") == F.col("_student")), F.lit(False))
    gives = done.select(statement, *sequence, "_student", F.lit(0).alias("_kind"), F.col("_active").cast("int").alias("_change"),
                        itself.alias("_itself"), "_r3")
    takes = done.filter("_old_active").select(
        statement, *sequence, F.col("_old_student").alias("_student"), F.lit(1).alias("_kind"), F.lit(-1).alias("_change"),
        F.lit(None).cast("boolean").alias("_itself"), F.lit(None).cast("boolean").alias("_r3"))
    # a row's own two events come after what it sees: its gift is the row itself, its loss is of the second kind
    seen = earlier_counts(gives.unionByName(takes), [statement, "_student"], sequence + ["_kind"], {"_moved": F.col("_change")})
    counts = rules.active_counts(existing.filter(F.col("student_id").isNotNull()), day).withColumnRenamed("student_id", "_student")
    rows = seen.filter("_kind = 0").join(counts, "_student", "left")
    has = F.when(F.col("_student").isNotNull(), F.coalesce("_existing_active", F.lit(0)) + F.col("_moved")).otherwise(F.lit(0))
    if exclude_self:
        has = has - F.col("_itself").cast("int")
    reason = F.when(has >= F.lit(limit), F.lit(rules.R_ACTIVE)).when(~F.col("_r3"), F.lit(rules.R_DURATION))
    return _first_failures(rows.withColumn("_reason", reason), statement, order, "_reason")
