"""Cascading and restricted deletes over a declared foreign-key graph.

``cascade_delete`` takes every table as a DataFrame, the list of foreign keys,
and the rows to delete from one root table. It walks the graph parents-first:
a child row is deleted when any of its ON DELETE CASCADE keys points at a
deleted parent row. Each step joins the child once against the distinct
deleted parent keys (left joins marking the hit), so a child with two cascading
parents is read once, and the deleted and surviving rows come from one pass.
"""

from __future__ import annotations

from collections import defaultdict
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.operators.integrity import key_text
from cadenza.session import ensure_checkpoint_dir
from cadenza.sources.schemas import ForeignKey


def _topological(tables, fks: list[ForeignKey]) -> list[str]:
    parents = defaultdict(set)
    for fk in fks:
        if fk.child != fk.parent:
            parents[fk.child].add(fk.parent)
    done, order = set(), []

    def visit(t, stack=()):
        if t in done:
            return
        if t in stack:
            raise ValueError(f"foreign-key cycle through {t}")
        for p in sorted(parents[t]):
            visit(p, stack + (t,))
        done.add(t)
        order.append(t)

    for t in sorted(tables):
        visit(t)
    return order


def _mark(child: DataFrame, deleted: dict[str, DataFrame], edges: list[ForeignKey], flag: str) -> DataFrame:
    """Left-join the child against each parent's distinct deleted keys; ``flag`` = hit by any edge."""
    hits = []
    out = child
    for n, fk in enumerate(edges):
        keys = (deleted[fk.parent].select(*[F.col(p).alias(f"_k{n}_{i}") for i, p in enumerate(fk.parent_cols)])
                .distinct().withColumn(f"_hit{n}", F.lit(True)))
        cond = reduce(lambda a, b: a & b,
                      [F.col(c) == F.col(f"_k{n}_{i}") for i, c in enumerate(fk.child_cols)])
        out = out.join(keys, cond, "left").drop(*[f"_k{n}_{i}" for i in range(len(fk.parent_cols))])
        hits.append(F.coalesce(F.col(f"_hit{n}"), F.lit(False)))
    return (out.withColumn(flag, reduce(lambda a, b: a | b, hits))
            .drop(*[f"_hit{n}" for n in range(len(edges))]))


def _deleted_keys(marked: DataFrame, table: str, fks) -> DataFrame | None:
    """Distinct deleted values of every column a child key points at, pinned by a checkpoint.

    Each level's delete set is computed once, however many children and
    grandchildren read it, and the cascade's lineage stays one level deep.
    """
    cols = sorted({c for fk in fks if fk.parent == table for c in fk.parent_cols})
    if not cols:
        return None
    ensure_checkpoint_dir(marked.sparkSession)
    return marked.filter("_del").select(*cols).distinct().checkpoint(eager=True)


def cascade_marks(tables: dict[str, DataFrame], fks, root: str, where: Column) -> dict[str, DataFrame]:
    """{table: table with boolean ``_del``} for the root and every table a cascade reaches."""
    fks = [fk for fk in fks if fk.child in tables and fk.parent in tables]
    marks = {root: tables[root].withColumn("_del", F.coalesce(where, F.lit(False)))}
    deleted = {root: _deleted_keys(marks[root], root, fks)}
    for t in _topological(tables, fks):
        if t == root:
            continue
        edges = [fk for fk in fks if fk.child == t and fk.on_delete == "cascade"
                 and deleted.get(fk.parent) is not None]
        if not edges:
            continue
        marks[t] = _mark(tables[t], deleted, edges, "_del")
        deleted[t] = _deleted_keys(marks[t], t, fks)
    return marks


def cascade_delete(tables: dict[str, DataFrame], fks, root: str, where: Column):
    """Returns {table: (deleted_rows, surviving_rows)} for every table reached from ``root``.

    Tables not reached keep all rows. Restricting edges are not followed; see
    ``restrict_violations``.
    """
    return {t: (m.filter("_del").drop("_del"), m.filter(~F.col("_del")).drop("_del"))
            for t, m in cascade_marks(tables, fks, root, where).items()}


def cascade_summary(tables: dict[str, DataFrame], fks, root: str, where: Column) -> DataFrame:
    """One row per table: rows deleted and kept by the cascade (one pass per table)."""
    marks = cascade_marks(tables, fks, root, where)
    parts = []
    for t, df in tables.items():
        m = marks.get(t, df.select(F.lit(False).alias("_del")))
        parts.append(m.agg(F.count_if("_del").alias("n_deleted"), F.count_if(~F.col("_del")).alias("n_kept"))
                     .select(F.lit(t).alias("table_name"), "n_deleted", "n_kept"))
    return reduce(lambda a, b: a.unionByName(b), parts)


def restrict_violations(tables: dict[str, DataFrame], fks, root: str, where: Column,
                        primary_keys: dict[str, tuple[str, ...]]) -> DataFrame:
    """Rows that block the delete: surviving children, through an ON DELETE RESTRICT key,
    of a deleted row. Empty means the delete may proceed.

    Returns child_table, child_key (its primary key), parent_table, parent_key.
    """
    fks = [fk for fk in fks if fk.child in tables and fk.parent in tables]
    marks = cascade_marks(tables, fks, root, where)
    parts = []
    for fk in fks:
        if fk.on_delete != "restrict" or fk.parent not in marks:
            continue
        child = marks[fk.child].filter(~F.col("_del")) if fk.child in marks else tables[fk.child]
        keys = (marks[fk.parent].filter("_del")
                .select(*[F.col(p).alias(f"_k{i}") for i, p in enumerate(fk.parent_cols)]).distinct())
        cond = reduce(lambda a, b: a & b, [F.col(c) == F.col(f"_k{i}") for i, c in enumerate(fk.child_cols)])
        blocked = child.join(keys, cond, "left_semi")
        parts.append(blocked.select(
            F.lit(fk.child).alias("child_table"),
            key_text(primary_keys[fk.child]).alias("child_key"),
            F.lit(fk.parent).alias("parent_table"),
            key_text(fk.child_cols).alias("parent_key")))
    if not parts:
        raise ValueError("no restricting foreign key reaches the deleted rows")
    return reduce(lambda a, b: a.unionByName(b), parts)
