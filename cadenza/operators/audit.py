"""All declared constraints of a set of tables, audited in one pass.

Each table is read once. A row becomes a few facts: one per row rule it breaks
(NOT NULL, CHECK, length, enum), one per key it holds, and one per foreign key
value, addressed to the key it points at. Facts of one address are counted
together, in one exchange for all tables: a key held twice breaks its PRIMARY KEY
or UNIQUE rule, and a foreign key value whose address nobody holds is an orphan.
Partial sums leave one row per address and task, however often a key repeats, and
row rules one row per rule and task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.sources.schemas import ForeignKey, TableRules

KEY, FOREIGN_KEY = ("primary_key", "unique"), "foreign_key"


def row_rules(rules: TableRules) -> list[tuple[str, str, Column]]:
    """(kind, rule, whether a row breaks it) of every rule that one row decides; NULL breaks none but NOT NULL."""
    out = [("not_null", c, F.col(c).isNull()) for c in dict.fromkeys((*rules.primary_key, *rules.not_null))]
    out += [("check", text, ~F.coalesce(F.expr(text), F.lit(True))) for text in rules.check]
    out += [("length", f"{c} <= {n}", F.coalesce(F.length(c) > n, F.lit(False))) for c, n in rules.length.items()]
    out += [("enum", c, F.col(c).isNotNull() & ~F.col(c).isin(list(values))) for c, values in rules.domain.items()]
    return out


def address(columns: tuple[str, ...]) -> Column:
    """A key's value as text, NULL if any part is; parts are told apart by their lengths."""
    if len(columns) == 1:
        return F.col(columns[0]).cast("string")
    parts = [F.col(c).cast("string") for c in columns]
    return F.concat(*[F.concat(F.length(p).cast("string"), F.lit(":"), p) for p in parts])


def audit(tables: dict[str, DataFrame], rules: dict[str, TableRules],
          foreign_keys: tuple[ForeignKey, ...] = ()) -> DataFrame:
    """(table_name, kind, rule, n_rows): rows that break each declared rule, 0 where none does.

    n_rows counts the rows that hold a repeated key, or whose foreign key value
    has no parent. Keys with a NULL part equal no other and point nowhere. A
    foreign key may point at columns that are no declared key. Rules of tables
    that are not in ``tables`` (and foreign keys from or to them) are left out.
    """
    declared: list[tuple[int, int, str, str, str]] = []      # address space, role, table, kind, rule
    spaces: dict[tuple[str, tuple[str, ...]], int] = {}
    facts: dict[str, list[Column]] = {name: [] for name in tables}

    def space(table: str, columns: tuple[str, ...]) -> int:
        if (table, columns) not in spaces:
            spaces[table, columns] = n = len(declared) + len(spaces)
            facts[table].append(_fact(n, 0, address(columns)))
        return spaces[table, columns]

    for table, declared_rules in rules.items():
        if table not in tables:
            continue
        for kind, rule, breaks in row_rules(declared_rules):
            n = len(declared) + len(spaces)
            declared.append((n, 0, table, kind, rule))
            facts[table].append(F.when(breaks, F.struct(F.lit(n).alias("space"), F.lit(0).alias("role"), F.lit("").alias("key"))))
        keys = [("primary_key", declared_rules.primary_key)] if declared_rules.primary_key else []
        for kind, columns in keys + [("unique", (c,)) for c in declared_rules.unique]:
            declared.append((space(table, columns), 0, table, kind, ", ".join(columns)))
    roles: dict[int, int] = {}
    for fk in foreign_keys:
        if fk.child not in tables or fk.parent not in tables:
            continue
        n = space(fk.parent, fk.parent_cols)
        roles[n] = role = roles.get(n, 0) + 1
        declared.append((n, role, fk.child, FOREIGN_KEY,
                         f"{', '.join(fk.child_cols)} -> {fk.parent}({', '.join(fk.parent_cols)})"))
        facts[fk.child].append(_fact(n, role, address(fk.child_cols)))

    spark = next(iter(tables.values())).sparkSession
    registry = F.broadcast(spark.createDataFrame(declared, "space int, role int, table_name string, kind string, rule string"))
    every = [tables[t].select(F.explode(F.array_compact(F.array(*f))).alias("f")).select("f.*") for t, f in facts.items() if f]
    most = max(roles.values(), default=0)
    held = reduce(DataFrame.unionByName, every).groupBy("space", "key").agg(
        *[F.count_if(F.col("role") == r).alias(f"_{r}") for r in range(most + 1)])
    counted = held.select("space", F.col("_0").alias("_held"), F.explode(F.array(*[
        F.struct(F.lit(r).alias("role"), F.col(f"_{r}").alias("n")) for r in range(most + 1)])).alias("f")).select("space", "_held", "f.*")
    broken = (F.when(F.col("kind") == FOREIGN_KEY, F.col("_held") == 0)
              .when(F.col("kind").isin(*KEY), F.col("n") > 1).otherwise(F.lit(True)))
    counted = (counted.filter("n > 0").join(registry, ["space", "role"]).filter(broken)
               .groupBy("space", "role", "kind").agg(F.sum("n").alias("n_rows")))
    return registry.join(counted, ["space", "role", "kind"], "left").select(
        "table_name", "kind", "rule", F.coalesce("n_rows", F.lit(0)).cast("long").alias("n_rows"))


def _fact(space: int, role: int, key: Column) -> Column:
    return F.when(key.isNotNull(), F.struct(F.lit(space).alias("space"), F.lit(role).alias("role"), key.alias("key")))
