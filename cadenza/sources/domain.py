"""Reading the domain's own tables: declared schemas enforced, malformed rows set aside with their reason.

A stored table may hold other types than declared (text exports, wider numbers),
blank-padded CHAR columns, further columns, or lack nullable ones. ``read_table``
returns the rows that fit in the declared types; the others come back as they are
stored, with the columns that do not fit. Nothing is dropped: both together are
the stored rows. Constraints (keys, lengths, NOT NULL) are ``operators.audit``'s.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType, StringType

from cadenza.sources.schemas import NULLABLE_COLUMNS, SCHEMAS

# The columns declared CHAR(n), which are stored blank-padded.
CHAR_COLUMNS: dict[str, tuple[str, ...]] = {
    "person": ("person_number",), "email": ("email_id",), "person_email": ("email_id",), "address_info": ("zip",),
}
REASON, STORED = "reason", "stored"


class MissingColumns(ValueError):
    pass


def declared_schema(table: str) -> StructType:
    return StructType.fromDDL(SCHEMAS[table])


def _typed(df: DataFrame, table: str) -> tuple[list[Column], Column]:
    """The declared columns of ``df``, and the names of those whose stored value has no such type (NULL fits all)."""
    columns, misfits = [], []
    for field in declared_schema(table):
        if field.name not in df.columns:
            columns.append(F.lit(None).cast(field.dataType).alias(field.name))
            continue
        stored = F.col(f"`{field.name}`")
        if isinstance(field.dataType, StringType):
            value = stored.cast("string")
            value = F.rtrim(value) if field.name in CHAR_COLUMNS.get(table, ()) else value
        else:
            value = stored.try_cast(field.dataType)
            # a number that only fits after rounding is another number
            changed = ~value.cast("decimal(38,10)").eqNullSafe(stored.try_cast("decimal(38,10)"))
            lossy = changed if _is_number(field.dataType.typeName()) else F.lit(False)
            misfits.append(F.when(stored.isNotNull() & (value.isNull() | lossy), F.lit(field.name)))
        columns.append(value.alias(field.name))
    return columns, F.array_compact(F.array(*misfits)) if misfits else F.array().cast("array<string>")


def _is_number(type_name: str) -> bool:
    return type_name in ("integer", "long", "decimal")


def check_rows(df: DataFrame, table: str) -> tuple[DataFrame, DataFrame]:
    """(rows in the declared types, malformed rows as ``stored`` JSON with ``reason``: the columns that do not fit)."""
    lacking = [f.name for f in declared_schema(table)
               if f.name not in df.columns and f.name not in NULLABLE_COLUMNS.get(table, ())]
    if lacking:
        raise MissingColumns(f"{table} lacks {lacking}")
    columns, misfits = _typed(df, table)
    good = df.filter(F.size(misfits) == 0).select(*columns)
    bad = df.filter(F.size(misfits) > 0).select(F.lit(table).alias("table_name"), F.array_join(misfits, ", ").alias(REASON),
                                                F.to_json(F.struct("*")).alias(STORED))
    return good, bad


def read_table(spark: SparkSession, folder: str, table: str) -> tuple[DataFrame, DataFrame]:
    """``check_rows`` of the Parquet table ``folder``/``table``.parquet (a file or a folder)."""
    return check_rows(spark.read.parquet(f"{folder.rstrip('/')}/{table}.parquet"), table)


def read_domain(spark: SparkSession, folder: str, tables=None) -> tuple[dict[str, DataFrame], DataFrame]:
    """All domain tables by name, ready for the reports, rules and audits, and the malformed rows of all of them."""
    good, bad = {}, None
    for table in tables or SCHEMAS:
        good[table], rest = read_table(spark, folder, table)
        bad = rest if bad is None else bad.unionByName(rest)
    return good, bad
