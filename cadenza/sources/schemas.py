"""Domain schemas of the lesson/rental model, and the declared key graphs.

Schemas are DDL strings usable with ``spark.createDataFrame(rows, schema)`` and
``spark.read.schema(...)``. TIME columns are kept as 'HH:mm:ss' strings; CHAR(n)
values are trimmed at ingest.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

# The domain model's tables, columns and types.
SCHEMAS: dict[str, str] = {
    "person": "person_id int, person_number string, first_name string, last_name string",
    "email": "email_id string, email string",
    "person_email": "person_id int, email_id string",
    "phone": "phone_id int, phone_no string",
    "person_phone": "person_id int, phone_id int",
    "address_info": "address_id string, zip string, street string, city string",
    "person_address": "person_id int, address_id string",
    "student": "student_id int, person_id int, skill_level string",
    "contact_person": "contact_person_id int, person_id int, student_id int, relation string",
    "sibling": "student_id int, sibling_id int",
    "discount": "discount_id string, discount_rate decimal(10,2), student_id int",
    "system_config": "config_type string, config_value int",
    "instructor": ("instructor_id int, person_id int, scheduled_time_slot timestamp_ntz, "
                   "lesson_type string, teach_ensembles boolean, total_lessons_taught int"),
    "instructor_salary": "salary_payment_id string, amount decimal(10,2), date_of_payment date, instructor_id int",
    "lesson_price_history": ("lesson_price_id string, skill_level_price int, lesson_type_price int, "
                             "start_date date, end_date date, is_current boolean"),
    "lesson": ("lesson_id string, start_date date, duration string, instrument_type string, "
               "difficulty_level string, lesson_price_id string, instructor_id int"),
    "student_lessons": "lesson_id string, student_id int",
    "individual_lesson": "lesson_id string, time_slot string",
    "group_lesson": "lesson_id string, max_students int, min_students int",
    "ensembles_lesson": "lesson_id string, genre string, max_students int, min_students int, current_students int",
    "instrument": ("instrument_id string, instrument_type string, instrument_brand string, "
                   "available_stock int, lesson_id string"),
    "rental_price_history": ("rental_price_id string, instrument_id string, start_date date, end_date date, "
                             "is_current boolean, price decimal(10,2)"),
    "instrument_rental": ("rental_id string, rental_start_time timestamp_ntz, lease_expiry_time timestamp_ntz, "
                          "rental_price_id string, instrument_id string, student_id int"),
    "student_payment": ("payment_id string, payment_date date, discount_id string, rental_id string, "
                        "student_id int, amount decimal(10,2)"),
    "history_lesson": ("lesson_id string, student_id int, lesson_type string, genre string, instrument string, "
                       "lesson_price decimal(10,2), student_name string, student_email string"),
}

# Primary keys, unique columns, NOT NULL columns, length limits, enum domain.
PRIMARY_KEYS: dict[str, tuple[str, ...]] = {
    "person": ("person_id",), "email": ("email_id",), "person_email": ("person_id", "email_id"),
    "phone": ("phone_id",), "person_phone": ("person_id", "phone_id"), "address_info": ("address_id",),
    "person_address": ("person_id", "address_id"), "student": ("student_id",),
    "contact_person": ("contact_person_id",), "sibling": ("student_id", "sibling_id"),
    "discount": ("discount_id",), "system_config": ("config_type",), "instructor": ("instructor_id",),
    "lesson_price_history": ("lesson_price_id",), "lesson": ("lesson_id",),
    "student_lessons": ("lesson_id", "student_id"), "individual_lesson": ("lesson_id",),
    "group_lesson": ("lesson_id",), "ensembles_lesson": ("lesson_id",), "instrument": ("instrument_id",),
    "rental_price_history": ("rental_price_id",), "instrument_rental": ("rental_id",),
    "student_payment": ("payment_id",), "instructor_salary": ("salary_payment_id",),
    "history_lesson": ("lesson_id", "student_id"),
}
UNIQUE_COLUMNS: dict[str, tuple[str, ...]] = {
    "person": ("person_number",), "email": ("email",), "phone": ("phone_no",),
}
LENGTH_LIMITS: dict[str, dict[str, int]] = {
    "person": {"person_number": 12, "first_name": 100, "last_name": 100},
    "email": {"email_id": 10, "email": 200},
    "person_email": {"email_id": 10},
    "phone": {"phone_no": 200},
    "address_info": {"address_id": 100, "zip": 5, "street": 100, "city": 50},
    "person_address": {"address_id": 100},
    "student": {"skill_level": 100},
    "contact_person": {"relation": 100},
    "discount": {"discount_id": 50},
    "system_config": {"config_type": 50},
    "instructor": {"lesson_type": 100},
    "lesson_price_history": {"lesson_price_id": 50},
    "lesson": {"lesson_id": 50, "instrument_type": 50, "lesson_price_id": 50},
    "student_lessons": {"lesson_id": 50},
    "individual_lesson": {"lesson_id": 50},
    "group_lesson": {"lesson_id": 50},
    "ensembles_lesson": {"lesson_id": 50, "genre": 10},
    "instrument": {"instrument_id": 50, "instrument_type": 100, "instrument_brand": 100, "lesson_id": 50},
    "rental_price_history": {"rental_price_id": 50, "instrument_id": 50},
    "instrument_rental": {"rental_id": 100, "rental_price_id": 50, "instrument_id": 50},
    "student_payment": {"payment_id": 50, "discount_id": 50, "rental_id": 100},
    "instructor_salary": {"salary_payment_id": 50},
    "history_lesson": {"lesson_id": 50, "lesson_type": 50, "genre": 50, "instrument": 50, "student_name": 200,
                       "student_email": 200},
}
NULLABLE_COLUMNS: dict[str, tuple[str, ...]] = {
    "student": ("skill_level",), "instructor": ("total_lessons_taught",),
    "lesson": ("instrument_type", "lesson_price_id"), "ensembles_lesson": ("current_students",),
    "instrument": ("lesson_id",), "student_payment": ("discount_id", "rental_id"),
    "history_lesson": ("genre", "instrument"),
}
CHECKS: dict[str, tuple[str, ...]] = {
    "sibling": ("student_id <> sibling_id",), "lesson_price_history": ("end_date > start_date",),
}
DIFFICULTY_LEVELS = ("beginner", "intermediate", "advanced")
ENUM_COLUMNS: dict[str, dict[str, tuple[str, ...]]] = {"lesson": {"difficulty_level": DIFFICULTY_LEVELS}}
CONFIG_KEYS = ("max_rental_duration_months", "max_active_rentals_per_student")


@dataclass(frozen=True)
class ForeignKey:
    child: str
    child_cols: tuple[str, ...]
    parent: str
    parent_cols: tuple[str, ...]
    on_delete: str = "cascade"   # or "restrict"


def _fk(child, ccol, parent, pcol, on_delete="cascade"):
    return ForeignKey(child, (ccol,), parent, (pcol,), on_delete)


# The domain model's 29 foreign keys; one restricts deletes.
DOMAIN_FOREIGN_KEYS: tuple[ForeignKey, ...] = (
    _fk("person_email", "person_id", "person", "person_id"),
    _fk("person_email", "email_id", "email", "email_id"),
    _fk("person_phone", "person_id", "person", "person_id"),
    _fk("person_phone", "phone_id", "phone", "phone_id"),
    _fk("person_address", "person_id", "person", "person_id"),
    _fk("person_address", "address_id", "address_info", "address_id", "restrict"),
    _fk("student", "person_id", "person", "person_id"),
    _fk("contact_person", "person_id", "person", "person_id"),
    _fk("contact_person", "student_id", "student", "student_id"),
    _fk("sibling", "student_id", "student", "student_id"),
    _fk("sibling", "sibling_id", "student", "student_id"),
    _fk("discount", "student_id", "student", "student_id"),
    _fk("instructor", "person_id", "person", "person_id"),
    _fk("lesson", "lesson_price_id", "lesson_price_history", "lesson_price_id"),
    _fk("lesson", "instructor_id", "instructor", "instructor_id"),
    _fk("student_lessons", "lesson_id", "lesson", "lesson_id"),
    _fk("student_lessons", "student_id", "student", "student_id"),
    _fk("individual_lesson", "lesson_id", "lesson", "lesson_id"),
    _fk("group_lesson", "lesson_id", "lesson", "lesson_id"),
    _fk("ensembles_lesson", "lesson_id", "lesson", "lesson_id"),
    _fk("instrument", "lesson_id", "lesson", "lesson_id"),
    _fk("rental_price_history", "instrument_id", "instrument", "instrument_id"),
    _fk("instrument_rental", "rental_price_id", "rental_price_history", "rental_price_id"),
    _fk("instrument_rental", "instrument_id", "instrument", "instrument_id"),
    _fk("instrument_rental", "student_id", "student", "student_id"),
    _fk("student_payment", "discount_id", "discount", "discount_id"),
    _fk("student_payment", "rental_id", "instrument_rental", "rental_id"),
    _fk("student_payment", "student_id", "student", "student_id"),
    _fk("instructor_salary", "instructor_id", "instructor", "instructor_id"),
)

@dataclass(frozen=True)
class TableRules:
    """Declared constraints of one table; ``check`` holds SQL conditions, ``unique`` single columns."""

    primary_key: tuple[str, ...] = ()
    unique: tuple[str, ...] = ()
    not_null: tuple[str, ...] = ()
    check: tuple[str, ...] = ()
    length: dict[str, int] = field(default_factory=dict)
    domain: dict[str, tuple[str, ...]] = field(default_factory=dict)


def columns_of(table: str) -> list[str]:
    """Column names of a domain table, in order."""
    return [part.split()[0] for part in re.split(r",(?![^(]*\))", SCHEMAS[table])]


#: Every constraint of the 25 domain tables; all columns are NOT NULL but the nullable ones.
DOMAIN_RULES: dict[str, TableRules] = {
    t: TableRules(PRIMARY_KEYS[t], UNIQUE_COLUMNS.get(t, ()),
                  tuple(c for c in columns_of(t) if c not in NULLABLE_COLUMNS.get(t, ())),
                  CHECKS.get(t, ()), LENGTH_LIMITS.get(t, {}), ENUM_COLUMNS.get(t, {}))
    for t in SCHEMAS
}

# The test tables' key graph, used by the audits and the cascade on /root/testdata.
TPCH_PRIMARY_KEYS: dict[str, tuple[str, ...]] = {
    "region": ("r_regionkey",), "nation": ("n_nationkey",), "customer": ("c_custkey",),
    "supplier": ("s_suppkey",), "part": ("p_partkey",), "orders": ("o_orderkey",),
    "lineitem": ("l_orderkey", "l_linenumber"),
}
TPCH_FOREIGN_KEYS: tuple[ForeignKey, ...] = (
    _fk("nation", "n_regionkey", "region", "r_regionkey"),
    _fk("customer", "c_nationkey", "nation", "n_nationkey"),
    _fk("supplier", "s_nationkey", "nation", "n_nationkey"),
    _fk("orders", "o_custkey", "customer", "c_custkey"),
    _fk("lineitem", "l_orderkey", "orders", "o_orderkey"),
    _fk("lineitem", "l_partkey", "part", "p_partkey"),
    _fk("lineitem", "l_suppkey", "supplier", "s_suppkey"),
)
#: Constraints stated for the test tables, some of which their rows break.
TPCH_RULES: dict[str, TableRules] = {
    "region": TableRules(("r_regionkey",), ("r_name",), ("r_name",)),
    "nation": TableRules(("n_nationkey",), ("n_name",), ("n_name", "n_regionkey")),
    "customer": TableRules(("c_custkey",), (), ("c_nationkey",), ("c_acctbal >= 0",)),
    "supplier": TableRules(("s_suppkey",), (), ("s_nationkey",)),
    "part": TableRules(("p_partkey",), ("p_name",), ("p_name",), ("p_size BETWEEN 1 AND 50",), {"p_name": 10}),
    "orders": TableRules(("o_orderkey",), (), ("o_custkey", "o_orderdate"), (), {}, {"o_orderstatus": ("F", "O", "P")}),
    "lineitem": TableRules(("l_orderkey", "l_linenumber"), (), ("l_partkey", "l_suppkey"),
                           ("l_quantity > 0", "l_extendedprice > l_quantity"), {}, {"l_returnflag": ("A", "N")}),
}
