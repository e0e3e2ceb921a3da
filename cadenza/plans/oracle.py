"""Oracle SQL (DuckDB dialect) for every registered key.

Each statement starts from the raw test tables (pre-registered views region,
nation, customer, supplier, part, orders, lineitem) and re-states the adapter
mapping of ``cadenza.sources.adapters`` as CTEs, then the query itself in plain
SQL: windows where we use a scan, joins where we use joins. Column names and
types match the Spark output exactly.
"""

from __future__ import annotations

DOMAIN_CTES = """
lesson AS (
  SELECT o_orderkey AS lesson_id, CAST(o_orderdate AS DATE) AS start_date,
         o_orderpriority AS instrument_type, o_custkey AS lesson_price_id, o_custkey AS instructor_id
  FROM orders),
typed AS (
  SELECT o_orderkey, o_orderstatus, CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS d
  FROM orders WHERE CAST(substr(o_orderpriority, 1, 1) AS INTEGER) < 5),
individual_lesson AS (
  SELECT o_orderkey AS lesson_id, '10:00:00' AS time_slot FROM typed WHERE o_orderstatus = 'F'),
group_lesson AS (
  SELECT o_orderkey AS lesson_id, d * 2 + 2 AS max_students, 2 AS min_students
  FROM typed WHERE o_orderstatus = 'O'),
ensembles_lesson AS (
  SELECT o_orderkey AS lesson_id,
         CASE d WHEN 1 THEN 'Classical' WHEN 2 THEN 'Jazz' WHEN 3 THEN 'Rock' ELSE 'Pop' END AS genre,
         d + 2 AS max_students, 1 AS min_students, 0 AS current_students
  FROM typed WHERE o_orderstatus = 'P'),
lesson_types AS (
  SELECT o_orderkey AS lesson_id,
         CASE WHEN d < 5 AND o_orderstatus = 'F' THEN 'individual'
              WHEN d < 5 AND o_orderstatus = 'O' THEN 'group'
              WHEN d < 5 AND o_orderstatus = 'P' THEN 'ensemble' END AS lesson_type,
         CASE WHEN d < 5 AND o_orderstatus = 'F' THEN 1
              WHEN d < 5 AND o_orderstatus = 'O' THEN d * 2 + 2
              WHEN d < 5 AND o_orderstatus = 'P' THEN d + 2 END AS capacity
  FROM (SELECT o_orderkey, o_orderstatus, CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS d FROM orders)),
student_lessons AS (SELECT l_orderkey AS lesson_id, l_suppkey AS student_id FROM lineitem),
student AS (SELECT s_suppkey AS student_id, s_nationkey AS person_id FROM supplier),
person AS (
  SELECT n_nationkey AS person_id, split_part(n_name, '_', 1) AS first_name,
         split_part(n_name, '_', 2) AS last_name FROM nation),
person_email AS (SELECT n_nationkey AS person_id, n_regionkey AS email_id FROM nation),
email AS (SELECT r_regionkey AS email_id, lower(r_name) || '@example.com' AS email FROM region),
lesson_price_history AS (
  SELECT c_custkey AS lesson_price_id, c_nationkey AS skill_level_price,
         CAST(floor(c_acctbal) AS INTEGER) AS lesson_type_price FROM customer),
instructor AS (SELECT s_suppkey AS instructor_id, s_nationkey AS person_id FROM supplier),
instructor_lesson AS (
  SELECT l_orderkey AS lesson_id, CAST(l_shipdate AS DATE) AS start_date, l_suppkey AS instructor_id
  FROM lineitem),
sibling_raw AS (
  SELECT a.c_custkey AS student_id, b.c_custkey AS sibling_id
  FROM customer a JOIN customer b ON b.c_custkey = a.c_custkey + 1 AND a.c_mktsegment = b.c_mktsegment),
sibling AS (
  SELECT student_id, sibling_id FROM sibling_raw WHERE student_id <> sibling_id
  UNION
  SELECT sibling_id, student_id FROM sibling_raw WHERE student_id <> sibling_id),
instrument AS (
  SELECT p_partkey AS instrument_id, p_type AS instrument_type, p_size AS available_stock FROM part),
rental AS (
  SELECT l.l_orderkey, l.l_linenumber, l.l_partkey, l.l_suppkey, l.l_quantity, l.l_extendedprice,
         l.l_shipdate AS lease_expiry_time, l.l_linestatus, o.o_custkey AS student_id,
         o.o_orderdate AS rental_start_time, l.l_partkey AS instrument_id
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey)
"""


def with_domain(body: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}" + DOMAIN_CTES.strip() + "\n" + body.strip()


ORACLE: dict[str, str] = {}


def register(key: str, body: str, domain: bool = True, recursive: bool = False) -> None:
    ORACLE[key] = with_domain(body, recursive) if domain else body.strip()
