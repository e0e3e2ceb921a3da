from cadenza.plans.catalog import oracle_sql, queries  # noqa: F401
