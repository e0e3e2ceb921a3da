from cadenza.functions.pg import (  # noqa: F401
    as_date,
    date_lit,
    day_abbrev,
    dow_sunday0,
    in_month,
    in_year,
    month_abbrev,
    pg_concat,
    plus_months,
    to_date,
    whole_days,
)
