from orderlens.functions.exprs import (  # noqa: F401
    CANCELED, DELIVERED, blank_to_null, calendar_days, cents_sum, count_when, LATE, ON_TIME,
    delivery_status, full_days, is_delivered, is_late, mean, money, money_sum,
    money_total, month_start, months_between_starts,
    pct, ratio, strip_all, wide,
)
