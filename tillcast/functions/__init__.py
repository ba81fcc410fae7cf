"""Column functions; all run inside whole-stage codegen."""

from tillcast.functions.dates import (
    date_from_key,
    key_from_date,
    month_index,
    quarter_of_month,
    shipping_days,
)
from tillcast.functions.scalars import positive_flag, truncated_mean, two_decimals, zero_if_null

__all__ = [
    "date_from_key",
    "key_from_date",
    "month_index",
    "positive_flag",
    "quarter_of_month",
    "shipping_days",
    "truncated_mean",
    "two_decimals",
    "zero_if_null",
]
