"""Row-wise column expressions. All of them stay inside whole-stage code generation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Level names and codes that results depend on.
MATURITY_CODES = {"LOW": 1, "MEDIUM": 2, "HIGH": 3}
AGENCY_SUFFIX = r"A(\d+)$"
ROUTE_SUFFIX = r"R(\d+)$"
WEEKEND_DAYS = (1, 7)  # Sunday = 1
RECENCY_DAYS = (30, 60, 90)
# (left state is positive, right state is positive) -> class
FORWARD_CODES = {(False, False): 0, (False, True): 1, (True, True): 2, (True, False): 3}
BACKWARD_CODES = {(False, False): 0, (True, True): 1, (False, True): 2, (True, False): 3}


def state_flag(state: Column, positive: str) -> Column:
    """1 for the positive state, 0 for any other state and for NULL."""
    return F.when(state == positive, 1).otherwise(0)


def other_state_flag(state: Column, positive: str) -> Column:
    """1 for a known non-positive state; NULL counts as neither."""
    return F.when(state != positive, 1).otherwise(0)


def collapse_state(state: Column, positive: str, negative: str) -> Column:
    """Two levels; NULL falls to the negative one."""
    return F.when(state == positive, F.lit(positive)).otherwise(F.lit(negative))


def ordinal(level: Column, codes: dict[str, int]) -> Column:
    """Level name to rank, unknown or NULL to NULL."""
    code = F.lit(None).cast("int")
    for name, value in codes.items():
        code = F.when(level == name, F.lit(value)).otherwise(code)
    return code


def whole_number(text: Column) -> Column:
    """Text to int; anything unparsable gives NULL instead of an ANSI error."""
    return text.try_cast("int")


def suffix_number(text: Column, pattern: str) -> Column:
    """Digits captured at the end of a code, NULL when the code has none."""
    return F.regexp_extract(text, pattern, 1).try_cast("int")


def ratio(numerator: Column, denominator: Column) -> Column:
    """``numerator / denominator``, 0 where the denominator is not positive."""
    return F.when(denominator > 0, numerator / denominator).otherwise(F.lit(0.0))


def smoothed_ratio(numerator: Column, denominator: Column) -> Column:
    return numerator / (denominator + F.lit(1))


def transition_code(
    left: Column, right: Column, positive: str, codes: dict[tuple[bool, bool], int]
) -> Column:
    """Class of a state pair; NULL when either state is unknown."""
    left_known, right_known = left == positive, right == positive
    return (
        F.when(left_known & right_known, codes[True, True])
        .when(left_known & ~right_known, codes[True, False])
        .when(~left_known & right_known, codes[False, True])
        .when(~left_known & ~right_known, codes[False, False])
    )


def change_flags(previous: Column, current: Column, positive: str) -> dict[str, Column]:
    """Changed / moved to positive / moved from positive; no previous state gives 0."""
    return {
        "changed": F.when(previous != current, 1).otherwise(0),
        "to_positive": F.when((previous != positive) & (current == positive), 1).otherwise(0),
        "from_positive": F.when((previous == positive) & (current != positive), 1).otherwise(0),
    }


def within_days(days: Column, limits: Sequence[int] = RECENCY_DAYS) -> dict[int, Column]:
    return {limit: F.when(days <= limit, 1).otherwise(0) for limit in limits}


def calendar(date: Column) -> dict[str, Column]:
    day = F.dayofweek(date)
    return {
        "month": F.month(date),
        "day_of_week": day,
        "is_weekend": F.when(day.isin(*WEEKEND_DAYS), 1).otherwise(0),
        "quarter": F.quarter(date),
    }


def year_month(date: Column) -> Column:
    return F.date_format(date, "yyyy-MM")


def split_label(date: Column, cutoff: str) -> Column:
    """TRAIN before the cutoff, TEST from it on; an unknown date is TEST."""
    return F.when(date < F.lit(cutoff).cast("date"), "TRAIN").otherwise("TEST")
