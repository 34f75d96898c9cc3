"""Column expressions: parsing, calendar arithmetic, exact rounding.

Everything here stays inside Spark's own expressions.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from plumbline import vocabulary as v

QUANTITY = "decimal(18,4)"

# Microseconds in one hundredth of a day.
_HUNDREDTH_OF_DAY = 864_000_000


def text(value: Column) -> Column:
    """Trimmed text, with blanks as missing."""
    return F.nullif(F.trim(value), F.lit(""))


def first_text(*candidates: Column) -> Column:
    """First candidate that carries text."""
    return F.coalesce(*[text(c) for c in candidates])


def quantity(value: Column) -> Column:
    """A decimal quantity from a number or numeric text; anything else is missing."""
    return F.trim(value.cast("string")).try_cast(QUANTITY)


def instant(value: Column) -> Column:
    """An ISO-8601 instant, missing when it does not parse."""
    return text(value).try_cast("timestamp")


def day(value: Column) -> Column:
    """The calendar date as written in the value's own offset."""
    return F.when(instant(value).isNotNull(), F.substring(F.trim(value), 1, 10).try_cast("date"))


def local_date(moment: Column, timezone: Column) -> Column:
    return F.from_utc_timestamp(moment, timezone).cast("date")


def local_midnight(date: Column, timezone: Column) -> Column:
    """The instant at which a local calendar day starts."""
    return F.to_utc_timestamp(date.cast("timestamp"), timezone)


def week_start(moment: Column) -> Column:
    """Monday of the week that contains the instant."""
    return F.date_trunc("week", moment).cast("date")


def elapsed_days(start: Column, end: Column) -> Column:
    """Days between two instants with two decimals, ties rounded to even.

    Done on whole microseconds, so no intermediate value is inexact.
    """
    micros = F.unix_micros(end) - F.unix_micros(start)
    whole = F.floor(micros / F.lit(_HUNDREDTH_OF_DAY).cast("decimal(20,0)")).cast("bigint")
    rest = micros - whole * F.lit(_HUNDREDTH_OF_DAY)
    half = F.lit(_HUNDREDTH_OF_DAY // 2)
    odd = F.pmod(whole, F.lit(2)) == 1
    carry = F.when((rest > half) | ((rest == half) & odd), 1).otherwise(0)
    return ((whole + carry).cast("decimal(16,0)") * F.lit("0.01").cast("decimal(3,2)")).cast(
        "decimal(18,2)"
    )


def is_open(category: Column) -> Column:
    """Mapped to a category, and not to a closed one."""
    return category.isNotNull() & ~category.isin(*v.CLOSED)


def ratio(numerator: Column, denominator: Column) -> Column:
    """Decimal ratio; missing when either side is missing or the divisor is zero."""
    return F.try_divide(
        numerator.cast("decimal(20,4)"), denominator.cast("decimal(20,8)")
    )


def excerpt(value: Column, limit: int = v.TITLE_EXCERPT) -> Column:
    """Text without control characters, cut to ``limit`` characters with an ellipsis."""
    clean = F.trim(F.regexp_replace(value, r"[\x00-\x1f\x7f]", " "))
    return F.when(F.length(clean) <= limit, clean).otherwise(
        F.concat(F.substring(clean, 1, limit - 1), F.lit("…"))
    )


def path_in_scope(path: Column, areas: Column, include_descendants: Column) -> Column:
    """Whether a path is one of the areas, or below one when descendants count."""
    return F.exists(
        areas,
        lambda area: (path == area)
        | (include_descendants & F.startswith(path, F.concat(area, F.lit("\\")))),
    )


def codes(pairs: Iterable[tuple[Column, str]]) -> Column:
    """Array of the codes whose condition holds, in the given order."""
    return F.array_compact(F.array(*[F.when(cond, F.lit(code)) for cond, code in pairs]))
