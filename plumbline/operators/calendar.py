"""Working days, days off and remaining reserved capacity.

``calendars`` is one row per team, from :func:`team_calendars`: the local first day
and exclusive end day of the window, the local ``today``, the configured weekdays
(Monday = 0), the blocked dates and the policy for the current day.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline import vocabulary as v
from plumbline.functions.columns import local_date
from plumbline.operators.skew import attach

_FACTOR = "decimal(9,4)"


def team_calendars(settings: DataFrame, windows: DataFrame) -> DataFrame:
    """Calendar frame per team, in the team's own time zone."""
    return settings.join(windows.drop("timezone"), "team_id").select(
        "team_id",
        local_date(F.col("window_start"), F.col("timezone")).alias("first_day"),
        local_date(F.col("window_end"), F.col("timezone")).alias("end_day"),
        local_date(F.col("as_of"), F.col("timezone")).alias("today"),
        "working_days",
        "current_day_policy",
        F.array_union("holidays", "team_days_off").alias("blocked_days"),
    )


def _window_days() -> Column:
    """Days of a window; an empty or inverted one has none."""
    last = F.date_sub("end_day", 1)
    return F.when(F.col("first_day") <= last, F.sequence("first_day", last))


def _is_working(day: Column) -> Column:
    return F.array_contains(F.col("working_days"), F.weekday(day))


def working_days(calendars: DataFrame) -> DataFrame:
    """Configured weekdays inside each team's window."""
    return calendars.select("*", F.explode(_window_days()).alias("day")).where(
        _is_working(F.col("day"))
    ).select("team_id", "day")


def day_off_fractions(days_off: DataFrame) -> DataFrame:
    """Share of each day that is off: the largest of the overlapping entries.

    A team-wide entry has no ``person_id``; an entry without a fraction is a full day.
    """
    last = F.date_sub("end", 1)
    return (
        days_off.where(F.col("start") <= last)
        .select(
            "team_id",
            "person_id",
            F.explode(F.sequence("start", last)).alias("day"),
            F.coalesce("fraction", F.lit(1)).cast(_FACTOR).alias("fraction"),
        )
        .groupBy("team_id", "person_id", "day")
        .agg(F.max("fraction").alias("fraction"))
    )


def remaining_team_days(calendars: DataFrame) -> DataFrame:
    """Working days still ahead of each team, without holidays and team days off."""
    first = F.when(
        F.col("current_day_policy") == v.INCLUDE_TODAY, F.col("today")
    ).otherwise(F.date_add("today", 1))
    day = F.col("day")
    return calendars.select("*", F.explode(_window_days()).alias("day")).where(
        _is_working(day) & (day >= first) & ~F.array_contains("blocked_days", day)
    ).select("team_id", "day")


def eligible_day_factors(
    calendars: DataFrame, people: DataFrame, days_off: DataFrame
) -> DataFrame:
    """Available share of every remaining day, per person.

    ``people`` has one row per (team_id, person_id). Team-wide and personal days off
    form a union: the larger share counts, once. Fully taken days are left out.
    """
    fractions = day_off_fractions(days_off)
    team_off = fractions.where("person_id is null").select(
        "team_id", "day", F.col("fraction").alias("team_fraction")
    )
    personal = fractions.where("person_id is not null").select(
        "team_id", "person_id", "day", F.col("fraction").alias("personal_fraction")
    )
    days = remaining_team_days(calendars).join(team_off, ["team_id", "day"], "left")
    per_team = days.groupBy("team_id").agg(
        F.collect_list(F.struct("day", "team_fraction")).alias("days")
    )
    expanded = attach(
        people.select("team_id", "person_id"), per_team, "team_id", "inner"
    ).select("team_id", "person_id", F.inline("days"))
    factor = F.lit(1).cast(_FACTOR) - F.greatest(
        F.coalesce("team_fraction", F.lit(0).cast(_FACTOR)),
        F.coalesce("personal_fraction", F.lit(0).cast(_FACTOR)),
    )
    return (
        expanded.join(personal, ["team_id", "person_id", "day"], "left")
        .select("team_id", "person_id", "day", factor.cast(_FACTOR).alias("factor"))
        .where("factor > 0")
    )


def reserved_capacity(
    calendars: DataFrame, reservations: DataFrame, factors: DataFrame
) -> DataFrame:
    """Remaining capacity per (team, person, unit): daily reservations x available days.

    Activities in the same unit add up; one unknown daily value makes the sum unknown,
    and so does a team without a calendar window. A person without reservations has no
    row, which is not the same as zero.
    """
    daily = reservations.groupBy("team_id", "person_id", "unit").agg(
        F.when(F.count(F.lit(1)) == F.count("per_day"), F.sum("per_day"))
        .cast("decimal(18,4)")
        .alias("per_day")
    )
    available = factors.groupBy("team_id", "person_id").agg(
        F.sum("factor").cast("decimal(12,4)").alias("available_days")
    )
    none = F.lit(0).cast("decimal(12,4)")
    capacity = F.when(
        F.col("has_window"), F.col("per_day") * F.coalesce("available_days", none)
    )
    teams = calendars.select("team_id", F.lit(True).alias("has_window"))
    known = daily.join(available, ["team_id", "person_id"], "left")
    return attach(known, teams, "team_id").select(
        "team_id",
        "person_id",
        F.col("unit").alias("capacity_unit"),
        capacity.cast("decimal(38,8)").alias("capacity_value"),
    )


def team_capacity(
    settings: DataFrame, reservations: DataFrame, capacities: DataFrame
) -> DataFrame:
    """Capacity per team in the team's unit, with the people it could not be stated for.

    A team without reservations has a missing value over zero eligible people. A team
    without a window has no value either: nothing was multiplied.
    """
    units = settings.select("team_id", "unit")
    reserved = reservations.select("team_id", "person_id").distinct()
    known = attach(capacities, units, "team_id", "inner").where("capacity_unit = unit")
    per_person = reserved.join(
        known.select("team_id", "person_id", "capacity_value"), ["team_id", "person_id"], "left"
    )
    totals = per_person.groupBy("team_id").agg(
        F.sum("capacity_value").cast("decimal(38,8)").alias("capacity_value"),
        F.count(F.lit(1)).alias("eligible"),
        F.count("capacity_value").alias("known"),
    )
    zero = F.lit(0).cast("bigint")
    return units.join(totals, "team_id", "left").select(
        "team_id",
        F.col("unit").alias("capacity_unit"),
        "capacity_value",
        F.coalesce("eligible", zero).alias("eligible"),
        F.coalesce("known", zero).alias("known"),
        (F.coalesce("eligible", zero) - F.coalesce("known", zero)).alias("missing"),
    )


def day_strip(calendars: DataFrame, days_off: DataFrame) -> DataFrame:
    """Each day of the window as non_working, off, past, today or eligible.

    The first kind that applies wins, in that order. Personal days off do not mark a
    day; see :func:`day_strip_totals`.
    """
    team_off = (
        day_off_fractions(days_off)
        .where("person_id is null")
        .select("team_id", "day", F.lit(True).alias("team_off"))
    )
    day = F.col("day")
    kind = (
        F.when(~_is_working(day), "non_working")
        .when(F.array_contains("blocked_days", day) | F.col("team_off").isNotNull(), "off")
        .when(day < F.col("today"), "past")
        .when(day == F.col("today"), "today")
        .otherwise("eligible")
    )
    return (
        calendars.select("*", F.explode(_window_days()).alias("day"))
        .join(team_off, ["team_id", "day"], "left")
        .select("team_id", "day", kind.alias("kind"), (day == F.col("today")).alias("is_today"))
    )


def day_strip_totals(calendars: DataFrame, days_off: DataFrame) -> DataFrame:
    """Per team: eligible days left, and distinct personal (person, day) off in the window."""
    remaining = (
        day_strip(calendars, days_off)
        .where("kind = 'eligible'")
        .groupBy("team_id")
        .agg(F.count(F.lit(1)).alias("remaining_days"))
    )
    frame = calendars.select("team_id", "first_day", "end_day")
    personal = (
        attach(
            day_off_fractions(days_off).where("person_id is not null"), frame, "team_id", "inner"
        )
        .where("day >= first_day and day < end_day")
        .groupBy("team_id")
        .agg(F.count(F.lit(1)).alias("personal_days_off"))
    )
    zero = F.lit(0).cast("bigint")
    return (
        calendars.select("team_id")
        .join(remaining, "team_id", "left")
        .join(personal, "team_id", "left")
        .select(
            "team_id",
            F.coalesce("remaining_days", zero).alias("remaining_days"),
            F.coalesce("personal_days_off", zero).alias("personal_days_off"),
        )
    )
