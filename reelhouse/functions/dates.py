"""Relative dates ("2 hours ago") in and out, against an explicit ``as_of``.

Nothing here calls ``now()``: every job gets its reference time as a
parameter, so re-running a task after an executor loss gives the same value.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from reelhouse import constants as K
from reelhouse.functions.fields import ColumnOrName, _col

_AMOUNT = r"([0-9]+|an?|one|a few)\s*"
_UNIT = r"(seconds?|secs?|minutes?|mins?|hours?|hrs?|days?|weeks?|wks?|months?|mos?|years?|yrs?)"
# "2 hours ago", "an hour ago", "2 hrs ago", "Streamed 1 mo ago".
AGO_PATTERN = rf"(?:^|[^a-z0-9]){_AMOUNT}{_UNIT}\s*ago"
# The whole text "2 hours", "yesterday" or "today": "in 2 hours" and "scheduled for today" lie ahead.
BARE_PATTERN = rf"^{_AMOUNT}{_UNIT}$"

SECONDS = {"second": 1, "sec": 1, "minute": 60, "min": 60, "hour": 3600, "hr": 3600, "day": 86400, "week": 604800, "wk": 604800}
MONTHS = {"month": 1, "mo": 1, "year": 12, "yr": 12}
AMOUNTS = {"a": 1, "an": 1, "one": 1, "a few": 3}


def as_of_literal(as_of: str) -> Column:
    """``as_of`` text (``yyyy-MM-dd HH:mm:ss``) as a TIMESTAMP_NTZ literal."""
    return F.lit(as_of).cast("timestamp_ntz")


def is_date_text(text: ColumnOrName) -> Column:
    """True when a metadata span reads like a date (contains a date word)."""
    t = _col(text)
    cond = None
    for word in K.DATE_WORDS:
        c = t.contains(word)
        cond = c if cond is None else (cond | c)
    return F.coalesce(cond & (t != ""), F.lit(False))


def relative_created(text: ColumnOrName, as_of: Column) -> Column:
    """``as_of`` minus the amount in "N unit(s) ago"; NULL when unmatched.

    The amount may be "a", "an", "one" or "a few" (three), the unit shortened
    ("hrs", "mo"); "yesterday" is one day, "today" none.  Without "ago" only a
    whole text counts, so "in 2 hours" is no date.

    Months and years move the calendar (31 Mar - 1 month = 29 Feb); the other
    units are exact durations.  The unit is looked up in two literal maps
    (seconds per unit, months per unit) instead of one branch per unit, so
    the text is matched a fixed number of times whatever the unit list.
    """
    low = F.trim(F.lower(_col(text)))
    day = low.isin("yesterday", "today")

    def part(group: int) -> Column:
        return F.when(low.contains("ago"), F.regexp_extract(low, AGO_PATTERN, group)).otherwise(
            F.regexp_extract(low, BARE_PATTERN, group))

    amount, unit = part(1), F.regexp_replace(part(2), "s$", "")
    table = lambda d: F.create_map(*[F.lit(x) for kv in d.items() for x in kv])
    n = F.when(day, (low == "yesterday").cast("bigint")).otherwise(
        F.coalesce(F.try_element_at(table(AMOUNTS), amount).cast("bigint"), amount.try_cast("bigint")))
    unit = F.when(day, "day").otherwise(unit)
    secs = F.try_element_at(table(SECONDS), unit)
    months = F.try_element_at(table(MONTHS), unit)
    shifted = F.timestamp_add("SECOND", -n * F.coalesce(secs, F.lit(0)), F.timestamp_add("MONTH", -n * F.coalesce(months, F.lit(0)), as_of))
    return F.when(n.isNotNull() & (secs.isNotNull() | months.isNotNull()), shifted)


def age_seconds(created: ColumnOrName, as_of: Column) -> Column:
    """Whole seconds from ``created`` to ``as_of`` (truncated toward zero)."""
    return F.timestamp_diff("SECOND", _col(created), as_of)


# Age buckets of the library view: (upper bound in seconds, unit seconds, unit).
AGE_BUCKETS = (
    (3600, 60, "minute"),
    (86400, 3600, "hour"),
    (604800, 86400, "day"),
    (2592000, 604800, "week"),
    (31536000, 2592000, "month"),
)


def age_text(created: ColumnOrName, as_of: Column) -> Column:
    """Human age ("just now", "3 hours ago", "1 year ago"); NULL when unknown."""
    s = age_seconds(created, as_of)

    def phrase(unit_secs: int, unit: str) -> Column:
        k = F.floor(s / F.lit(unit_secs)).cast("bigint")
        return F.concat(k.cast("string"), F.lit(" " + unit),
                        F.when(k == 1, F.lit("")).otherwise(F.lit("s")), F.lit(" ago"))

    expr = F.when(s.isNull(), F.lit(None).cast("string")) \
            .when(s < 0, F.lit("in the future")) \
            .when(s < 60, F.lit("just now"))
    for bound, unit_secs, unit in AGE_BUCKETS:
        expr = expr.when(s < bound, phrase(unit_secs, unit))
    return expr.otherwise(phrase(31536000, "year"))
