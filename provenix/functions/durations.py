"""ISO 8601 durations as columns: calendar months and fixed microseconds, never a guess of one from the other."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Years, months, weeks, days, the time part, hours, minutes, seconds.
PATTERN = r"\AP(?:([0-9]+)Y)?(?:([0-9]+)M)?(?:([0-9]+)W)?(?:([0-9]+)D)?(T(?:([0-9]+)H)?(?:([0-9]+)M)?(?:([0-9]+(?:[.,][0-9]+)?)S)?)?\z"
MOST_MONTHS, MOST_MICROS = 12 * 9999, 9999 * 366 * 86_400_000_000
LAST = 253_402_300_799_999_999  # microseconds to the end of year 9999


def parse(text: Column | str) -> Column:
    """struct(months long, micros long) of a positive duration; null for any other text.

    Weeks stand alone; a T needs a part after it; parts are whole but for seconds, whose digits after the sixth are cut off. A duration of more than 9999 years, or that is nothing, is none.
    """
    text = F.col(text) if isinstance(text, str) else text
    part = [F.regexp_extract(text, PATTERN, k) for k in range(1, 9)]
    has = [p != "" for p in part]
    number = lambda p: F.coalesce(F.when(p != "", p).try_cast("decimal(38,0)"), F.when(p == "", F.lit(0).cast("decimal(38,0)")))
    years, months, weeks, days, _, hours, minutes, _ = (number(p) if k not in (4, 7) else None for k, p in enumerate(part))
    seconds, fraction = F.regexp_extract(part[7], r"^([0-9]*)", 1), F.rpad(F.substring(F.regexp_extract(part[7], r"[.,]([0-9]+)$", 1), 1, 6), 6, "0")
    total = F.struct(years, months, weeks, days, hours, minutes, number(seconds))
    bounded = lambda x, most: F.when(x <= most, x.cast("long"))
    # each part by itself is held to the bound before it is multiplied
    small = lambda x: F.when(x <= 10**15, x)
    all_months = bounded(small(years) * 12 + small(months), MOST_MONTHS)
    all_micros = bounded(
        (small(weeks) * 604_800 + small(days) * 86_400 + small(hours) * 3600 + small(minutes) * 60 + small(number(seconds))).cast("decimal(25,0)") * 1_000_000 + number(F.when(has[7], fraction).otherwise("")), MOST_MICROS
    )
    others = has[0] | has[1] | has[3] | has[5] | has[6] | has[7]
    right = text.rlike(PATTERN) & (others | has[2]) & ~(has[2] & others) & ~(has[4] & ~(has[5] | has[6] | has[7])) & total.isNotNull()
    return F.when(right & ((all_months > 0) | (all_micros > 0)), F.struct(all_months.alias("months"), all_micros.alias("micros")))


def add(start: Column, text: Column) -> Column:
    """start plus a duration: months first, to the last day of a shorter month, then the fixed part. Null without a duration, or past year 9999. Months are those of the session's time zone."""
    d = parse(text)
    after = F.try_add(start, F.make_ym_interval(F.lit(0), F.least(d["months"], F.lit(MOST_MONTHS)).cast("int")))
    micros = F.unix_micros(after) + d["micros"]
    return F.when((F.year(start) + F.floor(d["months"] / 12) <= 9998) & (micros <= LAST), F.timestamp_micros(micros))
