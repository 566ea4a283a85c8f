"""Exact instants out of RFC 3339 text: seconds and nanoseconds, compared without loss; leap seconds are flagged, not guessed."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PATTERN = r"\A([0-9]{4}-[0-9]{2}-[0-9]{2})T([0-9]{2}):([0-9]{2}):([0-9]{2})\.([0-9]+)(Z|[+-][0-9]{2}:[0-9]{2})\z"


def _parts(text: Column) -> list[Column]:
    return [F.regexp_extract(text, PATTERN, k) for k in range(1, 7)]


def refusal(text: Column) -> Column:
    """Why a text is no exact instant, or null if it is one: not RFC 3339, finer than nanoseconds, a leap second, an impossible time, date or offset."""
    date, hour, minute, second, fraction, zone = _parts(text)
    shape = F.coalesce(text.rlike(PATTERN) & (F.length(fraction) >= 3), F.lit(False))
    zone_ok = (zone == "Z") | ((F.substring(zone, 2, 2) <= "23") & (F.substring(zone, 5, 2) <= "59"))
    return (
        F.when(~shape, "not_rfc3339").when(F.length(fraction) > 9, "finer_than_nanoseconds").when(second == "60", "leap_second")
        .when((hour > "23") | (minute > "59") | (second > "59"), "invalid_time").when(date.try_cast("date").isNull() | (F.substring(date, 1, 4) == "0000"), "invalid_date").when(~zone_ok, "invalid_offset")
    )


def instant(text: Column) -> Column:
    """struct(s long, ns int) since 1970, which compares as the instants do; null where ``refusal`` has a reason."""
    date, hour, minute, second, fraction, zone = _parts(text)
    number = lambda c: c.try_cast("long")
    day = F.unix_date(date.try_cast("date")).cast("long")
    offset = F.when(zone == "Z", F.lit(0).cast("long")).otherwise(F.when(F.substring(zone, 1, 1) == "+", 1).otherwise(-1) * (number(F.substring(zone, 2, 2)) * 3600 + number(F.substring(zone, 5, 2)) * 60))
    s = day * 86_400 + number(hour) * 3600 + number(minute) * 60 + number(second) - offset
    return F.when(refusal(text).isNull(), F.struct(s.alias("s"), number(F.rpad(fraction, 9, "0")).cast("int").alias("ns")))


def validity(valid_from: Column, valid_until: Column, as_of: Column) -> Column:
    """not_yet_valid, current or expired at an instant, half-open; empty_interval where the end is not after the start; unchecked where one of the three is no exact instant."""
    a, b, now = instant(valid_from), instant(valid_until), instant(as_of)
    return F.when(a.isNull() | b.isNull() | now.isNull(), "unchecked").when(b <= a, "empty_interval").when(now < a, "not_yet_valid").when(now >= b, "expired").otherwise("current")


def lifecycle(attested, revocations, as_of: str):
    """attest.lifecycle on texts: (tenant_id, attestation_id, status, superseding), compared to the nanosecond.

    A transition whose effective_at is no exact instant proves nothing and makes its attestation unchecked, unless another one has taken effect.
    """
    now, at = instant(F.lit(as_of)), instant(F.col("effective_at"))
    moves = revocations.withColumn("_at", at).groupBy("tenant_id", "attestation_id").agg(
        F.max_by(F.struct(F.col("superseding_attestation_id").alias("id")), F.when(F.col("_at") <= now, F.struct("_at", "sequence"))).alias("last"), F.count_if(F.col("_at").isNull()).alias("odd")
    )
    valid = validity(F.col("validity_from"), F.col("validity_until"), F.lit(as_of))
    status = (
        F.when(F.col("last.id").isNotNull(), "superseded").when(F.col("last").isNotNull(), "revoked").when(F.coalesce("odd", F.lit(0)) > 0, "unchecked")
        .when(valid.isin("not_yet_valid", "expired", "unchecked", "empty_interval"), valid).otherwise("valid")
    )
    return attested.join(moves, ["tenant_id", "attestation_id"], "left").select("tenant_id", "attestation_id", status.alias("status"), F.col("last.id").alias("superseding"))
