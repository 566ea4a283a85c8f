"""Which denominator class governs a window: bitemporal as-of resolution over qualification histories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from provenix.functions import durations

KEY = ["tenant_id", "action_family", "destination_system"]
# The highest level each class admits, and the classes that may state a ratio.
ADMITS = {"c1": "reconciled", "c2": "reconciled", "c3": "enforced", "c4": "observed", "c5": "observed"}
LEVELS = ("observed", "enforced", "reconciled")
RATIO_CLASSES = ("c1", "c2", "c3")


def admissible_level(c: Column) -> Column:
    return F.when(c.isin("c1", "c2"), "reconciled").when(c == "c3", "enforced").when(c.isin("c4", "c5"), "observed")


def level_rank(c: Column) -> Column:
    return F.when(c == "observed", 1).when(c == "enforced", 2).when(c == "reconciled", 3)


def emits_ratio(c: Column) -> Column:
    return c.isin(*RATIO_CLASSES)


def without_backdated_upgrades(history: DataFrame) -> DataFrame:
    """Drops a record if a weaker one, effective no earlier, had been recorded before it. Class names sort from strong to weak.

    A record asks once of each weaker class of its key, and a running minimum answers: of those effective no earlier, which was recorded first. Only where that is another row of the
    record's own reference are its rivals looked at one by one.
    """
    facts = ["assigned_class", "qualified_at", "recorded_at", "qualification_ref"]
    own = [*KEY, *facts]
    rows = history.select(*own).where(" and ".join(f"{k} is not null" for k in own)).distinct()
    classes = rows.select(*KEY, F.col("assigned_class").alias("weaker")).distinct()
    told = rows.select(*own, F.col("assigned_class").alias("weaker"), F.struct("recorded_at", "qualification_ref").alias("_first"))
    asked = rows.join(classes, KEY).where("assigned_class < weaker").withColumn("_first", F.lit(None).cast(told.schema["_first"].dataType))
    later = Window.partitionBy(*KEY, "weaker").orderBy(F.col("qualified_at").desc(), F.col("_is_asked")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    marks = told.withColumn("_is_asked", F.lit(False)).unionByName(asked.withColumn("_is_asked", F.lit(True)))
    beaten = marks.withColumn("_first", F.min("_first").over(later)).where("_is_asked and _first.recorded_at < recorded_at")
    b = rows.select(*KEY, *(F.col(k).alias(f"_o_{k}") for k in facts))
    by_others = beaten.where("_first.qualification_ref = qualification_ref").join(b, KEY).where("assigned_class < _o_assigned_class and _o_qualified_at >= qualified_at and _o_recorded_at < recorded_at and _o_qualification_ref <> qualification_ref")
    dropped = beaten.where("_first.qualification_ref <> qualification_ref").select(*own).unionByName(by_others.select(*own)).distinct()
    return history.join(dropped, own, "left_anti").select(*history.columns)


def in_force(windows: DataFrame, history: DataFrame) -> DataFrame:
    """By window: the governing record (latest qualified strictly before the start), the weakest class of it and of those
    qualified inside the window, whether all of them enumerate (the inside ones from the unfiltered history), and the ceiling.

    One aggregate over the join with the window's own history; a window without a governing record keeps a row of nulls.
    """
    kept = without_backdated_upgrades(history).withColumn("kept", F.lit(True))
    marked = history.join(kept.select("qualification_ref", "kept"), "qualification_ref", "left").withColumn("kept", F.coalesce("kept", F.lit(False)))
    keys = [*KEY, "window_ref", "window_start", "window_end"]
    ends = windows.groupBy(*KEY).agg(F.max("window_end").alias("_end"))
    marked = marked.join(ends, KEY).where("qualified_at is null or qualified_at < _end").drop("_end")  # what no window of the key can see does not meet them
    joined = windows.join(marked, KEY, "left").where("qualified_at is null or qualified_at < window_end")
    missing = windows.join(joined.select("window_ref").distinct(), "window_ref", "left_anti").select(*keys)
    before = F.col("kept") & (F.col("qualified_at") < F.col("window_start"))
    within = F.col("qualified_at") >= F.col("window_start")
    latest = F.when(before, F.struct("qualified_at", "qualification_ref"))
    got = joined.groupBy(*keys).agg(
        F.max_by("qualification_ref", latest).alias("governing_ref"), F.max_by("assigned_class", latest).alias("governing_class"), F.max_by("enumeration_capable", latest).alias("governing_enumerates"),
        F.max(F.when(F.col("kept") & within, F.col("assigned_class"))).alias("weakest_within"), F.coalesce(F.bool_and(F.when(within, F.col("enumeration_capable"))), F.lit(True)).alias("within_enumerates"),
    ).unionByName(missing, allowMissingColumns=True)
    force = F.when(F.col("governing_class").isNotNull(), F.greatest("governing_class", "weakest_within"))
    return got.select(*keys, "governing_ref", force.alias("class_in_force"), (F.col("governing_enumerates") & F.coalesce("within_enumerates", F.lit(True))).alias("enumeration_capable")).withColumn("admissible_level", admissible_level(F.col("class_in_force"))).withColumn("emits_ratio", emits_ratio(F.col("class_in_force")))


def claimability(claims: DataFrame, history: DataFrame) -> DataFrame:
    """claims(window_ref, claimed_class, …): ok, ``qualification postdates window``, ``not qualified`` or ``unqualified window``."""
    force = in_force(claims, history).select("window_ref", "class_in_force")
    kept = without_backdated_upgrades(history)
    supporting = claims.join(kept, KEY).where("assigned_class <= claimed_class").groupBy("window_ref").agg(F.min("qualified_at").alias("earliest"))
    late = F.col("earliest").isNotNull() & (F.col("earliest") >= F.col("window_start"))
    reason = F.when(F.col("class_in_force").isNull(), "unqualified window").when(F.col("claimed_class") >= F.col("class_in_force"), "ok").when(late, "qualification postdates window").otherwise("not qualified")
    return claims.join(force, "window_ref").join(supporting, "window_ref", "left").select("window_ref", "tenant_id", "claimed_class", "class_in_force", reason.alias("verdict"))


def entitled(claims: DataFrame, history: DataFrame) -> DataFrame:
    """The strict variant: some record of exactly the claimed class, qualified strictly before the window."""
    found = claims.join(history, KEY).where("assigned_class = claimed_class and qualified_at < window_start").groupBy("window_ref").agg(F.count(F.lit(1)).alias("n_entitling"))
    return claims.join(found, "window_ref", "left").select("window_ref", "claimed_class", F.coalesce("n_entitling", F.lit(0)).alias("n_entitling")).withColumn("entitled", F.col("n_entitling") > 0)


def refused_upgrades(incoming: DataFrame, existing: DataFrame) -> DataFrame:
    """Incoming records that are stronger than a stored one and not later than it."""
    a, b = incoming.alias("a"), existing.alias("b")
    on = [F.col(f"a.{k}") == F.col(f"b.{k}") for k in KEY]
    return a.join(b, on[0] & on[1] & on[2] & (F.col("a.assigned_class") < F.col("b.assigned_class")) & (F.col("a.qualified_at") <= F.col("b.qualified_at")), "left_semi")


def months_of(duration: Column) -> Column:
    """Whole months of an ISO-8601 calendar duration such as P1Y6M; null if it has other parts."""
    d = durations.parse(duration)
    return F.when((d["micros"] == 0) & (d["months"] > 0), d["months"].cast("int"))


def revalidation(history: DataFrame, as_of: str, cadence: str = "cadence") -> DataFrame:
    """When each record must be looked at again, and whether that is past at ``as_of``; months clamp to their last day. A cadence that is no positive duration gives null."""
    due = durations.add(F.col("qualified_at"), F.col(cadence))
    return history.select("qualification_ref", "tenant_id", due.alias("revalidate_after")).withColumn("overdue", F.lit(as_of).cast("timestamp") >= F.col("revalidate_after"))


def constraint_audit(history: DataFrame) -> DataFrame:
    """Codes of the constraints each record breaks, in a fixed order; records that break none are left out."""
    c = F.col("assigned_class")
    codes = F.array_compact(F.array(
        F.when(F.col("identity_isolation_attribute").isNull() & (c != "c5"), "no_isolation_requires_c5"),
        F.when(F.col("identity_vendor_settable") & F.col("identity_isolation_attribute").isNull(), "settable_without_attribute"),
        F.when(c.isin("c1", "c2") & (F.col("identity_isolation_attribute").isNull() | F.col("identity_vendor_settable")), "c1_c2_require_unsettable_isolation"),
        F.when(c.isin("c1", "c2", "c3") & ~F.col("enumeration_capable"), "c1_to_c3_require_enumeration"),
        F.when(F.col("settlement_lag_s") < 0, "negative_settlement_lag"),
        F.when(F.col("deletion_traceless_possible") & c.isin("c1", "c2"), "traceless_deletion_caps_at_c3"),
    ))
    return history.select("qualification_ref", "tenant_id", codes.alias("codes")).where(F.size("codes") > 0)


def cap_audit(claims: DataFrame, history: DataFrame) -> DataFrame:
    """(attestation_id, qualification_ref, codes): where the qualification that governs a claim's window can't carry it.

    claims(attestation_id, KEY, window_start, claimed_class, validity_from, validity_until). A source from which records can be deleted without trace carries class c3 at most; it must keep its records as
    long as the attestation is valid (source_retention_days; without one it does not). Claims without a governing qualification are not judged here.
    """
    facts = F.struct("qualification_ref", "deletion_traceless_possible", "source_retention_days")
    past = claims.select("attestation_id", *KEY, "window_start").join(history, KEY).where("qualified_at < window_start")
    governing = past.groupBy("attestation_id").agg(F.max_by(facts, F.struct("qualified_at", "qualification_ref")).alias("g"))
    valid = F.unix_micros("validity_until") - F.unix_micros("validity_from")
    codes = F.array_compact(F.array(
        F.when(F.col("g.deletion_traceless_possible") & F.col("claimed_class").isin("c1", "c2"), "traceless_deletion_caps_at_c3"),
        F.when(F.coalesce(F.col("g.source_retention_days"), F.lit(0)).cast("long") * 86_400_000_000 < valid, "retention_shorter_than_validity"),
    ))
    return claims.join(governing, "attestation_id").select("attestation_id", "g.qualification_ref", codes.alias("codes")).where(F.size("codes") > 0)


def project(records: DataFrame, wire: str = "wire") -> DataFrame:
    """Columns of qualification records that follow from their signed bodies; nothing comes from beside them. Deletion is traceless if it is possible and leaves no trace."""
    x = lambda path: F.get_json_object(wire, f"$.body.{path}")
    flag = lambda path: x(path) == "true"
    return records.select(
        F.get_json_object(wire, "$.record_id").alias("record_id"), x("action_family").alias("action_family"), x("destination_system").alias("destination_system"), F.lower(x("assigned_class")).alias("assigned_class"),
        flag("enumeration.capable").alias("enumeration_capable"), flag("confirmation.capable").alias("confirmation_capable"), x("identity_isolation.attribute").alias("identity_isolation_attribute"),
        flag("identity_isolation.vendor_settable").alias("identity_vendor_settable"), x("temporal.authoritative_timestamp_source").isNotNull().alias("authoritative_time_available"),
        x("temporal.measured_settlement_lag_s").try_cast("long").alias("settlement_lag_s"), F.regexp_extract(x("retention_period"), r"^P(\d+)D$", 1).try_cast("int").alias("source_retention_days"),
        (flag("mutability.deletion_possible") & ~flag("mutability.trace_available")).alias("deletion_traceless_possible"),
    )
