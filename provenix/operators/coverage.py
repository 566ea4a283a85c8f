"""Coverage reports: support and occurrence of each action, gaps, numerator, level, ratio; all windows at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from provenix.functions import intervals
from provenix.operators.qualify import LEVELS, level_rank
from provenix.operators.reconcile import SCOPE, STATUSES
from provenix.sources.shared import stored

POPULATION = [*SCOPE, "population_ref"]
HOUR, LAST = 3_600_000_000, (1 << 63) - 1  # microseconds; the hour of an end that has not come


def support(results: DataFrame, confirmations: DataFrame, receipts: DataFrame, skew_ms: int = 5000) -> DataFrame:
    """By result: what it supports and when it happened. A match is reconciled at the destination's time; else a bound receipt is
    observed at its ingest time; skewed when that receipt's clock is off by more than ``skew_ms``."""
    conf = confirmations.select(*SCOPE, F.col("record_id").alias("confirmation_record_id"), F.col("authoritative_time").alias("confirmed_at"))
    bound = receipts.groupBy(*SCOPE, "destination_record_id", "action_id").agg(F.max("ingest_time").alias("ingest_time"), F.max("clock_skew_ms").alias("clock_skew_ms"))
    return supported(results.join(conf, [*SCOPE, "confirmation_record_id"], "left").join(bound, [*SCOPE, "destination_record_id", "action_id"], "left"), skew_ms)


def supported(evidenced: DataFrame, skew_ms: int = 5000) -> DataFrame:
    """``support`` of results that carry their times, see ``reconcile.evidenced``."""
    matched = F.col("status") == "matched"
    observed = ~matched & F.col("ingest_time").isNotNull() & F.col("status").isin("unmatched_with_evidence", "duplicate")
    return evidenced.select(
        *POPULATION, "destination_record_id", "status", "action_id",
        F.when(matched, "reconciled").when(observed, "observed").alias("support"),
        F.when(matched, F.col("confirmed_at")).when(observed, F.col("ingest_time")).alias("occurred_at"),
        (observed & (F.abs("clock_skew_ms") > skew_ms)).alias("skewed"),
    )


def claimed_level(evidence: F.Column, admissible: F.Column) -> F.Column:
    """The weaker of what the evidence supports and the class admits; null without a class."""
    rank = F.least(level_rank(evidence), level_rank(admissible))
    return F.when(admissible.isNotNull(), F.element_at(F.array(*(F.lit(x) for x in LEVELS)), rank))


def ratio_state(emits: F.Column, truncated: F.Column, enumerable: F.Column, inline: F.Column, count: F.Column, out_of_scope: F.Column) -> F.Column:
    return (
        F.when(~emits, "denominator_class_withholds_ratio").when(truncated, "truncated_population").when(~enumerable, "population_not_enumerable")
        .when(~inline, "digest_only_population").when(count == 0, "empty_population").when(count - out_of_scope <= 0, "denominator_empty_after_exclusions").otherwise("available")
    )


def four_places(numerator: F.Column, denominator: F.Column) -> F.Column:
    """Ratio as text with four places, cut off, not rounded; null over zero."""
    scaled = F.when(denominator > 0, F.floor(numerator.cast("decimal(20,0)") * 10000 / denominator).cast("long"))
    return F.when(scaled.isNotNull(), F.format_string("%d.%04d", F.floor(scaled / 10000).cast("long"), scaled % 10000))


def _classed(populations: DataFrame, classes: DataFrame) -> DataFrame:
    named = classes.select(F.col("window_ref").alias("population_ref"), "tenant_id", "class_in_force", "enumeration_capable", "admissible_level", "emits_ratio")
    return populations.join(named, ["tenant_id", "population_ref"], "left")


def _stated(every: DataFrame) -> DataFrame:
    """With ratio_state and independently_enumerable, of populations with their class and how many records are out of scope."""
    truncated = F.col("result_cap_hit") | ~F.col("pagination_complete")
    emits, enumerable = F.coalesce("emits_ratio", F.lit(False)), F.coalesce("enumeration_capable", F.lit(False))
    inline = F.col("identifier_digest").isNull() if "identifier_digest" in every.columns else F.lit(True)
    state = ratio_state(emits, truncated, enumerable, inline, F.col("signed_count"), F.col("out_of_scope"))
    return every.withColumns({"ratio_state": state, "independently_enumerable": enumerable & emits & ~truncated})


def ratio_states(populations: DataFrame, classes: DataFrame, out_of_scope: DataFrame) -> DataFrame:
    """The states that ``report`` gives, without its counts: they rest on the class and on how many records are out of scope (``reconcile.out_of_scope``), not on support or gaps."""
    every = _classed(populations.join(out_of_scope, POPULATION, "left"), classes).fillna(0, ["out_of_scope"])
    return _stated(every).select(*POPULATION, "ratio_state", "out_of_scope", "independently_enumerable")


def report(facts: DataFrame, populations: DataFrame, classes: DataFrame, gaps: DataFrame | None = None) -> DataFrame:
    """One row for each population: six counts, level supported, admissible and claimed, numerator, ratio and its state.

    A population that gives a digest of its identifiers in place of them (identifier_digest, where that column exists) has no ratio. facts comes from ``support``; classes from ``qualify.in_force`` with the population as window; gaps(keys, gap_start, gap_end).

    The report only counts, so facts of one population that are alike in all it asks about are one row with their number, stored once for all that follows.
    """
    windows = populations.select(*POPULATION, "window_start", "window_end")
    alike = stored(facts.groupBy(*POPULATION, "status", "support", "occurred_at", "skewed").agg(F.count(F.lit(1)).alias("n_facts")), "alike")
    placed = alike.join(windows, POPULATION).withColumn("in_window", (F.col("occurred_at") >= F.col("window_start")) & (F.col("occurred_at") < F.col("window_end")))
    if gaps is not None:
        merged = intervals.merge(gaps, POPULATION)
        instants = placed.where("in_window").select(*POPULATION, "occurred_at").distinct()
        placed = placed.join(intervals.inside(instants, merged, POPULATION, "occurred_at").withColumn("hit", F.lit(True)), [*POPULATION, "occurred_at"], "left")
        any_gap = gaps.select(*POPULATION).distinct().withColumn("any_gap", F.lit(True))
        placed = placed.join(any_gap, POPULATION, "left")
    else:
        placed = placed.withColumn("hit", F.lit(False)).withColumn("any_gap", F.lit(False))
    placed = placed.withColumn("in_gap", F.col("skewed") | F.coalesce("hit", F.lit(False))).withColumn("reconciled_in_gap", F.col("in_gap") & (F.col("status") == "matched") & (F.col("support") == "reconciled") & ~F.col("skewed"))
    best = placed.groupBy(*POPULATION).agg(F.max(level_rank(F.col("support"))).alias("best"))
    head = _classed(populations.join(best, POPULATION, "left"), classes)
    head = head.withColumn("evidence_level", F.element_at(F.array(*(F.lit(x) for x in LEVELS)), F.coalesce("best", F.lit(1)))).withColumn("claimed_level", claimed_level(F.col("evidence_level"), F.col("admissible_level")))
    counted = (
        F.col("support").isNotNull() & ~F.col("skewed") & F.coalesce("in_window", F.lit(True)) & ~F.col("status").isin("unmatched_without_evidence", "out_of_scope")
        & ~(F.col("in_gap") & ~F.col("reconciled_in_gap")) & ~(F.col("in_gap") & (F.col("claimed_level") != "reconciled"))
        & ~(F.coalesce("any_gap", F.lit(False)) & F.col("occurred_at").isNull()) & (level_rank(F.col("support")) >= level_rank(F.col("claimed_level")))
    )
    number = lambda cond: F.sum(F.when(cond, F.col("n_facts")).otherwise(0))
    tally = placed.join(head.select(*POPULATION, "claimed_level"), POPULATION).groupBy(*POPULATION).agg(
        number(counted).alias("numerator"), number(F.col("in_gap")).alias("actions_in_gaps"), number(F.col("reconciled_in_gap")).alias("reconciled_in_gaps"),
        *(number(F.col("status") == s).alias(s) for s in STATUSES),
    )
    every = head.join(tally, POPULATION, "left").fillna(0, ["numerator", "actions_in_gaps", "reconciled_in_gaps", *STATUSES])
    every = _stated(every)
    return every.select(
        *POPULATION, "class_in_force", "evidence_level", "admissible_level", "claimed_level", (F.col("claimed_level") != F.col("evidence_level")).alias("capped_by_class"), "ratio_state", "numerator", "signed_count",
        F.when(F.col("ratio_state") == "available", four_places(F.col("numerator"), F.col("signed_count") - F.col("out_of_scope"))).alias("coverage_ratio"),
        "independently_enumerable", *STATUSES, "actions_in_gaps", "reconciled_in_gaps", (F.col("numerator") != F.col("matched")).alias("numerator_differs_from_matched"),
    )


def gap_actions(points: DataFrame, gaps: DataFrame, keys: list[str]) -> DataFrame:
    """Actions in a merged gap or with a skewed clock: reconciled if matched and not skewed, else unknown."""
    merged = intervals.merge(gaps, keys)
    inside = intervals.inside(points.select(*keys, "action_id", "occurred_at"), merged, keys, "occurred_at").select(*keys, "action_id", F.lit(True).alias("hit"))
    got = points.join(inside, [*keys, "action_id"], "left").where("hit or is_skewed")
    return got.select(*keys, "action_id", F.when(F.col("is_matched") & ~F.col("is_skewed"), "reconciled").otherwise("unknown").alias("classification"))


def located_counts(points: DataFrame, gaps: DataFrame, keys: list[str]) -> DataFrame:
    """How many actions lie in each gap as declared, before merging; a gap without actions counts 0, one without an end is open.

    The actions before a gap's end less those before its beginning, whatever its length: each edge is counted among the actions of its own hour, and hours are summed up by key.
    """
    hour = lambda at: F.call_function("div", F.unix_micros(at) - F.pmod(F.unix_micros(at), F.lit(HOUR)), F.lit(HOUR))
    real = gaps.where("gap_start is not null and (gap_end is null or gap_end > gap_start)")
    edge = lambda at, sign: F.struct(F.col(at).alias("at"), F.coalesce(hour(at), F.lit(LAST)).alias("hour"), F.lit(sign).alias("sign"))
    edges = real.select(*keys, "gap_id", F.explode(F.array(edge("gap_start", -1), edge("gap_end", 1))).alias("e")).select(*keys, "gap_id", "e.at", "e.hour", "e.sign")
    acts = points.where("occurred_at is not null").select(*keys, F.lit(None).cast(gaps.schema["gap_id"].dataType).alias("gap_id"), F.col("occurred_at").alias("at"), hour("occurred_at").alias("hour"), F.lit(0).alias("sign"))
    marks, act = edges.unionByName(acts), F.when(F.col("sign") == 0, 1).otherwise(0)
    within = Window.partitionBy(*keys, "hour").orderBy("at", F.col("sign") == 0).rowsBetween(Window.unboundedPreceding, Window.currentRow)  # an action at an edge's own instant comes after it
    before = Window.partitionBy(*keys).orderBy("hour").rowsBetween(Window.unboundedPreceding, -1)
    earlier = marks.groupBy(*keys, "hour").agg(F.sum(act).alias("n")).withColumn("earlier", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    placed = marks.withColumn("n", F.sum(act).over(within)).where("sign <> 0").join(earlier, [*keys, "hour"])
    found = placed.groupBy(*keys, "gap_id").agg(F.sum(F.col("sign") * (F.col("earlier") + F.col("n"))).alias("n_located"))
    return gaps.select(*keys, "gap_id").join(found, [*keys, "gap_id"], "left").fillna(0, ["n_located"])


def observation_only(facts: DataFrame, collectors: DataFrame) -> DataFrame:
    """Caps at observed what a collector in observation mode reports: facts(tenant_id, collector_id, support)."""
    mode = collectors.select("tenant_id", "collector_id", "observation_only").distinct()
    return facts.join(mode, ["tenant_id", "collector_id"], "left").withColumn("support", F.when(F.coalesce("observation_only", F.lit(False)) & F.col("support").isNotNull(), "observed").otherwise(F.col("support")))
