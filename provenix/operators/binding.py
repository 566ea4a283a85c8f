"""Whether what came back answers what was asked, and whether a claim's parts name the same scope."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FAMILY = ["action_family", "destination_system"]


def capability_audit(connectors: DataFrame) -> DataFrame:
    """connectors(enumeration, confirmation, authoritative_time, settlement_lag_s, attribution_surface, confirmation_access) with the codes of
    what contradicts itself, and whether they may support a claim on a window: that takes enumeration and the destination's own time."""
    enumerates, confirms, lag = F.col("enumeration"), F.col("confirmation"), F.col("settlement_lag_s")
    surface, access = F.col("attribution_surface"), F.col("confirmation_access")
    codes = F.array_compact(F.array(
        F.when(lag < 0, "settlement_lag_negative"), F.when(~enumerates & lag.isNotNull(), "settlement_lag_without_enumeration"),
        F.when(enumerates == (surface == "enumeration_unavailable"), "attribution_surface_contradicts_enumeration"),
        F.when(confirms == (access == "not_available"), "confirmation_access_contradicts_confirmation"),
        F.when((access == "shared_with_enumeration") & ~enumerates, "confirmation_shared_without_enumeration"),
    ))
    return connectors.withColumn("codes", codes).withColumn("supports_window_claim", enumerates & F.col("authoritative_time") & (F.size("codes") == 0))


def response_binding(requests: DataFrame, responses: DataFrame) -> DataFrame:
    """By request_id: why a response is no usable denominator for its request; empty if it is. A request without a response says so.

    requests(request_id, action_family, destination_system, window_start, window_end, parameters, settlement_lag_s), responses(request_id, the same five, echoed_start,
    echoed_end, echoed_parameters, count, n_identifiers, ts_min, ts_max, authoritative_time, result_cap_hit, pagination_complete, observed_lag_ms).
    """
    asked = requests.select("request_id", *(F.col(c).alias(f"q_{c}") for c in (*FAMILY, "window_start", "window_end", "parameters", "settlement_lag_s")))
    got = asked.join(responses.withColumn("answered", F.lit(True)), "request_id", "left")
    differs = lambda a, b: ~F.col(a).eqNullSafe(F.col(b))
    empty = F.col("count") == 0
    outside = F.col("ts_min").isNull() | F.col("ts_max").isNull() | (F.col("ts_min") < F.col("q_window_start")) | (F.col("ts_max") >= F.col("q_window_end")) | (F.col("ts_min") > F.col("ts_max"))
    codes = F.array_compact(F.array(
        *(F.when(differs(c, f"q_{c}"), f"{c}_differs") for c in (*FAMILY, "window_start", "window_end")),
        *(F.when(differs(a, b), f"{a}_differs") for a, b in (("echoed_parameters", "q_parameters"), ("echoed_start", "q_window_start"), ("echoed_end", "q_window_end"))),
        F.when(F.col("n_identifiers").isNotNull() & (F.col("n_identifiers") != F.col("count")), "count_differs"),
        F.when(empty & (F.col("ts_min").isNotNull() | F.col("ts_max").isNotNull()), "range_of_empty_population"), F.when(empty & F.col("authoritative_time").isNotNull(), "time_of_empty_population"),
        F.when(~empty & outside, "range_outside_window"), F.when(~empty & ~outside & differs("authoritative_time", "ts_max"), "time_is_not_the_newest_record"),
        F.when(F.col("result_cap_hit"), "result_cap_hit"), F.when(~F.col("pagination_complete"), "pagination_incomplete"),
        F.when(F.col("observed_lag_ms").isNotNull() & F.col("q_settlement_lag_s").isNull(), "lag_without_bound"), F.when(F.col("observed_lag_ms") > F.col("q_settlement_lag_s") * 1000, "settlement_lag_exceeded"),
    ))
    return got.select("request_id", F.when(F.col("answered"), codes).otherwise(F.array(F.lit("unanswered"))).alias("codes"))


def scope_validation(populations: DataFrame, boundaries: DataFrame, qualifications: DataFrame) -> DataFrame:
    """By population: the first way in which it, its boundary and its boundary's qualifications disagree, or null. Qualifications carry the boundary they are declared for."""
    b = boundaries.select("boundary_ref", F.col("window_start").alias("b_start"), F.col("window_end").alias("b_end"), F.lit(True).alias("known"))
    p = populations.join(b, "boundary_ref", "left")
    own = populations.select("population_ref", "boundary_ref", F.col("tenant_id").alias("p_tenant"), *(F.col(c).alias(f"p_{c}") for c in FAMILY))
    facts = own.join(qualifications.select("boundary_ref", "tenant_id", *FAMILY), "boundary_ref").groupBy("population_ref").agg(
        F.bool_or(F.col("tenant_id") != F.col("p_tenant")).alias("tenants"), *(F.bool_or(F.col(c) != F.col(f"p_{c}")).alias(f"{c}s") for c in FAMILY), F.lit(True).alias("qualified")
    )
    reason = (
        F.when(F.col("known").isNull(), "boundary_differs").when((F.col("window_start") != F.col("b_start")) | (F.col("window_end") != F.col("b_end")), "window_differs").when(F.col("qualified").isNull(), "no_qualification")
        .when(F.col("tenants"), "tenant_differs").when(F.col("action_familys"), "action_family_differs").when(F.col("destination_systems"), "destination_differs")
    )
    return p.join(facts, "population_ref", "left").select("population_ref", reason.alias("reason"))


def boundary_binding(bundles: DataFrame, boundaries: DataFrame, qualifications: DataFrame) -> DataFrame:
    """(bundle_id, code, detail): the boundary a bundle carries is not the one its attestation names, or it carries a qualification that the boundary does not declare.
    A bundle without its boundary is ``boundary_unchecked``, which is no fault.

    bundles(bundle_id, claimed_boundary_ref), boundaries(bundle_id, record_id, boundary_ref, qualification_refs), qualifications(bundle_id, record_id).
    """
    x = bundles.select("bundle_id", "claimed_boundary_ref").join(boundaries.select("bundle_id", "record_id", "boundary_ref", "qualification_refs"), "bundle_id", "left")
    named = (F.col("claimed_boundary_ref") == F.col("record_id")) | (F.col("claimed_boundary_ref") == F.col("boundary_ref"))
    own = x.select("bundle_id", F.when(F.col("record_id").isNull(), "boundary_unchecked").when(~named, "boundary_mismatch").alias("code"), F.col("claimed_boundary_ref").alias("detail")).where("code is not null")
    declared = x.where(named).select("bundle_id", F.explode("qualification_refs").alias("record_id"))
    undeclared = qualifications.join(x.where(named & F.col("qualification_refs").isNotNull()).select("bundle_id"), "bundle_id", "left_semi").join(declared, ["bundle_id", "record_id"], "left_anti")
    return own.unionByName(undeclared.select("bundle_id", F.lit("qualification_undeclared").alias("code"), F.col("record_id").alias("detail")))


def bundle_class_check(claims: DataFrame, references: DataFrame, history: DataFrame) -> DataFrame:
    """By bundle, from the qualifications that it discloses alone: ``unchecked`` if one referenced is missing or there is none, ``postdates_window`` or ``class_unsupported`` if a family's
    weakest class in force is below the claim, else ``supported``. Class names sort from strong to weak.

    claims(bundle_id, claimed_class, window_start, window_end), references(bundle_id, qualification_ref), history(bundle_id, qualification_ref, action_family, destination_system,
    assigned_class, qualified_at).
    """
    seen = references.join(history, ["bundle_id", "qualification_ref"], "left").groupBy("bundle_id").agg(F.count(F.lit(1)).alias("n"), F.count("assigned_class").alias("held"))
    x = claims.join(references.join(history, ["bundle_id", "qualification_ref"]), "bundle_id")
    before, at = F.col("qualified_at") < F.col("window_start"), F.struct("qualified_at", "qualification_ref")
    scope = x.groupBy("bundle_id", "claimed_class", *FAMILY).agg(
        F.max_by("assigned_class", F.when(before, at)).alias("governing"), F.max(F.when(~before & (F.col("qualified_at") < F.col("window_end")), F.col("assigned_class"))).alias("within"),
        F.coalesce(F.bool_or(~before & (F.col("assigned_class") <= F.col("claimed_class"))), F.lit(False)).alias("later"),
    )
    short = F.col("claimed_class") < F.greatest("governing", "within")
    verdict = F.when(F.col("governing").isNull() | (short & F.col("later")), "postdates_window").when(short, "class_unsupported").otherwise("supported")
    # the first scope in order speaks for the bundle, as long as it has a fault
    worst = scope.withColumn("verdict", verdict).groupBy("bundle_id").agg(F.min_by("verdict", F.struct(F.col("verdict") == "supported", *FAMILY)).alias("verdict"))
    return claims.join(seen, "bundle_id", "left").join(worst, "bundle_id", "left").select("bundle_id", F.when(F.coalesce("held", F.lit(0)) < F.coalesce("n", F.lit(1)), "unchecked").otherwise(F.col("verdict")).alias("verdict"))
