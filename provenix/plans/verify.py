"""Verification of issued attestations: rechecks as findings, one verdict for each bundle, checks that can be added.

A check is a function from a bundle table to findings (bundle_id, ord, code). The first code by ``ord`` decides; all are kept.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provenix.operators.coverage import four_places
from provenix.operators.qualify import admissible_level, emits_ratio, level_rank
from provenix.operators.reconcile import STATUSES

Check = Callable[[DataFrame], DataFrame]
_checks: dict[str, Check] = {}
# The assertion catalogue.
ASSERTIONS = tuple(f"A-{i:02d}" for i in range(1, 11))


def register_check(name: str, check: Check) -> None:
    _checks[name] = check


def registered_checks() -> dict[str, Check]:
    return dict(_checks)


def _finding(bundles: DataFrame, order: int, code: str, bad: F.Column) -> DataFrame:
    return bundles.where(bad).select("bundle_id", F.lit(order).alias("ord"), F.lit(code).alias("code"))


def counts_recheck(b: DataFrame) -> DataFrame:
    total = reduce(lambda x, y: x + y, (F.col(s) for s in STATUSES))
    low = reduce(lambda x, y: x | y, (F.col(s) < 0 for s in STATUSES))
    return _finding(b, 30, "counts_negative", low).unionByName(_finding(b, 31, "counts_do_not_sum", total != F.col("signed_count")))


def ratio_recheck(b: DataFrame) -> DataFrame:
    """The stated ratio against matched over the population less what is out of scope. Where bundles tell whether a population of theirs was cut off (truncated), a ratio that is withheld without
    such a reason is a finding too, and so is one that is stated in spite of it."""
    own = four_places(F.col("matched"), F.col("signed_count") - F.col("out_of_scope"))
    told = "truncated" in b.columns
    cut = F.coalesce("truncated", F.lit(False)) if told else F.lit(False)
    due = F.lit(told) & emits_ratio(F.col("claimed_class")) & (F.col("signed_count") - F.col("out_of_scope") > 0) & ~cut
    shown = F.col("coverage_ratio").isNotNull()
    bad_form = shown & ~F.col("coverage_ratio").rlike(r"^[01]\.\d{4}$")
    return (
        _finding(b, 40, "ratio_withheld_class_states_ratio", shown & ~emits_ratio(F.col("claimed_class"))).unionByName(_finding(b, 41, "ratio_malformed", bad_form))
        .unionByName(_finding(b, 42, "ratio_mismatch", shown & ~bad_form & ~F.col("coverage_ratio").eqNullSafe(own)))
        .unionByName(_finding(b, 43, "ratio_withheld", ~shown & F.coalesce(due, F.lit(False)))).unionByName(_finding(b, 44, "ratio_of_truncated_population", shown & cut))
    )


def lattice_recheck(b: DataFrame) -> DataFrame:
    ceiling, level = level_rank(admissible_level(F.col("claimed_class"))), level_rank(F.col("claimed_level"))
    return _finding(b, 50, "level_above_ceiling", level > ceiling).unionByName(_finding(b, 51, "capped_below_ceiling", (level < ceiling) & F.col("capped_by_class")))


def validity_recheck(b: DataFrame) -> DataFrame:
    now = F.col("as_of")
    return (
        _finding(b, 70, "validity_empty", F.col("validity_until") <= F.col("validity_from")).unionByName(_finding(b, 71, "not_yet_valid", now < F.col("validity_from")))
        .unionByName(_finding(b, 72, "expired", now >= F.col("validity_until")))
    )


def gap_omission(announced: DataFrame, signed: DataFrame) -> DataFrame:
    """Signed gaps (bundle_id, gap_start, gap_end, cause, affected_scope where there is one) that the attestation does not announce. Scopes are JSON texts, compared by what they say: the order of members and
    white space do not count, the order of a list does. A scope that is no JSON equals only the same text."""
    keys = ["bundle_id", "gap_start", "gap_end", "cause"]
    if "affected_scope" in signed.columns:
        said = F.coalesce(F.to_json(F.try_parse_json("affected_scope")), F.concat(F.lit("text:"), F.col("affected_scope")), F.lit("absent"))
        announced, signed, keys = announced.withColumn("_scope", said), signed.withColumn("_scope", said), [*keys, "_scope"]
    return signed.join(announced, keys, "left_anti").select("bundle_id", F.lit(60).alias("ord"), F.lit("gap_omitted").alias("code"))


def assertion_check(assertions: DataFrame) -> DataFrame:
    return assertions.where(~F.col("assertion_id").isin(*ASSERTIONS)).select("bundle_id", F.lit(45).alias("ord"), F.lit("assertion_unknown").alias("code"))


def population_refs(refs: DataFrame, populations: DataFrame) -> DataFrame:
    """refs(bundle_id, tenant_id, boundary_ref, population_ref, stated_count): missing, repeated, other scope, counts that do not add up."""
    known = populations.select("population_ref", F.col("tenant_id").alias("p_tenant"), F.col("boundary_ref").alias("p_boundary"), F.col("signed_count"))
    got = refs.join(known, "population_ref", "left")
    each = got.where("p_tenant is null").select("bundle_id", F.lit(20).alias("ord"), F.lit("population_missing").alias("code"))
    twice = refs.groupBy("bundle_id", "population_ref").count().where("count > 1").select("bundle_id", F.lit(21).alias("ord"), F.lit("population_repeated").alias("code"))
    scope = got.where("p_tenant <> tenant_id or p_boundary <> boundary_ref").select("bundle_id", F.lit(22).alias("ord"), F.lit("population_scope").alias("code"))
    total = got.groupBy("bundle_id").agg(F.sum("signed_count").alias("s"), F.max("stated_count").alias("t")).where("s <> t").select("bundle_id", F.lit(23).alias("ord"), F.lit("population_count").alias("code"))
    return each.unionByName(twice).unionByName(scope).unionByName(total)


def revocation_state(responses: DataFrame, as_of: str) -> DataFrame:
    """responses(attestation_id, http_status, subject, state, effective_at, sig_ok) -> what each proves: valid, pending, revoked, superseded, unchecked."""
    ours = F.col("sig_ok") & (F.col("subject") == F.col("attestation_id"))
    now = F.lit(as_of).cast("timestamp")
    state = (
        F.when(F.col("http_status") == 404, "valid").when((F.col("http_status") != 200) | ~F.coalesce(ours, F.lit(False)), "unchecked")
        .when(F.col("effective_at") > now, "pending").when(F.col("state").isin("revoked", "superseded"), F.col("state")).otherwise("unchecked")
    )
    return responses.select("attestation_id", state.alias("revocation"))


def verdicts(bundles: DataFrame, *findings: DataFrame) -> DataFrame:
    """One row for each bundle: verdict, first code, number of findings, all codes sorted. Registered checks are run too."""
    own = [counts_recheck(bundles), ratio_recheck(bundles), lattice_recheck(bundles), validity_recheck(bundles), *(c(bundles) for c in _checks.values()), *findings]
    every = reduce(lambda a, b: a.unionByName(b), own)
    first = every.groupBy("bundle_id").agg(F.min_by("code", F.struct("ord", "code")).alias("code"), F.count(F.lit(1)).alias("n_findings"), F.array_join(F.array_sort(F.collect_set("code")), ",").alias("codes"))
    verdict = F.when(F.col("code").isNull(), "verified").when(F.col("code").isin("expired", "not_yet_valid"), F.col("code")).otherwise("refused")
    return bundles.select("bundle_id").join(first, "bundle_id", "left").select("bundle_id", verdict.alias("verdict"), "code", F.coalesce("n_findings", F.lit(0)).alias("n_findings"), F.coalesce("codes", F.lit("")).alias("codes"))


def export(records: DataFrame) -> DataFrame:
    """records(bundle_id, wire) -> (bundle_id, document): a JSON array of whole records in ascending byte order."""
    sorted_ = F.array_sort(F.collect_list(F.col("wire").cast("binary")))
    return records.groupBy("bundle_id").agg(F.concat(F.lit("["), F.array_join(F.transform(sorted_, lambda b: b.cast("string")), ","), F.lit("]")).alias("document"))


def read_audit(items: DataFrame) -> DataFrame:
    """items(bundle_id, pos, wire, record_type): order ascending, exactly one attestation, at most one boundary."""
    from pyspark.sql import Window

    w = Window.partitionBy("bundle_id").orderBy("pos")
    got = items.withColumn("_ok", F.coalesce(F.lag(F.col("wire").cast("binary")).over(w) < F.col("wire").cast("binary"), F.lit(True)))
    return got.groupBy("bundle_id").agg(F.bool_and("_ok").alias("in_order"), F.count_if(F.col("record_type") == "AttestationWindow").alias("n_attestations"), F.count_if(F.col("record_type") == "AssuranceBoundary").alias("n_boundaries")).withColumn(
        "well_formed", F.expr("in_order and n_attestations = 1 and n_boundaries <= 1")
    )
