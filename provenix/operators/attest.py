"""Boundaries, oversight, assertions, lifecycle and retention of attestations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BOUNDARY = ["tenant_id", "name"]
SCOPE = ["tenant_id", "boundary_ref"]
# What an attestation never claims.
STANDING_EXCLUSIONS = ("intent", "business_appropriateness", "model_correctness", "completeness_outside_boundary", "legal_compliance", "future_behaviour")


def boundary_history(boundaries: DataFrame, families: DataFrame) -> DataFrame:
    """Versions in order with their sorted families and what supersedes each."""
    named = families.groupBy("boundary_ref").agg(F.array_join(F.array_sort(F.collect_set("action_family")), ",").alias("families"), F.count(F.lit(1)).alias("n_families"))
    w = Window.partitionBy(*BOUNDARY).orderBy("version", "boundary_ref")
    return boundaries.join(named, "boundary_ref", "left").withColumn("superseded_by", F.lead("boundary_ref").over(w))


def effective(boundaries: DataFrame) -> DataFrame:
    """When each version applied: from its recording (if attested) to its successor's, inside its window; may be empty."""
    w = Window.partitionBy(*BOUNDARY).orderBy("version", "boundary_ref")
    start = F.greatest("window_start", "recorded_at")
    end = F.least("window_end", F.lead(F.greatest("window_start", "recorded_at")).over(w))
    ok = F.col("recording_time_attested") & F.coalesce(F.lead("recording_time_attested").over(w), F.lit(True))
    return boundaries.withColumn("effective_start", F.when(ok, start)).withColumn("effective_end", F.when(ok, end)).withColumn("empty", F.when(ok, F.col("effective_end") <= F.col("effective_start")))


def uncovered(effective_: DataFrame) -> DataFrame:
    """Parts of each version's window in which it did not apply: head and tail, or the whole."""
    whole = F.col("effective_start").isNull() | F.col("empty")
    head = F.when(~whole & (F.col("effective_start") > F.col("window_start")), F.struct(F.lit("head").alias("part"), F.col("window_start").alias("s"), F.col("effective_start").alias("e")))
    tail = F.when(~whole & (F.col("effective_end") < F.col("window_end")), F.struct(F.lit("tail").alias("part"), F.col("effective_end").alias("s"), F.col("window_end").alias("e")))
    all_ = F.when(whole, F.struct(F.lit("whole").alias("part"), F.col("window_start").alias("s"), F.col("window_end").alias("e")))
    return effective_.select("tenant_id", "boundary_ref", F.explode(F.array_compact(F.array(head, tail, all_))).alias("u")).select("tenant_id", "boundary_ref", "u.part", F.col("u.s").alias("uncovered_start"), F.col("u.e").alias("uncovered_end"))


def scope_changes(boundaries: DataFrame, families: DataFrame) -> DataFrame:
    """Families that each version adds to and drops from its predecessor."""
    sets = boundaries.join(families.groupBy("boundary_ref").agg(F.collect_set("action_family").alias("own")), "boundary_ref", "left").withColumn("own", F.coalesce("own", F.array().cast("array<string>")))
    w = Window.partitionBy(*BOUNDARY).orderBy("version", "boundary_ref")
    got = sets.withColumn("before", F.lag("own").over(w)).where("before is not null")
    text = lambda a, b: F.array_join(F.array_sort(F.array_except(a, b)), ",")
    return got.select("tenant_id", "boundary_ref", text("own", "before").alias("added"), text("before", "own").alias("dropped"))


def undeclared(actions: DataFrame, families: DataFrame) -> DataFrame:
    """Action families used in a boundary that never declared them, with how often."""
    used = actions.groupBy("tenant_id", "boundary_ref", "action_family").agg(F.count(F.lit(1)).alias("n_actions"))
    return used.join(families.select("tenant_id", "boundary_ref", "action_family").distinct(), ["tenant_id", "boundary_ref", "action_family"], "left_anti")


def evaluate_reviews(reviews: DataFrame) -> DataFrame:
    p = F.col("evidence_shown_provenance")
    reason = (
        F.when(F.col("action_state_at_review") == "committed", "review_after_commitment").when(F.col("action_state_at_review") == "irreversible", "review_after_irreversibility")
        .when(p == "server_reconstructed", "server_reconstructed_evidence").when(p.isNotNull() & (p != "client_rendered"), "unverified_evidence_provenance").otherwise("effective")
    )
    return reviews.withColumn("reason", reason)


def oversight(required: DataFrame, reviews: DataFrame) -> DataFrame:
    """required(tenant, boundary, window_ref, action_id, window_start, window_end): by window, how many actions needed a review,
    had one in time, had an effective one, had none. Counts are of actions, so repeated reviews change nothing."""
    own = required.join(evaluate_reviews(reviews), ["action_id", *SCOPE], "left")  # what tells most rows apart comes first: sorts are decided by it
    inside = (F.col("decided_at") >= F.col("window_start")) & (F.col("decided_at") < F.col("window_end"))
    each = own.groupBy("action_id", *SCOPE, "window_ref").agg(F.coalesce(F.bool_or(inside), F.lit(False)).alias("reviewed"), F.coalesce(F.bool_or(inside & (F.col("reason") == "effective")), F.lit(False)).alias("effective"), F.coalesce(F.bool_or(F.col("decided_at").isNotNull() & ~inside), F.lit(False)).alias("outside"))
    return each.groupBy(*SCOPE, "window_ref").agg(
        F.count(F.lit(1)).alias("n_required"), F.count_if("reviewed").alias("n_reviewed"), F.count_if("effective").alias("n_effective"), F.count_if(~F.col("reviewed")).alias("n_missing"), F.count_if("outside").alias("n_outside")
    )


def review_guards(required: DataFrame, reviews: DataFrame) -> DataFrame:
    """Input errors: an empty or repeated required action, a review id used twice."""
    a = required.groupBy(*SCOPE, "window_ref", "action_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 or action_id = '' or action_id is null").select(*SCOPE, F.col("action_id").alias("subject"), F.lit("required_action_repeated").alias("code"), "n")
    b = reviews.groupBy(*SCOPE, "record_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(*SCOPE, F.col("record_id").alias("subject"), F.lit("review_id_repeated").alias("code"), "n")
    return a.unionByName(b)


def confirmed_outcomes(actions: DataFrame, outcomes: DataFrame, source: str) -> DataFrame:
    """Distinct actions with an undisputed outcome from exactly the named source."""
    good = outcomes.where((F.col("authoritative_source") == source) & ~F.col("disputed"))
    return actions.select("action_id", *SCOPE).distinct().join(good, ["action_id", *SCOPE], "left_semi")


def assertions(report: DataFrame, oversight_: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Long form (population_ref, assertion_id, n): which catalogued assertions each population's report supports."""
    base = report.select("tenant_id", "population_ref", "claimed_level", "ratio_state", "numerator", "signed_count", "out_of_scope", "independently_enumerable", "actions_in_gaps")
    pick = lambda d, cond, code, n: d.where(cond).select("tenant_id", "population_ref", F.lit(code).alias("assertion_id"), F.col(n).cast("long").alias("n"))
    seen = oversight_.select("tenant_id", F.col("window_ref").alias("population_ref"), "n_reviewed", "n_effective")
    done = outcomes.select("tenant_id", "population_ref", "n_confirmed")
    return (
        pick(base, "numerator > 0", "A-02", "numerator").unionByName(pick(base, "claimed_level in ('enforced', 'reconciled')", "A-03", "numerator"))
        .unionByName(pick(base, "claimed_level = 'reconciled'", "A-04", "numerator")).unionByName(pick(base, "ratio_state = 'available'", "A-05", "signed_count"))
        .unionByName(pick(base, "independently_enumerable", "A-06", "signed_count")).unionByName(pick(seen, "n_reviewed > 0", "A-07", "n_reviewed"))
        .unionByName(pick(seen, "n_effective > 0 and n_effective = n_reviewed", "A-08", "n_effective")).unionByName(pick(done, "n_confirmed > 0", "A-09", "n_confirmed"))
    )


def exclusions(report: DataFrame, oversight_: DataFrame, populations: DataFrame, uncovered_: DataFrame | None = None, asked: DataFrame | None = None, outcomes: DataFrame | None = None) -> DataFrame:
    """What each population's attestation does not claim: the standing list, and what its own evidence leaves open.

    report: a row a population with tenant_id, population_ref and out_of_scope; no other column of a report is read.

    uncovered_(tenant_id, population_ref): parts of windows in which no boundary was in force, each counted. asked(tenant_id, population_ref): populations for which outcomes of a named source were asked for; where
    outcomes(tenant_id, population_ref, n_confirmed) confirms none, the assertion is withheld.
    """
    standing = report.select("tenant_id", "population_ref", F.explode(F.array(*(F.lit(x) for x in STANDING_EXCLUSIONS))).alias("exclusion"), F.lit(0).cast("long").alias("n"))
    seen = oversight_.select("tenant_id", F.col("window_ref").alias("population_ref"), "n_missing", (F.col("n_reviewed") - F.col("n_effective")).alias("n_late"))
    pick = lambda d, cond, name, n: d.where(cond).select("tenant_id", "population_ref", F.lit(name).alias("exclusion"), F.col(n).cast("long").alias("n"))
    cut = populations.where("result_cap_hit or not pagination_complete")
    out = (
        standing.unionByName(pick(seen, "n_missing > 0", "human_review_missing", "n_missing")).unionByName(pick(seen, "n_late > 0", "human_review_ineffective", "n_late"))
        .unionByName(pick(report, "out_of_scope > 0", "outside_boundary", "out_of_scope")).unionByName(pick(cut, "true", "truncated_population", "signed_count"))
    )
    if uncovered_ is not None:
        parts = uncovered_.groupBy("tenant_id", "population_ref").agg(F.count(F.lit(1)).alias("n"))
        out = out.unionByName(pick(parts, "true", "boundary_not_in_force_for_full_window", "n"))
    if asked is not None:
        none = asked.select("tenant_id", "population_ref").distinct().join(outcomes.where("n_confirmed > 0"), ["tenant_id", "population_ref"], "left_anti").withColumn("n", F.lit(0))
        out = out.unionByName(pick(none, "true", "outcome_assertion_withheld", "n"))
    return out


def lifecycle(attested: DataFrame, revocations: DataFrame, as_of: str) -> DataFrame:
    """Status of every attestation at ``as_of``: superseded, revoked, not_yet_valid, expired, valid; in this order. A transition counts from
    the instant it takes effect; the latest one decides what supersedes."""
    now = F.lit(as_of).cast("timestamp")
    live = revocations.where(F.col("effective_at") <= now).groupBy("tenant_id", "attestation_id").agg(
        F.max_by("superseding_attestation_id", F.struct("effective_at", "sequence")).alias("superseding"), F.count(F.lit(1)).alias("n_transitions")
    )
    status = (
        F.when(F.col("superseding").isNotNull(), "superseded").when(F.col("n_transitions") > 0, "revoked").when(now < F.col("validity_from"), "not_yet_valid")
        .when(now >= F.col("validity_until"), "expired").otherwise("valid")
    )
    return attested.join(live, ["tenant_id", "attestation_id"], "left").select("tenant_id", "attestation_id", status.alias("status"), "superseding")


def transition_audit(attested: DataFrame, revocations: DataFrame) -> DataFrame:
    """Reasons why a transition is not valid: unknown subject, itself, more than one, a successor without late evidence or the reverse."""
    n = revocations.groupBy("tenant_id", "attestation_id").agg(F.count(F.lit(1)).alias("n_transitions"))
    scope = ["tenant_id", "boundary_ref", "window_start", "window_end"]
    own = attested.select("attestation_id", *(F.col(c).alias(f"_{c}") for c in scope), F.lit(True).alias("known"))
    next_ = attested.select(F.col("attestation_id").alias("superseding_attestation_id"), *(F.col(c).alias(f"next_{c}") for c in scope), F.lit(True).alias("next_known"))
    got = revocations.join(own.withColumnRenamed("_tenant_id", "tenant_id"), ["tenant_id", "attestation_id"], "left").join(n, ["tenant_id", "attestation_id"]).join(next_, "superseding_attestation_id", "left")
    succeeds, differs = F.coalesce("next_known", F.lit(False)), lambda a, b: ~F.col(a).eqNullSafe(F.col(b))
    codes = F.array_compact(F.array(
        F.when(F.col("known").isNull(), "unknown_attestation"), F.when(F.col("superseding_attestation_id") == F.col("attestation_id"), "supersedes_itself"), F.when(F.col("n_transitions") > 1, "more_than_one_transition"),
        F.when(F.col("superseding_attestation_id").isNotNull() != (F.col("reason") == "late_evidence"), "supersession_without_late_evidence"),
        F.when(succeeds & differs("next_tenant_id", "tenant_id"), "successor_of_other_tenant"), F.when(succeeds & differs("next_boundary_ref", "_boundary_ref"), "successor_of_other_boundary"),
        F.when(succeeds & (differs("next_window_start", "_window_start") | differs("next_window_end", "_window_end")), "successor_of_other_window"),
    ))
    return got.select("tenant_id", "revocation_id", F.array_join(codes, ",").alias("codes")).where("codes <> ''")


def latest_notification(log: DataFrame) -> DataFrame:
    return log.groupBy("tenant_id", "notification_id").agg(F.max_by("status", "sequence").alias("status"), F.max("sequence").alias("sequence"))


def protected(evidence: DataFrame, attested: DataFrame, revocations: DataFrame, as_of: str, hold_months: int = 0) -> DataFrame:
    """Evidence that a live, unrevoked attestation still covers: inside its window, until validity ends (plus a dispute period)."""
    now = F.lit(as_of).cast("timestamp")
    dead = revocations.where(F.col("effective_at") <= now).select("tenant_id", "attestation_id").distinct()
    live = attested.where(F.col("validity_until") + F.make_ym_interval(F.lit(0), F.lit(hold_months)) > now).join(dead, ["tenant_id", "attestation_id"], "left_anti")
    spans = live.select("tenant_id", "boundary_ref", F.col("window_start").alias("_s"), F.col("window_end").alias("_e")).withColumn("_m", F.explode(F.sequence(F.date_trunc("month", "_s"), F.col("_e"), F.expr("interval 1 month"))))
    e, s = evidence.withColumn("_m", F.date_trunc("month", "authoritative_time")).alias("e"), spans.alias("s")
    on = (F.col("e.tenant_id") == F.col("s.tenant_id")) & (F.col("e.boundary_ref") == F.col("s.boundary_ref")) & (F.col("e._m") == F.col("s._m")) & (F.col("e.authoritative_time") >= F.col("s._s")) & (F.col("e.authoritative_time") < F.col("s._e"))
    return e.join(s, on, "left_semi").drop("_m")


def deletable(evidence: DataFrame, attested: DataFrame, revocations: DataFrame, as_of: str, hold_months: int = 12) -> DataFrame:
    kept = protected(evidence, attested, revocations, as_of, hold_months).select("tenant_id", "destination_record_id")
    return evidence.join(kept, ["tenant_id", "destination_record_id"], "left_anti")


def late_evidence(evidence: DataFrame, attested: DataFrame) -> DataFrame:
    """By attestation: how much evidence of its window arrived after it was issued, and since when."""
    late = evidence.join(attested.select("tenant_id", "boundary_ref", "attestation_id", "population_ref", "window_start", "window_end", "issued_at"), ["tenant_id", "boundary_ref", "population_ref"])
    return late.where("authoritative_time >= window_start and authoritative_time < window_end and ingest_time > issued_at").groupBy("tenant_id", "attestation_id").agg(F.count(F.lit(1)).alias("n_late"), F.min("ingest_time").alias("first_late"))


def rows(records: DataFrame, wire: str = "wire") -> DataFrame:
    """Attestation rows as they are stored, projected from signed attestation windows. The class is in lower case; a ratio that is withheld is null; the ratio is an exact decimal."""
    x = lambda path: F.get_json_object(wire, f"$.{path}")
    plain = {k: x(k) for k in ("tenant_id", "boundary_ref", "stream_id")} | {k: x(f"body.{k}") for k in ("methodology_version", "coverage_level", "verification_status", "counts", "assertions", "exclusions", "relying_parties", "purpose", "liability_ref")}
    times = {k: x(f"body.{k}").try_cast("timestamp") for k in ("window_start", "window_end", "validity_from", "validity_until", "issued_at")}
    return records.select(
        x("record_id").alias("attestation_id"), x("sequence").try_cast("long").alias("sequence"), F.lower(x("body.denominator_class")).alias("denominator_class"), x("body.coverage_ratio").try_cast("decimal(5,4)").alias("coverage_ratio"),
        (x("body.capped_by_class") == "true").alias("capped_by_class"), F.from_json(x("body.population_record_refs"), "array<string>").alias("population_record_refs"), x("signature.customer.key_id").alias("evidence_key_id"),
        x("signature.customer.issuer.key_id").alias("issuer_key_id"), *(c.alias(k) for k, c in (plain | times).items()), F.col(wire).alias("wire"), F.lit(None).cast("string").alias("bundle_digest"),
    )
