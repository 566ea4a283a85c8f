"""Record validation and projection: every check is a Column, every report an array of codes in a fixed order."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provenix.sources.shared import stored

# The closed envelope and the fourteen record types with the namespace that may sign each.
ENVELOPE = ("record_id", "record_type", "schema_version", "tenant_id", "boundary_ref", "stream_id", "sequence", "prev_digest", "source", "clocks", "body", "signature")
SIGNERS = {
    "AssuranceBoundary": "evidence", "QualificationRecord": "evidence", "PopulationRecord": "issuer", "AgentIdentity": "evidence", "ActionProposal": "evidence", "AuthorityDecision": "evidence", "HumanReview": "evidence",
    "ExecutionReceipt": "evidence", "ExternalConfirmation": "issuer", "FinalityRecord": "evidence", "OutcomeRecord": "evidence", "CoverageGap": "evidence", "AttestationWindow": "evidence", "RevocationRecord": "issuer",
}
# The members of each type's body by kind. s string, t instant, d digest, n whole number from 0, p from 1, b boolean, o object, l list, j any
# value; "?" may be null; words are the values allowed.
BODIES = {
    "AssuranceBoundary": "boundary_version:s tenant:s deployment:s agent_identities:l action_families:l destination_systems:l enforcement_points:l policy_refs:l window_start:t window_end:t collection_modes:l fail_behaviour:o qualification_refs:l",
    "QualificationRecord": "action_family:s destination_system:s enumeration:o identity_isolation:o confirmation:o temporal:o retention_period:s mutability:o assigned_class:C1|C2|C3|C4|C5 class_evidence:j trial:o qualified_at:t revalidation_cadence:s",
    "PopulationRecord": "action_family:s destination_system:s window_start:t window_end:t enumeration_query:o count:n pagination_complete:b result_cap_hit:b retrieved_at:t authoritative_timestamps:o",
    "AgentIdentity": "agent_id:s deployment:s runtime:s tenant_scope:s service_identity:s model_versions:l tool_versions:l credential_ref:s",
    "ActionProposal": "action_family:s action_id:s tool:s parameters_digest:d purpose:s target_ref:s risk_class:s proposed_at:t",
    "AuthorityDecision": "action_id:s decision:grant|deny|review_required policy_ref:s policy_version:s constraints:l decided_by:s decided_at:t",
    "HumanReview": "action_id:s reviewer_identity:s reviewer_authority:o surface:o evidence_shown:d evidence_shown_refs:l options_offered:l time_available_ms:n time_taken_ms:n decision:s modifications:j action_state_at_review:proposed|dispatched|accepted|committed|reversible|irreversible decided_at:t",
    "ExecutionReceipt": "action_id:s dispatch_attempt:p connector_identity:s connector_version:s destination_response_digest:d destination_record_ref:s status:s dispatched_at:t responded_at:t",
    "ExternalConfirmation": "action_id:s destination_system:s destination_record_id:s destination_record_digest:d authoritative_timestamp:t reconciliation_status:matched|unmatched_with_evidence|unmatched_without_evidence|duplicate|ambiguous|out_of_scope retrieved_at:t",
    "FinalityRecord": "action_id:s state:s reversible_until:t? compensation_ref:s? settled_at:t",
    "OutcomeRecord": "action_id:s outcome_contract_ref:s authoritative_source:s result:j finalised_at:t disputed:b reversal_ref:s?",
    "CoverageGap": "gap_start:t gap_end:t affected_scope:o cause:collector_unreachable|fail_open|sequence_break|denominator_unavailable|clock_skew|key_discontinuity detection_source:s exposure:known|estimated_bounds|unknown actions_during_gap:n?",
    "AttestationWindow": "boundary_ref:s window_start:t window_end:t methodology_version:s denominator_class:C1|C2|C3|C4|C5 population_record_refs:l coverage_level:s verification_status:self_computed|independently_reproduced coverage_ratio:s? counts:o gaps:l assertions:l exclusions:l relying_parties:l validity_from:t validity_until:t liability_ref:s issued_at:t issuer:j verifier_version:s",
    "RevocationRecord": "attestation_ref:s reason:s issuer:j effective_at:t superseding_ref:s? relying_party_notification_status:s",
}
UUID7 = r"^[0-9a-f]{8}-[0-9a-f]{4}-7[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$"
DIGEST = r"^sha256:[0-9a-f]{64}$"
SEMVER = r"^(?:0|[1-9]\d*)\.(?:0|[1-9]\d*)\.(?:0|[1-9]\d*)(?:-[0-9A-Za-z-]+(?:\.[0-9A-Za-z-]+)*)?(?:\+[0-9A-Za-z-]+(?:\.[0-9A-Za-z-]+)*)?$"
INSTANT = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}\.\d{3,9}(Z|[+-]\d{2}:\d{2})$"
SAFE = (1 << 53) - 1


def _get(wire: Column, path: str) -> Column:
    return F.get_json_object(wire, f"$.{path}")


def members_of(kind: str) -> list[tuple[str, str, bool, list[str]]]:
    """(name, kind, whether null is allowed, allowed values) of a type's body members."""
    out = []
    for x in BODIES[kind].split():
        name, k = x.split(":")
        words = k.split("|") if len(k.rstrip("?")) > 1 else []
        out.append((name, "e" if words else k[0], k.endswith("?"), words))
    return out


def _body_members() -> Column:
    """record type -> its members, as a literal map."""
    one = lambda m: F.struct(F.lit(m[0]).alias("name"), F.lit(m[1]).alias("kind"), F.lit(m[2]).alias("nullable"), F.array(*(F.lit(w) for w in m[3])).cast("array<string>").alias("words"))
    return F.create_map(*(c for k in BODIES for c in (F.lit(k), F.array(*(one(m) for m in members_of(k))))))


def is_instant(text: Column) -> Column:
    """Whether a text is an RFC 3339 instant of three fraction digits or more that a calendar and a clock have; a sixtieth second is allowed. Null for null."""
    zone = F.right(text, F.lit(6))
    return (
        text.rlike(INSTANT) & F.substring(text, 1, 10).try_cast("date").isNotNull() & (F.substring(text, 1, 4) != "0000") & (F.substring(text, 12, 2) <= "23") & (F.substring(text, 15, 2) <= "59") & (F.substring(text, 18, 2) <= "60")
        & (text.endswith("Z") | ((F.substring(zone, 2, 2) <= "23") & (F.substring(zone, 5, 2) <= "59")))
    )


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), where the value is computed once a row however often it is used."""
    return F.transform(F.array(value), use)[0]


def _fits(value: Column, kind: Column, words: Column) -> Column:
    """Whether a body value is of its kind."""
    is_, text = F.schema_of_variant(value), F.try_variant_get(value, "$", "string")
    number = F.try_variant_get(value, "$", "bigint")
    ok = (
        F.when(kind == "s", is_ == "STRING").when(kind == "t", (is_ == "STRING") & _let(text, is_instant)).when(kind == "d", (is_ == "STRING") & text.rlike(DIGEST))
        .when(kind == "n", (is_ == "BIGINT") & _let(number, lambda n: (n >= 0) & (n <= SAFE))).when(kind == "p", (is_ == "BIGINT") & _let(number, lambda n: (n >= 1) & (n <= SAFE))).when(kind == "b", is_ == "BOOLEAN")
        .when(kind == "o", is_.startswith("OBJECT")).when(kind == "l", is_.startswith("ARRAY")).when(kind == "e", (is_ == "STRING") & F.array_contains(words, text)).otherwise(is_.isNotNull())
    )
    return F.coalesce(ok, F.lit(False))


def codes(wire: Column) -> Column:
    """Dotted codes of what is wrong with a record's JSON text; empty if nothing is. A member given twice makes the text malformed.

    Every test asks whether a value is right, so that a missing value, a null or a value of another type is wrong. The text is parsed once, and what several tests need is taken from it once.
    """
    return _let(wire, lambda text: _let(F.try_parse_json(text), lambda value: _let(_parts(text, value), lambda r: _codes(text, value, r))))


def _parts(wire: Column, value: Column) -> Column:
    """What several tests need: the members' names, the record's type, its body as a map, and the clocks' names."""
    kind = F.try_variant_get(value, "$.record_type", "variant")
    return F.struct(
        F.when(value.isNotNull(), F.json_object_keys(wire)).alias("names"), F.when(F.schema_of_variant(kind) == "STRING", F.try_variant_get(value, "$.record_type", "string")).alias("kind"),
        F.coalesce(F.try_variant_get(value, "$.body", "map<string,variant>"), F.create_map().cast("map<string,variant>")).alias("body"),
        F.coalesce(F.json_object_keys(_get(wire, "clocks")), F.array().cast("array<string>")).alias("clocks"),
    )


def _codes(wire: Column, value: Column, parts: Column) -> Column:
    names, kind, body, clocks = (parts[k] for k in ("names", "kind", "body", "clocks"))
    at = lambda path: F.try_variant_get(value, f"$.{path}", "variant")
    is_ = lambda path: F.coalesce(F.schema_of_variant(at(path)), F.lit(""))
    text = lambda path: F.try_variant_get(value, f"$.{path}", "string")
    right = lambda path, pattern: (is_(path) == "STRING") & F.coalesce(text(path).rlike(pattern), F.lit(False))
    known = F.coalesce(kind.isin(*SIGNERS), F.lit(False))
    members = F.when(known, F.element_at(_body_members(), kind))
    missing = F.exists(members, lambda m: ~F.map_contains_key(body, m["name"]))
    void = lambda x: F.coalesce(F.schema_of_variant(x) == "VOID", F.lit(False))
    wrong = F.exists(members, lambda m: F.map_contains_key(body, m["name"]) & _let(F.try_element_at(body, m["name"]), lambda x: ~(_fits(x, m["kind"], m["words"]) | (m["nullable"] & void(x)))))
    sequence = F.try_variant_get(value, "$.sequence", "bigint")
    hosted = F.array(F.lit("ingest_time"), F.lit("clock_skew_ms"))
    both = F.map_contains_key(body, F.lit("record_identifiers")) == F.map_contains_key(body, F.lit("identifier_digest"))
    outside_strings = F.regexp_replace(wire, r'"(?:[^"\\]++|\\.)*+"', '""')
    sound = F.coalesce(names.isNotNull(), F.lit(False))
    return F.array_compact(F.array(
        F.when(~sound, "record.json.malformed"),
        F.when(F.size(F.array_except(names, F.array(*(F.lit(x) for x in ENVELOPE)))) > 0, "record.envelope.member_unknown"),
        F.when(F.size(F.array_except(F.array(*(F.lit(x) for x in ENVELOPE)), names)) > 0, "record.envelope.member_missing"),
        F.when(sound & ~right("record_id", UUID7), "record.id.invalid"),
        F.when(sound & ~known, "record.type.unknown"),
        F.when(sound & ~right("schema_version", SEMVER), "record.schema_version.invalid"),
        F.when(sound & ~F.coalesce((is_("sequence") == "BIGINT") & _let(sequence, lambda n: (n >= 1) & (n <= SAFE)), F.lit(False)), "record.sequence.range"),
        F.when(sound & ~((is_("prev_digest") == "VOID") | right("prev_digest", DIGEST)), "record.prev_digest.invalid"),
        F.when(sound & ~((is_("clocks.source_time") == "STRING") & F.coalesce(_let(text("clocks.source_time"), is_instant), F.lit(False))), "record.clocks.source_time.invalid"),
        F.when(sound & F.array_contains(clocks, "authoritative_time") & ~((is_("clocks.authoritative_time") == "STRING") & F.coalesce(_let(text("clocks.authoritative_time"), is_instant), F.lit(False))), "record.clocks.authoritative_time.invalid"),
        F.when(sound & (F.size(F.array_intersect(clocks, hosted)) > 0), "record.clocks.hosted_member"),
        F.when(sound & (F.size(F.array_except(clocks, F.concat(hosted, F.array(F.lit("source_time"), F.lit("authoritative_time"))))) > 0), "record.clocks.member_unknown"),
        F.when(sound & outside_strings.rlike(r"[0-9](\.[0-9]|[eE])"), "record.number.float"),
        F.when(sound & ~(is_("body").startswith("OBJECT") & is_("source").startswith("OBJECT") & is_("signature").startswith("OBJECT") & (is_("tenant_id") == "STRING") & (is_("stream_id") == "STRING") & is_("boundary_ref").isin("STRING", "")), "record.envelope.member_invalid"),
        F.when(missing, "record.body.member_missing"), F.when(wrong, "record.body.member_invalid"),
        F.when((kind == "PopulationRecord") & both, "record.body.identifiers_exclusive"),
    ))


def report(records: DataFrame, wire: str = "wire") -> DataFrame:
    return records.withColumn("errors", codes(F.col(wire)))


def split(records: DataFrame, wire: str = "wire") -> tuple[DataFrame, DataFrame]:
    """(good, quarantined): one bad record stops no other. The report is stored once, so that neither side judges the texts again."""
    marked = stored(report(records, wire), "judged")
    return marked.where(F.size("errors") == 0).drop("errors"), marked.where(F.size("errors") > 0)


def projection(wire: str = "wire") -> dict[str, Column]:
    """Ledger columns that follow from a record's text."""
    w = F.col(wire)
    return {
        "record_id": _get(w, "record_id"), "record_type": _get(w, "record_type"), "tenant_id": _get(w, "tenant_id"), "stream_id": _get(w, "stream_id"), "sequence": _get(w, "sequence").cast("long"),
        "prev_digest": _get(w, "prev_digest"), "source_time": _get(w, "clocks.source_time").cast("timestamp"), "action_id": _get(w, "body.action_id"), "action_family": _get(w, "body.action_family"),
        "record_digest": F.concat(F.lit("sha256:"), F.sha2(w.cast("binary"), 256)),
    }


def project(records: DataFrame, wire: str = "wire") -> DataFrame:
    return records.select(*(c.alias(k) for k, c in projection(wire).items()))


def drift(stored: DataFrame, wire: str = "wire") -> DataFrame:
    """(record_id, column, stored, derived) of each stored value that its record's text does not give; null equals null."""
    names = [k for k in projection(wire) if k != "record_id"]
    derived = projection(wire)
    cells = F.array(*(F.struct(F.lit(k).alias("column"), F.col(k).cast("string").alias("stored"), derived[k].cast("string").alias("derived")) for k in names))
    return stored.select("record_id", F.explode(cells).alias("c")).select("record_id", "c.column", "c.stored", "c.derived").where(~F.col("stored").eqNullSafe(F.col("derived")))


def rebuild(stored: DataFrame, droppable: tuple[str, ...] = ("action_id", "action_family", "source_time", "record_digest"), wire: str = "wire") -> DataFrame:
    """The table with its derived columns computed again; header columns stay as they are."""
    derived = projection(wire)
    return stored.withColumns({k: derived[k] for k in droppable})


def digest_audit(records: DataFrame, content: str, digest: str) -> DataFrame:
    """Records whose stored digest is not that of their bytes."""
    return records.where(F.concat(F.lit("sha256:"), F.sha2(F.col(content).cast("binary"), 256)) != F.col(digest))


def repeated(records: DataFrame, keys: list[str]) -> DataFrame:
    return records.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def signer_namespace(records: DataFrame, keys: DataFrame) -> DataFrame:
    """Records signed from the wrong namespace, or by a key nobody registered. An attestation window is signed by its evidence key and countersigned by an issuer's (counter_key_id)."""
    wanted = F.create_map(*(F.lit(x) for kv in SIGNERS.items() for x in kv))
    known = keys.groupBy("tenant_id", "key_id").agg(F.min("namespace").alias("namespace"))
    got = records.join(known, ["tenant_id", "key_id"], "left").withColumn("expected", F.element_at(wanted, F.col("record_type")))
    reason = F.when(F.col("expected").isNull(), "record_type_unknown").when(F.col("namespace").isNull(), "key_unknown").when(F.col("namespace") != F.col("expected"), "wrong_namespace")
    if "counter_key_id" in records.columns:
        counter = known.select("tenant_id", F.col("key_id").alias("counter_key_id"), F.col("namespace").alias("counter_namespace"))
        got = got.join(counter, ["tenant_id", "counter_key_id"], "left")
        countersigned = F.coalesce(F.col("counter_namespace") == "issuer", F.lit(False))
        reason = reason.when((F.col("record_type") == "AttestationWindow") & ~countersigned, "no_issuer_counter_key")
    return got.withColumn("reason", reason).where("reason is not null")


def published(records: DataFrame, registry: DataFrame) -> DataFrame:
    """Records of a schema version that the registry does not hold as published."""
    ok = registry.where("status = 'published'").select("schema_version").distinct()
    return records.join(ok, "schema_version", "left_anti")


def boundary_audit(boundaries: DataFrame, families: DataFrame) -> DataFrame:
    """Codes for what a boundary's declaration lacks. Where boundaries have destination_systems and qualification_refs (lists) and families a qualification_ref, families must keep to them, and no
    reference may be left without a family; an absent list is empty."""
    got = families.groupBy("boundary_ref").agg(
        (F.count(F.lit(1)) - F.count_distinct("action_family")).alias("repeated"), F.count_if(F.col("destination_system").isNull()).alias("unplaced"), F.count_if(~F.col("fail_behaviour").isin("fail_open", "fail_closed")).alias("odd")
    )
    own = F.split("boundary_ref", ":")
    more, listed = [], lambda c: F.coalesce(c, F.array().cast("array<string>"))
    if "destination_systems" in boundaries.columns:
        got = got.join(families.groupBy("boundary_ref").agg(F.collect_set("destination_system").alias("_placed")), "boundary_ref")  # of the families of one boundary
        more.append(F.when(F.size(F.array_except(listed("_placed"), listed("destination_systems"))) > 0, "destination_undeclared"))
    if "qualification_refs" in boundaries.columns and "qualification_ref" in families.columns:
        got = got.join(families.groupBy("boundary_ref").agg(F.collect_set("qualification_ref").alias("_refs")), "boundary_ref")
        more += [F.when(F.size(F.array_except(listed("_refs"), listed("qualification_refs"))) > 0, "qualification_undeclared"), F.when(F.size(F.array_except(listed("qualification_refs"), listed("_refs"))) > 0, "qualification_without_family")]
    return boundaries.join(got, "boundary_ref", "left").select("tenant_id", "boundary_ref", F.array_compact(F.array(
        F.when(F.col("repeated").isNull(), "no_family"), F.when(F.col("repeated") > 0, "family_repeated"), F.when(F.col("unplaced") > 0, "destination_missing"), F.when(F.col("odd") > 0, "fail_behaviour_unknown"),
        F.when((F.size(own) != 3) | (own[0] != F.col("tenant_id")) | (own[1] != F.col("name")) | (own[2] != F.col("version").cast("string")), "ref_does_not_compose"), *more,
    )).alias("codes"))


def cleartext(records: DataFrame, digest_only: DataFrame, never: tuple[str, ...], wire: str = "wire") -> DataFrame:
    """Records that carry parameters although their family is digest-only, or a field that is never captured."""
    only = digest_only.select("action_family").distinct().withColumn("_only", F.lit(True))
    body = _get(F.col(wire), "body")
    got = records.withColumn("action_family", _get(F.col(wire), "body.action_family")).join(F.broadcast(only) if digest_only.isLocal() else only, "action_family", "left")
    shown = F.array_contains(F.json_object_keys(body), "parameters") & F.coalesce("_only", F.lit(False))
    barred = body.rlike('"(' + "|".join(never) + r')"\s*:')
    return got.withColumn("reason", F.when(shown, "parameters_in_cleartext").when(barred, "never_captured_field")).where("reason is not null").drop("_only")


def canonical_audit(records: DataFrame, wire: str = "wire") -> DataFrame:
    """(record_id, is_canonical): whether the text is its own canonical form: sorted members, no white space, no floats, no repeats."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def no_float(_: str):
            raise ValueError

        def pairs(items: list) -> dict:
            if len({k for k, _ in items}) != len(items):
                raise ValueError
            return dict(sorted(items, key=lambda kv: kv[0].encode("utf-16-be")))

        def same(text: str | None) -> bool:
            try:
                value = json.loads(text, parse_float=no_float, parse_constant=no_float, object_pairs_hook=pairs)
                return json.dumps(value, ensure_ascii=False, separators=(",", ":")) == text
            except (ValueError, TypeError):
                return False

        for batch in batches:
            yield pd.DataFrame({"record_id": batch["record_id"], "is_canonical": batch[wire].map(same).astype(bool)})

    return records.select("record_id", wire).mapInPandas(run, "record_id string, is_canonical boolean")
