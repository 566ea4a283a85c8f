"""Ingestion checks: collision classes, collectors, keys valid at an instant, clock skew, receipt binding."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from provenix.sources.shared import stored

POSITION = ["tenant_id", "stream_id", "sequence"]
IDENTITY = ["tenant_id", "record_id"]


def classify_against_ledger(submitted: DataFrame, ledger: DataFrame) -> DataFrame:
    """Each submission on its own against stored rows: fork, replay, content_substitution or accept, in this order."""
    at = ledger.select(*POSITION, F.col("record_id").alias("held_by"))
    same = ledger.select(*IDENTITY, F.col("wire_digest").alias("stored_digest"))
    both = submitted.join(at, POSITION, "left").join(same, IDENTITY, "left")
    outcome = (
        F.when(F.col("held_by").isNotNull() & (F.col("held_by") != F.col("record_id")), "fork")
        .when(F.col("stored_digest") == F.col("wire_digest"), "replay").when(F.col("stored_digest").isNotNull(), "content_substitution").otherwise("accept")
    )
    return both.withColumn("outcome", outcome).drop("held_by", "stored_digest")


def classify_in_order(submitted: DataFrame, arrival: str = "submission_id") -> DataFrame:
    """A whole batch as if one arrived after the other: an accepted submission is in the ledger for those after it. Ids are unique in a tenant, whatever the stream.

    Of equal arrivals the one of the smaller record id comes first, then of the smaller digest, stream and sequence; of equal rows one is first. A submission without
    tenant, record id, stream or sequence names nothing: it is ``unidentified``, and no rival to any other. Null digests are equal to each other.

    A submission that is first both at its position and under its id is accepted, and nearly all others follow from such firsts by windows. What is left
    (a first at its position that is itself refused because of its id, and what depends on it) is decided in rounds of joins: each round decides all whose
    earlier rivals are decided, so their number is that of the longest chain of such dependences.
    """
    cols = submitted.columns
    named = " and ".join(f"{k} is not null" for k in {**dict.fromkeys(POSITION), **dict.fromkeys(IDENTITY)})
    by_position = Window.partitionBy(*POSITION).orderBy(arrival, "record_id", "wire_digest")
    by_id = Window.partitionBy(*IDENTITY).orderBy(arrival, "wire_digest", "stream_id", "sequence", "_np")
    numbered = submitted.where(named).withColumn("_np", F.row_number().over(by_position))
    # one order of all submissions, the same at every position and under every id
    order = F.struct(arrival, "record_id", "wire_digest", "stream_id", "sequence", "_np")
    first = numbered.withColumn("_at", order).withColumn("_ni", F.row_number().over(by_id)).withColumn("_sure", (F.col("_np") == 1) & (F.col("_ni") == 1))
    seen = first.withColumn("_p", F.first(F.struct("record_id", "_sure")).over(by_position)).withColumn("_i", F.first(F.struct("wire_digest", "_sure")).over(by_id))
    again = F.when(F.col("_i.wire_digest").eqNullSafe(F.col("wire_digest")), "replay").otherwise("content_substitution")
    outcome = (
        F.when(F.col("_sure"), "accept").when(F.col("_p._sure") & (F.col("_p.record_id") != F.col("record_id")), "fork")
        .when(F.col("_i._sure") & (F.col("_p._sure") | (F.col("_np") == 1)), again)
    )
    nameless = submitted.where(f"not ({named})").select(*cols, F.lit("unidentified").alias("outcome"))
    decided = stored(seen.withColumn("outcome", outcome).select(*cols, "_at", "outcome"), "submissions")
    settled = lambda df: df.where("outcome is not null").select(*cols, "outcome")
    parts = [nameless, settled(decided)]
    left = decided.where("outcome is null").drop("outcome")
    taken = decided.where("outcome = 'accept'")
    at_position, under_id = taken.select(*POSITION, F.col("record_id").alias("_holder")), taken.select(*IDENTITY, F.struct("wire_digest").alias("_known"))
    if n := left.count():
        at_position = at_position.join(left.select(*POSITION).distinct(), POSITION, "left_semi")
        under_id = under_id.join(left.select(*IDENTITY).distinct(), IDENTITY, "left_semi")
    while n:
        x = left.join(at_position, POSITION, "left").join(under_id, IDENTITY, "left").withColumn("_may", F.col("_holder").isNull() & F.col("_known").isNull())
        before = lambda keys: F.min(F.when(F.col("_may"), F.col("_at"))).over(Window.partitionBy(*keys))
        x = x.withColumn("_fp", before(POSITION)).withColumn("_fi", before(IDENTITY))
        outcome = (
            F.when(F.col("_holder") != F.col("record_id"), "fork")
            .when(F.col("_known").isNotNull() & (F.col("_holder").isNotNull() | F.col("_fp").isNull() | (F.col("_fp") > F.col("_at"))), F.when(F.col("_known.wire_digest").eqNullSafe(F.col("wire_digest")), "replay").otherwise("content_substitution"))
            .when(F.col("_may") & (F.col("_fp") == F.col("_at")) & (F.col("_fi") == F.col("_at")), "accept")
        )
        decided = stored(x.withColumn("outcome", outcome).select(*cols, "_at", "outcome"), "submissions")
        parts.append(settled(decided))
        left = decided.where("outcome is null").drop("outcome")
        before_, n = n, left.count()
        if n == before_:
            raise RuntimeError(f"{n} submissions can't be ordered")  # the first of those left is always decided
        taken = decided.where("outcome = 'accept'")
        at_position = at_position.unionByName(taken.select(*POSITION, F.col("record_id").alias("_holder")))
        under_id = under_id.unionByName(taken.select(*IDENTITY, F.struct("wire_digest").alias("_known")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def position_domain(records: DataFrame) -> DataFrame:
    """Records that break: sequence 1 if and only if there is no previous digest."""
    return records.where("(sequence = 1) <> (prev_digest is null)")


def authenticate(submitted: DataFrame, collectors: DataFrame) -> DataFrame:
    """Why a collector may not submit, or ok: unknown, revoked at or before the source time, another version (a missing one is another), and, where both sides name it,
    another implementation."""
    same = "implementation" in submitted.columns and "implementation" in collectors.columns
    known = collectors.groupBy("tenant_id", "collector_id").agg(F.max("version").alias("version"), F.min("revoked_at").alias("revoked_at"), *([F.max("implementation").alias("_implementation")] if same else []), F.lit(True).alias("known"))
    reason = (
        F.when(F.col("known").isNull(), "collector_unknown").when(F.col("source_time") >= F.col("revoked_at"), "collector_revoked")
        .when(~F.col("collector_version").eqNullSafe(F.col("version")), "collector_version_mismatch")
    )
    if same:
        reason = reason.when(F.col("implementation") != F.col("_implementation"), "collector_implementation_mismatch")
    return submitted.join(known, ["tenant_id", "collector_id"], "left").withColumn("auth", reason.otherwise("ok")).drop("known", "version", "revoked_at", "_implementation")


def key_state(submitted: DataFrame, keys: DataFrame, at: str = "source_time") -> DataFrame:
    """Adds key_state: why a key may not sign a submission at its instant, or ok.

    keys(tenant_id, key_id, namespace, collector_id, valid_from, valid_until, compromised_from); a key of several rows is good if one of them is, and else refused by the check
    that the last of them failed: unknown, signature (it does not verify, or the key signs for another namespace), another collector's, not yet valid, expired, compromised.
    """
    rows = keys.groupBy("tenant_id", "key_id").agg(F.collect_list(F.struct("namespace", "collector_id", "valid_from", "valid_until", "compromised_from")).alias("_keys"))  # a key's own rows
    both = submitted.join(rows, ["tenant_id", "key_id"], "left")
    t, c = F.col(at), F.col("collector_id")
    state, left = F.when(F.col("_keys").isNull(), "key_unknown").when(~F.coalesce("sig_ok", F.lit(False)), "signature_invalid"), F.col("_keys")
    for name, good in (
        ("signature_invalid", lambda k: k["namespace"] == "evidence"), ("key_of_other_collector", lambda k: k["collector_id"] == c), ("key_not_yet_valid", lambda k: k["valid_from"] <= t),
        ("key_expired", lambda k: k["valid_until"].isNull() | (t < k["valid_until"])), ("key_compromised", lambda k: k["compromised_from"].isNull() | (t < k["compromised_from"])),
    ):
        left = F.filter(left, good)
        state = state.when(F.size(left) == 0, name)
    return both.withColumn("key_state", state.otherwise("ok")).drop("_keys")


def keys_valid_at(records: DataFrame, keys: DataFrame, at: str = "source_time") -> DataFrame:
    """Records with the number of key rows valid at their instant: valid_from <= t < valid_until, and before any compromise."""
    t = F.col(at)
    good = (F.col("valid_from") <= t) & (t < F.col("valid_until")) & (F.col("compromised_from").isNull() | (t < F.col("compromised_from")))
    hits = records.join(keys, ["tenant_id", "key_id"]).where(good).groupBy("tenant_id", "record_id").agg(F.count(F.lit(1)).alias("n_keys"), F.min("key_record").alias("key_record"))
    return records.join(hits, IDENTITY, "left").fillna(0, ["n_keys"])


def skew_ms(ingest: str = "ingest_time", source: str = "source_time") -> F.Column:
    """Ingest less source in milliseconds, cut off toward zero."""
    return F.expr(f"(unix_micros({ingest}) - unix_micros({source})) div 1000")


def receipt_binding(receipts: DataFrame) -> DataFrame:
    """Codes of what a receipt does not bind: signer, digest, skew; in this order."""
    codes = F.array_compact(F.array(
        F.when(F.col("key_namespace") != "issuer", "receipt_namespace"), F.when(~F.col("sig_ok"), "receipt_signature"),
        F.when(F.col("receipt_digest") != F.col("record_digest"), "receipt_digest_mismatch"), F.when(skew_ms() != F.col("clock_skew_ms"), "receipt_skew_mismatch"),
    ))
    return receipts.withColumn("codes", codes)


