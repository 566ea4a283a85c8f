"""Integrity of record streams: links, forks, key changes, the prefix that can be trusted.

Links are checked by an equi-join of each record with the one before it, so a very long stream is spread over all tasks;
only breaks, which are few, are looked at by stream.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

STREAM = ["tenant_id", "stream_id"]


def forks(records: DataFrame) -> DataFrame:
    """Positions that two authenticated records of different identity or content hold. Exact copies are counted, not forks."""
    signed = records.where("sig_ok").groupBy(*STREAM, "sequence").agg(F.count_distinct("record_id", "record_digest").alias("n_records"), F.count(F.lit(1)).alias("n_rows"))
    return signed.where("n_records > 1")


def settled(records: DataFrame) -> DataFrame:
    """One record for each position: copies collapse (duplicate_count); at a contested position the authenticated one stands, else the least id."""
    best = F.struct((~F.col("sig_ok")).alias("weak"), "record_id", "record_digest")
    rest = [c for c in records.columns if c not in (*STREAM, "sequence", "record_id", "record_digest")]
    got = records.groupBy(*STREAM, "sequence").agg(F.min_by(F.struct("record_id", "record_digest", *rest), best).alias("r"), F.count(F.lit(1)).alias("duplicate_count"))
    return got.select(*STREAM, "sequence", "r.*", "duplicate_count")


#: The closed set of members of a continuity statement, but for its signature, whose truth is a column.
STATEMENT = ("alg", "predecessor_key_id", "new_key_id", "new_public_key", "tenant_id", "stream_id")


def continuity(records: DataFrame, statements: DataFrame, keys: DataFrame) -> DataFrame:
    """(STREAM, sequence, record_id, codes): what is wrong with the statement by which a stream's key hands over to the next; records without fault have no row.

    statements(tenant_id, record_id, the members of STATEMENT prefixed c_, c_extra: whether it has other members, c_sig_ok: whether the predecessor key signed it), one for a record at most; keys(tenant_id, key_id,
    public_key). A statement stands exactly where the key changes: not on a stream's first record, not without a change. Behind a hole, or after a record that is missing, neither can be told: no row.
    A record is joined with its predecessor and its statement by key, so that a long stream is spread over all tasks.
    """
    ahead = records.select(*STREAM, (F.col("sequence") + 1).alias("sequence"), F.col("key_id").alias("_before"), F.lit(True).alias("_has"))
    public = keys.groupBy("tenant_id", "key_id").agg(F.min("public_key").alias("_public"))
    said = statements.withColumn("_said", F.lit(True))
    both = records.select(*STREAM, "sequence", "record_id", "key_id").join(ahead, [*STREAM, "sequence"], "left").join(said, ["tenant_id", "record_id"], "left").join(public, ["tenant_id", "key_id"], "left")
    first, known, said_ = F.col("sequence") == 1, F.coalesce("_has", F.lit(False)), F.coalesce("_said", F.lit(False))
    changed, differs = F.col("key_id") != F.col("_before"), lambda a, b: ~F.col(a).eqNullSafe(F.col(b))
    judged = known & changed & said_
    codes = F.array_compact(F.array(
        F.when(first & said_, "continuity_on_first_record"), F.when(known & ~changed & said_, "continuity_without_rotation"), F.when(known & changed & ~said_, "rotation_without_continuity"),
        F.when(judged & F.coalesce("c_extra", F.lit(True)), "members_unknown_or_missing"), F.when(judged & (F.coalesce("c_alg", F.lit("")) != "ed25519"), "algorithm_unsupported"),
        F.when(judged & differs("c_predecessor_key_id", "_before"), "wrong_predecessor"), F.when(judged & differs("c_new_key_id", "key_id"), "wrong_new_key"), F.when(judged & differs("c_tenant_id", "tenant_id"), "wrong_tenant"),
        F.when(judged & differs("c_stream_id", "stream_id"), "wrong_stream"), F.when(judged & (F.col("_public").isNull() | differs("c_new_public_key", "_public")), "wrong_public_key"), F.when(judged & ~F.coalesce("c_sig_ok", F.lit(False)), "not_signed_by_predecessor"),
    ))
    return both.select(*STREAM, "sequence", "record_id", codes.alias("codes")).where(F.size("codes") > 0)


def with_continuity(records: DataFrame, faults: DataFrame) -> DataFrame:
    """records with has_continuity as ``links`` reads it: a rotation is good if ``continuity`` found nothing against it."""
    return records.drop("has_continuity").join(faults.select(*STREAM, "sequence", F.lit(False).alias("has_continuity")), [*STREAM, "sequence"], "left").fillna(True, ["has_continuity"])


def links(records: DataFrame) -> DataFrame:
    """Each record beside its predecessor, with the codes of what does not hold, link before key."""
    ahead = records.select(*STREAM, (F.col("sequence") + 1).alias("sequence"), F.col("record_digest").alias("before_digest"), F.col("key_id").alias("before_key"), F.lit(True).alias("has_before"))
    both = records.join(ahead, [*STREAM, "sequence"], "left")
    first, known = F.col("sequence") == 1, F.coalesce("has_before", F.lit(False))
    changed = known & (F.col("key_id") != F.col("before_key"))
    return both.withColumn("codes", F.array_compact(F.array(
        F.when(~F.col("sig_ok"), "signature_invalid"),
        F.when(~first & ~known, "sequence_gap"),
        F.when((first & F.col("prev_digest").isNotNull()) | (known & ~F.col("prev_digest").eqNullSafe(F.col("before_digest"))), "chain_link_broken"),
        F.when(changed & ~F.col("has_continuity"), "key_discontinuity"),
    ))).drop("before_digest", "has_before")


def valid_prefix(records: DataFrame, linked: DataFrame, contested: DataFrame) -> DataFrame:
    """By stream: the first break and its code, the last sequence to trust, its digest and key; a fork voids the stream."""
    breaks = linked.where(F.size("codes") > 0).groupBy(*STREAM).agg(F.min("sequence").alias("first_break"), F.min_by(F.element_at("codes", 1), "sequence").alias("code"))
    fatal = contested.groupBy(*STREAM).agg(F.min("sequence").alias("fork_at"))
    known = records.join(breaks, STREAM, "left").join(fatal, STREAM, "left")
    good = F.col("fork_at").isNull() & (F.col("first_break").isNull() | (F.col("sequence") < F.col("first_break")))
    return known.groupBy(*STREAM).agg(
        F.max("first_break").alias("first_break"), F.max("code").alias("code"), F.max("fork_at").alias("fork_at"), F.coalesce(F.max(F.when(good, F.col("sequence"))), F.lit(0)).alias("valid_through"),
        F.max_by("record_digest", F.when(good, F.col("sequence"))).alias("last_digest"), F.max_by("key_id", F.when(good, F.col("sequence"))).alias("last_key"),
    ).withColumn("fatal", F.col("fork_at").isNotNull())


def break_gaps(records: DataFrame, linked: DataFrame) -> DataFrame:
    """A gap for each missing run or unexplained key change: from the last record below it to the record above."""
    bad = linked.where(F.array_contains("codes", "sequence_gap") | F.array_contains("codes", "key_discontinuity")).select(
        *STREAM, F.col("sequence").alias("at"), F.col("source_time").alias("gap_end"), F.when(F.array_contains("codes", "sequence_gap"), "sequence_break").otherwise("key_discontinuity").alias("cause")
    )
    # the record below each position: inside its block of positions by a window, at a block's beginning from the last block that has records
    at = records.groupBy(*STREAM, "sequence").agg(F.max("source_time").alias("source_time")).withColumn("block", _block())
    held = F.struct("sequence", "source_time")
    blocks = at.groupBy(*STREAM, "block").agg(F.max(held).alias("last")).withColumn("before", F.lag("last").over(Window.partitionBy(*STREAM).orderBy("block"))).drop("last")
    inside = at.withColumn("below", F.lag(held).over(Window.partitionBy(*STREAM, "block").orderBy("sequence")))
    below = inside.join(blocks, [*STREAM, "block"]).select(*STREAM, F.col("sequence").alias("at"), F.coalesce("below", "before").alias("below"))
    return bad.join(below, [*STREAM, "at"]).where("below is not null").select(*STREAM, "at", F.col("below.sequence").alias("last_known"), "cause", F.col("below.source_time").alias("gap_start"), "gap_end")


BLOCK = 1 << 16  # positions of a stream that one window orders; a longer stream is ordered by many tasks


def _block() -> F.Column:
    return F.floor(F.col("sequence") / BLOCK)


def segments(linked: DataFrame) -> DataFrame:
    """Runs of records between breaks: evidence after a break belongs to a new window. Breaks are counted by block of positions first, then inside each."""
    broken = F.when(F.size("codes") > 0, 1).otherwise(0)
    marked = linked.withColumn("block", _block())
    ahead = Window.partitionBy(*STREAM).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = marked.groupBy(*STREAM, "block").agg(F.sum(broken).alias("own")).withColumn("before", F.coalesce(F.sum("own").over(ahead), F.lit(0))).drop("own")
    cut = marked.join(blocks, [*STREAM, "block"]).withColumn("segment_id", F.col("before") + F.sum(broken).over(Window.partitionBy(*STREAM, "block").orderBy("sequence")))
    return cut.groupBy(*STREAM, "segment_id").agg(F.min("sequence").alias("first_sequence"), F.max("sequence").alias("last_sequence"), F.count(F.lit(1)).alias("n_records"), F.min("source_time").alias("start_time"), F.max("source_time").alias("end_time"))


def slice_links(bundled: DataFrame) -> DataFrame:
    """Link state inside a bundle (bundle_id, then stream): checked, broken, unchecked over a hole, before:n at the start, fork if repeated."""
    order = Window.partitionBy("bundle_id", *STREAM).orderBy("sequence", "record_id")
    prev, digest = F.lag("sequence").over(order), F.lag("record_digest").over(order)
    state = (
        F.when(prev.isNull() & (F.col("sequence") > 1), F.concat(F.lit("before:"), (F.col("sequence") - 1).cast("string")))
        .when(prev.isNull(), F.when(F.col("prev_digest").isNull(), "checked").otherwise("broken"))
        .when(prev == F.col("sequence"), "fork").when(prev + 1 < F.col("sequence"), "unchecked")
        .when(F.col("prev_digest").eqNullSafe(digest), "checked").otherwise("broken")
    )
    return bundled.withColumn("link", state)


def namespaces(records: DataFrame) -> DataFrame:
    """Streams whose records come from more than one signer namespace."""
    return records.groupBy(*STREAM).agg(F.count_distinct("namespace").alias("n_namespaces")).where("n_namespaces > 1")
