"""Streaming forms: ingest with two sinks, per-stream memory for replays, forks and holes, alert counts, correlation.

Sources are Parquet or JSON-lines folders (any other Structured Streaming source works alike). ``availableNow`` runs take
what is there and stop, so each stream's result can be compared with its batch form.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from provenix.operators import ingest
from provenix.sources import shared

POSITIONS = "tenant_id string, stream_id string, sequence long, record_id string, record_digest string, outcome string, open_holes long"
STATE = "top long, told long, begins array<long>, ends array<long>"


TENANTS = 1000  # of a micro-batch, up to which the ledger's other tenants are not read


def parquet_stream(spark: SparkSession, path: str, schema: str, only: str | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    return (reader.option("pathGlobFilter", only) if only else reader).parquet(path)


def drain(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Runs a stream over what its source holds now, into Parquet files, exactly once."""
    stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path).awaitTermination()


def ingest_stream(submissions: DataFrame, ledger_path: str, events_path: str, checkpoint: str) -> None:
    """Each micro-batch is classified in arrival order and against the ledger; accepted records and conflicts go to two tables."""

    def write(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        try:
            # the schema is given: a tenant's folder name "001" is not the number 1
            stored = spark.read.schema(StructType([*batch.schema.fields, StructField("epoch", LongType())])).parquet(ledger_path).where(F.col("epoch") != epoch)  # a batch that runs again does not meet itself
            tenants = [r[0] for r in batch.select("tenant_id").distinct().limit(TENANTS + 1).collect()]
            if len(tenants) <= TENANTS:  # then only their folders are read
                stored = stored.where(F.col("tenant_id").isin(tenants))
        except Exception as e:  # the first batch finds no ledger
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
            stored = None
        if stored is None:
            known = batch.withColumn("outcome", F.lit("accept"))
        else:
            known = ingest.classify_against_ledger(batch, stored)
        with shared.scratch(spark):
            fresh = ingest.classify_in_order(known.where("outcome = 'accept'").drop("outcome"))
            # both tables are written from one: the ledger that it was made from is about to change
            done = shared.stored(fresh.unionByName(known.where("outcome <> 'accept'")).withColumn("epoch", F.lit(epoch)), "batch")
            done.where("outcome = 'accept'").drop("outcome").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("tenant_id", "epoch").parquet(ledger_path)
            done.where("outcome <> 'accept'").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("epoch").parquet(events_path)

    submissions.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def stream_memory(records: DataFrame, silence: str = "1 hour") -> DataFrame:
    """records(tenant_id, stream_id, sequence, record_id, record_digest, source_time): per stream, whether a record extends it (accept, accept_after_hole), fills a hole, or stands at
    a position that has been taken (seen). The state is the highest position and the holes below it, as intervals, so a leap to a far position costs one. Holes still
    open when the watermark passes are reported as gaps once, by their first position."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        top, told, begins, ends = state.get if state.exists else (0, 0, [], [])
        begins, ends = list(begins), list(ends)  # holes are begins[k] <= position < ends[k], in order
        if state.hasTimedOut:
            # positions stay known: a record that comes later still fills its hole or meets its rival
            state.update((top, top, begins, ends))
            yield pd.DataFrame([(*key, h, None, None, "gap", e - h) for h, e in zip(begins, ends) if h > told], columns=POSITION_NAMES)
            return
        out = []
        # a position's first record is the one of the smallest id in its batch, however the batch's rows are dealt
        values = lambda c: [None if x != x else x for x in c.tolist()]
        rows = [x for b in batches for x in zip(map(lambda q: None if q is None else int(q), values(b["sequence"])), values(b["record_id"]), values(b["record_digest"]))]
        rows.sort(key=lambda x: [(v is None, v) if v is not None else (True,) for v in x])  # nulls last
        open_ = sum(e - h for h, e in zip(begins, ends))
        for sequence, record_id, record_digest in rows:
            if sequence is None:
                outcome = "seen"
            elif sequence > top:
                outcome = "accept" if sequence == top + 1 else "accept_after_hole"
                if sequence > top + 1:
                    begins.append(top + 1), ends.append(sequence)
                    open_ += sequence - top - 1
                top = sequence
            else:
                k = bisect.bisect_right(begins, sequence) - 1
                if k >= 0 and sequence < ends[k]:
                    outcome, open_ = "fills_hole", open_ - 1
                    pieces = [(a, b) for a, b in ((begins[k], sequence), (sequence + 1, ends[k])) if a < b]
                    begins[k : k + 1], ends[k : k + 1] = [a for a, _ in pieces], [b for _, b in pieces]
                else:
                    outcome = "seen"
            out.append((*key, sequence, record_id, record_digest, outcome, open_))
        state.update((top, told, begins, ends))
        if begins and begins[-1] > told:
            state.setTimeoutTimestamp(max(state.getCurrentWatermarkMs(), 0) + 3_600_000)
        yield pd.DataFrame(out, columns=POSITION_NAMES)

    # a stream's rows become a frame of their own: only the columns that the step reads are moved there
    read = records.select(*HELD, "source_time").withWatermark("source_time", silence)
    return read.groupBy("tenant_id", "stream_id").applyInPandasWithState(step, POSITIONS, STATE, "append", GroupStateTimeout.EventTimeTimeout)


POSITION_NAMES = [c.split()[0] for c in POSITIONS.split(", ")]


def positions_stream(records: DataFrame, ledger_path: str, out_path: str, checkpoint: str, silence: str = "1 hour") -> None:
    """stream_memory, with what stands at a taken position told apart by the ledger of all earlier batches: the same record is a replay, any other a fork.
    Accepted records go to the ledger; every record's outcome goes to out_path."""

    def write(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        own = batch.persist()  # one evaluation of the stateful step feeds both sinks
        new = own.where("outcome like 'accept%' or outcome = 'fills_hole'").select(*HELD)
        new.withColumn("epoch", F.lit(epoch)).sortWithinPartitions("tenant_id", "stream_id", "sequence").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("epoch").parquet(ledger_path)
        seen = own.where("outcome = 'seen'")
        at = spark.read.parquet(ledger_path).where(F.col("epoch") <= epoch).drop("epoch")
        tenants = [r[0] for r in seen.select("tenant_id").distinct().limit(TENANTS + 1).collect()]
        if len(tenants) <= TENANTS:  # then only their rows are read: files are sorted by tenant, so that others are skipped
            at = at.where(F.col("tenant_id").isin(tenants))
        at = at.withColumnsRenamed({"record_id": "held_id", "record_digest": "held_digest"})
        told = seen.join(at, ["tenant_id", "stream_id", "sequence"], "left").withColumn("outcome", F.when((F.col("held_id") == F.col("record_id")) & (F.col("held_digest") == F.col("record_digest")), "replay").otherwise("fork"))
        done = own.where("outcome <> 'seen'").unionByName(told.drop("held_id", "held_digest"))
        done.withColumn("epoch", F.lit(epoch)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("epoch").parquet(out_path)
        own.unpersist()

    stream_memory(records, silence).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


HELD = ["tenant_id", "stream_id", "sequence", "record_id", "record_digest"]


def alert_counts(events: DataFrame, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Operational counts by type and tumbling window."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("window_start"), "event_type", "n")


def correlate(receipts: DataFrame, confirmations: DataFrame, within: str = "1 day") -> DataFrame:
    """Receipts with the confirmation of the same record that comes within a time; a stream–stream left outer join."""
    r = receipts.withWatermark("responded_at", within).alias("r")
    c = confirmations.withWatermark("authoritative_time", within).alias("c")
    on = F.expr(f"r.tenant_id = c.tenant_id and r.destination_record_id = c.destination_record_id and r.action_id = c.action_id and c.authoritative_time between r.responded_at - interval {within} and r.responded_at + interval {within}")
    return r.join(c, on, "left_outer").select("r.tenant_id", "r.destination_record_id", F.col("r.record_id").alias("receipt_id"), F.col("c.record_id").alias("confirmation_id"))


def silences(records: DataFrame, collectors: DataFrame) -> DataFrame:
    """Provisional gaps of collectors that fall silent for longer than their cadence; the last one has no end."""
    from pyspark.sql import Window

    w = Window.partitionBy("tenant_id", "collector_id").orderBy("source_time", "record_id")
    named = records.join(collectors.groupBy("tenant_id", "collector_id").agg(F.max("expected_cadence_s").alias("cadence_s")), ["tenant_id", "collector_id"])
    nxt = F.lead("source_time").over(w)
    timed = named.withColumn("gap_end", nxt)
    wait = F.unix_micros("gap_end") - F.unix_micros("source_time")
    return timed.where(F.col("gap_end").isNull() | (wait > F.col("cadence_s") * 1_000_000)).select("tenant_id", "collector_id", F.col("source_time").alias("gap_start"), "gap_end")


def late_records(records: DataFrame, issued: DataFrame, out_path: str, checkpoint: str) -> None:
    """Records that reach the ledger after the attestation of their window was issued: none is amended, each is filed with the attestation that a successor must supersede.

    records(tenant_id, boundary_ref, record_id, authoritative_time, ingest_time) is a stream; issued(attestation_id, tenant_id, boundary_ref, window_start, window_end, issued_at) is read anew
    for each micro-batch. No watermark drops a record, however late.
    """

    def write(batch: DataFrame, epoch: int) -> None:
        hit = batch.join(issued, ["tenant_id", "boundary_ref"]).where("authoritative_time >= window_start and authoritative_time < window_end and ingest_time > issued_at")
        hit.select("tenant_id", "attestation_id", "record_id", "ingest_time", F.lit(epoch).alias("epoch")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("epoch").parquet(out_path)

    records.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def settled_windows(records: DataFrame, window: str, lag: str) -> DataFrame:
    """Counts of windows whose settlement lag has passed: a window is out once, when the destination's own time is beyond its end by the lag, and never before."""
    return records.withWatermark("authoritative_time", lag).groupBy("tenant_id", F.window("authoritative_time", window).alias("w")).agg(F.count(F.lit(1)).alias("n")).select("tenant_id", F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "n")


def outage_episodes(refusals: DataFrame) -> DataFrame:
    """Runs of refusals up to the next restored capacity: first refusal, number, how many actions went on unrecorded (fail-open)."""
    from pyspark.sql import Window

    w = Window.partitionBy("tenant_id", "collector_id").orderBy("refused_at", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    marked = refusals.withColumn("episode", F.coalesce(F.sum(F.col("restored").cast("int")).over(w), F.lit(0)))
    bad = ~F.col("restored")
    return marked.groupBy("tenant_id", "collector_id", "episode").agg(
        F.min(F.when(bad, F.col("refused_at"))).alias("gap_start"), F.max(F.when(F.col("restored"), F.col("refused_at"))).alias("gap_end"), F.count_if(bad).alias("n_refused"), F.count_if(bad & F.col("fail_open")).alias("actions_during_gap")
    ).where("n_refused > 0")
