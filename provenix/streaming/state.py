"""Streams with memory and timers of their own: ids of a tenant, silent collectors, settlement by family.

Each is a stateful processor on keyed state in RocksDB, so that a key's memory is updated entry by entry and not rewritten whole, with timers that event time fires.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from datetime import UTC, datetime, timedelta

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER, NO_DATA = "spark.sql.streaming.stateStore.providerClass", "spark.sql.streaming.noDataMicroBatches.enabled"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
EPOCH = datetime(1970, 1, 1, tzinfo=UTC)


@contextmanager
def keyed_state(spark: SparkSession, idle: bool = True) -> Iterator[None]:
    """Queries started inside hold their state in RocksDB, as stateful processors need; the session's own choice stays for others.

    idle: whether batches without new data run, which timers of event time need. State that lives by the machine's clock asks for such batches without end, so that
    a run over what is there must do without.
    """
    own = {PROVIDER: ROCKS, NO_DATA: str(idle).lower()}
    before = {k: spark.conf.get(k, None) for k in own}
    for k, v in own.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v else spark.conf.unset(k)


def drain(stream: DataFrame, path: str, checkpoint: str, idle: bool = True) -> dict | None:
    """Runs over what the source holds now into Parquet files, exactly once; returns the measures of the last batch that had state (rows and bytes of it among them). idle: see ``keyed_state``."""
    with keyed_state(stream.sparkSession, idle):
        query = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)
    query.awaitTermination()
    told = [p["stateOperators"][0] for p in query.recentProgress if p["stateOperators"]]
    return told[-1] if told else None


def _micros(t: pd.Series) -> list[int]:
    """Microseconds since 1970 of a column of instants, whatever unit pandas holds them in."""
    t = pd.to_datetime(t, utc=True)
    return t.astype("datetime64[us, UTC]").astype("int64").tolist()


def _time(us: int | None) -> datetime | None:
    return None if us is None else (EPOCH + timedelta(microseconds=us)).replace(tzinfo=None)


def _ms(us: int) -> int:
    """The first millisecond at or after an instant."""
    return -(-us // 1000)


# -- ids


class _Ids(StatefulProcessor):
    """By id of a bucket: where it was first seen and with what content."""

    def __init__(self, ttl_ms: int):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.ids = handle.getMapState("ids", "record_id string", "stream_id string, sequence bigint, wire_digest string", self.ttl_ms or None)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        # the state is asked once for an id of the batch, and not at all while the bucket is empty
        out, known, empty = [], {}, not self.ids.exists()
        for r in pd.concat(list(rows)).sort_values(["arrival", "record_id", "stream_id", "sequence", "wire_digest"]).itertuples():
            own, name = (r.stream_id, int(r.sequence), r.wire_digest), (r.record_id,)
            first = known.get(r.record_id)
            if first is None and not empty:
                first = self.ids.getValue(name)
            known[r.record_id] = first or own
            if first is None:
                self.ids.updateValue(name, own)
                out.append((key[0], r.record_id, int(r.arrival), "first", None, None))
            else:
                out.append((key[0], r.record_id, int(r.arrival), "replay" if tuple(first) == own else "content_substitution", first[0], first[1]))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in ID_ROWS.split(", ")])

    def close(self) -> None:
        pass


ID_ROWS = "tenant_id string, record_id string, arrival long, outcome string, first_stream string, first_sequence long"


def identity_memory(records: DataFrame, buckets: int = 1024, ttl: timedelta | None = None) -> DataFrame:
    """records(tenant_id, record_id, stream_id, sequence, wire_digest, arrival) -> ID_ROWS: whether an id of a tenant is new (first), sent again as it was (replay), or
    names other content or another place, in whatever stream (content_substitution, with the place first seen).

    State is a map by id in each of a tenant's buckets: an id costs one entry, and a busy tenant is spread over its buckets. Entries go ``ttl`` after they were written, where one is given;
    older ids are then known to the ledger only, and a run over what is there takes ``idle=False``. Rows without tenant, id, place or digest are not looked at. Start it inside ``keyed_state``.
    """
    named = records.where("tenant_id is not null and record_id is not null and stream_id is not null and sequence is not null and wire_digest is not null")
    keyed = named.select("tenant_id", F.pmod(F.xxhash64("record_id"), F.lit(buckets)).alias("bucket"), "record_id", "stream_id", "sequence", "wire_digest", "arrival")
    life = int(ttl.total_seconds() * 1000) if ttl else 0
    return keyed.groupBy("tenant_id", "bucket").transformWithStateInPandas(_Ids(life), ID_ROWS, "Append", "ProcessingTime" if life else "None")


def held(spark: SparkSession, checkpoint: str, name: str) -> DataFrame:
    """The entries of a processor's map state as its last batch left them."""
    return spark.read.format("statestore").option("stateVarName", name).load(checkpoint)


# -- silences


class _Silences(StatefulProcessor):
    """By collector: the last record that event time has passed, those that it hasn't, and whether a gap is open."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.now = handle.getValueState("now", "last bigint, open boolean, cadence bigint")
        self.waiting = handle.getListState("waiting", "at bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows))
        last, open_, _ = self.now.get() if self.now.exists() else (None, False, 0)
        came = {at for at in _micros(batch["source_time"]) if last is None or at > last}
        yield from self._advance(key, timerValues, (last, open_, int(batch["cadence_s"].max()) * 1_000_000), came)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._advance(key, timerValues, self.now.get(), set())

    def _advance(self, key, timerValues, now: tuple, came: set[int]) -> Iterator[pd.DataFrame]:
        """Takes up the records that the watermark has passed, in order of time; then waits for the next of them, or the deadline. Those that wait are added to the state, and written anew when some are taken up."""
        last, open_, cadence = now
        clock = timerValues.getCurrentWatermarkInMs() * 1000
        held = {x[0] for x in self.waiting.get()}
        waiting, out = sorted(held | came), []
        for at in [x for x in waiting if x <= clock]:
            if last is not None and at - last > cadence:
                out.append((*key, last, at, "closed" if open_ else "whole"))
            last, open_ = at, False
        left = [x for x in waiting if x > clock]
        if held and len(left) < len(waiting):
            if left:
                self.waiting.put([(x,) for x in left])
            else:
                self.waiting.clear()
        elif new := [x for x in left if x not in held]:
            self.waiting.appendList([(x,) for x in new])
        if last is not None and not open_ and last + cadence < clock:
            open_ = True
            out.append((*key, last, None, "open"))
        self.now.update((last, open_, cadence))
        for t in self.handle.listTimers():
            self.handle.deleteTimer(t)
        if left:
            self.handle.registerTimer(_ms(left[0]))
        if last is not None and not open_:
            self.handle.registerTimer(_ms(last + cadence) + 1)
        if out:
            yield pd.DataFrame({"tenant_id": [x[0] for x in out], "collector_id": [x[1] for x in out], "gap_start": [_time(x[2]) for x in out], "gap_end": pd.Series([_time(x[3]) for x in out], dtype="datetime64[us]"), "state": [x[4] for x in out]})

    def close(self) -> None:
        pass


SILENCE_ROWS = "tenant_id string, collector_id string, gap_start timestamp, gap_end timestamp, state string"


def silence_stream(records: DataFrame, collectors: DataFrame, late: str) -> DataFrame:
    """records(tenant_id, collector_id, source_time), collectors(tenant_id, collector_id, expected_cadence_s) -> SILENCE_ROWS.

    Each collector has a deadline of its own, its last record and its own cadence. When event time passes it an ``open`` gap without an end is out; the next record closes it
    (``closed``, the same beginning). A gap whose end has come by the time its deadline passes is out once (``whole``). Records may come out of order by ``late``: they wait in the
    state until the watermark has passed them. Start it inside ``keyed_state``.
    """
    cadence = collectors.groupBy("tenant_id", "collector_id").agg(F.max("expected_cadence_s").alias("cadence_s"))
    timed = records.withWatermark("source_time", late).join(cadence, ["tenant_id", "collector_id"]).select("tenant_id", "collector_id", "source_time", "cadence_s")
    return timed.groupBy("tenant_id", "collector_id").transformWithStateInPandas(_Silences(), SILENCE_ROWS, "Append", "EventTime")


def gaps_now(silences: DataFrame) -> DataFrame:
    """What the rows of ``silence_stream`` amount to: each gap once, without an end while it is open."""
    return silences.groupBy("tenant_id", "collector_id", "gap_start").agg(F.max("gap_end").alias("gap_end"))


# -- settlement


class _Settlement(StatefulProcessor):
    """By window of a family: its count until the family's own lag has passed; then what still comes is late."""

    def __init__(self, most_us: int):
        self.most_us = most_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.now = handle.getValueState("now", "n bigint, end_us bigint, due_us bigint, out boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows))
        n, end, due, out = self.now.get() if self.now.exists() else (0, _micros(batch["window_end"])[0], _micros(batch["window_end"])[0] + int(batch["lag_s"].max()) * 1_000_000, False)
        if not out and timerValues.getCurrentWatermarkInMs() * 1000 + self.most_us >= due:
            if n:  # rows of a batch are seen before its timers
                yield self._row(key, end, n, "settled")
            out = True
        if out:
            # the window's time was up before these rows came: they are reported and amend nothing
            self.now.update((n, end, due, True))
            self.handle.registerTimer(_ms(end))
            yield self._row(key, end, len(batch), "late")
            return
        self.now.update((n + len(batch), end, due, False))
        if n == 0:
            self.handle.registerTimer(_ms(due - self.most_us))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        n, end, due, out = self.now.get()
        clock = timerValues.getCurrentWatermarkInMs() * 1000
        if not out:
            yield self._row(key, end, n, "settled")
            self.now.update((n, end, due, True))
        if clock < end:
            self.handle.registerTimer(_ms(end))  # until then rows of the window can come
        else:
            self.now.clear()

    def _row(self, key, end: int, n: int, state: str) -> pd.DataFrame:
        return pd.DataFrame({"tenant_id": [key[0]], "action_family": [key[1]], "window_start": [key[2].replace(tzinfo=None)], "window_end": [_time(end)], "n": [int(n)], "state": [state]})

    def close(self) -> None:
        pass


SETTLED_ROWS = "tenant_id string, action_family string, window_start timestamp, window_end timestamp, n long, state string"


def settlement_stream(records: DataFrame, lags: DataFrame, window: str, most: timedelta) -> DataFrame:
    """records(tenant_id, action_family, authoritative_time), lags(action_family, lag_s) -> SETTLED_ROWS.

    A window of a family is out once (``settled``), when the destination's time is past its end by the family's own lag, and never before. Rows that come after that are counted as
    ``late`` and amend nothing. ``most`` is the longest lag: rows older than that against the destination's time are dropped by the watermark. Families without a lag are left out.
    Start it inside ``keyed_state``.
    """
    own = lags.groupBy("action_family").agg(F.max("lag_s").alias("lag_s"))
    timed = records.withWatermark("authoritative_time", f"{int(most.total_seconds())} seconds").join(own, "action_family")
    span = F.window("authoritative_time", window)
    keyed = timed.select("tenant_id", "action_family", span["start"].alias("window_start"), span["end"].alias("window_end"), "lag_s", "authoritative_time")
    return keyed.groupBy("tenant_id", "action_family", "window_start").transformWithStateInPandas(_Settlement(int(most.total_seconds()) * 1_000_000), SETTLED_ROWS, "Append", "EventTime")

