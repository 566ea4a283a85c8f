"""Streams in several runs: ingest with three tables, memory of ids, silences and settlement by timers; arrival order for nulls and ties."""

from __future__ import annotations

import json
import os
import random
from datetime import datetime, timedelta

import pytest

from provenix.operators import ingest, validate
from provenix.streaming import evidence, ingestion, state

T0 = datetime(2024, 1, 1)
REGISTRY = "tenant_id string, collector_id string, version string, implementation string, revoked_at timestamp"
KEYS = "tenant_id string, key_id string, namespace string, collector_id string, valid_from timestamp, valid_until timestamp, compromised_from timestamp"


def wire(n: int, **own) -> str:
    """A sound record's text; own: envelope members, or collector, version, implementation, key, time, note."""
    samples = {"s": "x", "t": "2024-01-01T00:00:00.000Z", "d": "sha256:" + "0" * 64, "n": 0, "p": 1, "b": True, "o": {}, "l": [], "j": [1]}
    kind = own.get("record_type", "AgentIdentity")
    body = {name: words[0] if words else samples[k] for name, k, _, words in validate.members_of(kind if kind in validate.BODIES else "AgentIdentity")} | {"note": own.pop("note", "")}
    source = {k: v for k, v in (("collector_id", own.pop("collector", "c1")), ("implementation", own.pop("implementation", None)), ("version", own.pop("version", "1"))) if v is not None}
    key, time = own.pop("key", "k1"), own.pop("time", "2024-01-02T00:00:00.000Z")
    sequence = own.get("sequence", n)
    record = {
        "body": body, "boundary_ref": "b", "clocks": {"source_time": time}, "prev_digest": None if sequence == 1 else "sha256:" + "1" * 64, "record_id": f"0190a000-0000-7000-8000-{n:012x}", "record_type": "AgentIdentity", "schema_version": "1.0.0",
        "sequence": n, "signature": {"key_id": key} if key else {}, "source": source, "stream_id": "s", "tenant_id": "t",
    } | own
    return json.dumps(record, sort_keys=True, separators=(",", ":"))


@pytest.fixture(scope="module")
def registries(spark):
    day = lambda n: T0 + timedelta(days=n)
    collectors = spark.createDataFrame([("t", "c1", "1", "sdk", None), ("t", "c2", "1", None, day(5)), ("u", "c3", "1", None, None)], REGISTRY)
    keys = [("t", "k1", "evidence", "c1", day(0), None, None), ("t", "k2", "evidence", "c2", day(0), None, None), ("t", "k3", "issuer", "c1", day(0), None, None), ("t", "k4", "evidence", "c1", day(3), day(6), None), ("t", "k5", "evidence", "c1", day(0), None, day(4)), ("t", "k5", "evidence", "c2", day(0), None, None)]
    return collectors, spark.createDataFrame(keys, KEYS)


def take_in(spark, rows, registries, at):
    spark.createDataFrame(rows, "submission_id long, wire string, sig_ok boolean").coalesce(1).write.mode("append").parquet(f"{at}/in")
    ingestion.run(evidence.parquet_stream(spark, f"{at}/in", "submission_id long, wire string, sig_ok boolean"), *registries, f"{at}/out", f"{at}/checkpoint")
    found = {}
    for table in ingestion.TABLES:
        for r in ingestion.committed(spark, f"{at}/out", table).collect():
            assert r.submission_id not in found
            found[r.submission_id] = (table, *((r.outcome, r.existing_record_id[-2:]) if table == "conflicts" else (r.stage, r.reason) if table == "refusals" else ()))
    return found


def test_every_submission_ends_in_one_table(spark, registries, tmp_path):
    at = lambda d: f"2024-01-{d:02d}T00:00:00.000Z"
    bad = [
        ("not json", True, "record", "record.json.malformed"), (None, True, "record", "record.json.malformed"), (wire(50, schema_version="x"), True, "record", "record.schema_version.invalid"),
        (wire(51, record_type="RevocationRecord"), True, "origin", "not_customer_evidence"), (wire(52, collector=None), True, "collector", "collector_missing"), (wire(53, collector="c9"), True, "collector", "collector_unknown"),
        (wire(54, collector="c3"), True, "collector", "collector_unknown"), (wire(55, collector="c2", key="k2", time=at(6)), True, "collector", "collector_revoked"), (wire(56, version="2"), True, "collector", "collector_version_mismatch"),
        (wire(57, version=None), True, "collector", "collector_version_mismatch"), (wire(58, implementation="other"), True, "collector", "collector_implementation_mismatch"), (wire(59, key=None), True, "key", "key_missing"), (wire(60, key="k9"), True, "key", "key_unknown"),
        (wire(61), False, "key", "signature_invalid"), (wire(62), None, "key", "signature_invalid"), (wire(63, key="k3"), True, "key", "signature_invalid"), (wire(64, key="k2"), True, "key", "key_of_other_collector"), (wire(65, key="k4"), True, "key", "key_not_yet_valid"),
        (wire(66, key="k4", time=at(7)), True, "key", "key_expired"), (wire(67, key="k5", time=at(5)), True, "key", "key_compromised"), (wire(1, prev_digest="sha256:" + "1" * 64), True, "position", "position_domain"), (wire(68, prev_digest=None), True, "position", "position_domain"),
    ]
    one = [(i, w, ok) for i, (w, ok, _, _) in enumerate(bad)]
    want = {i: ("refusals", stage, reason) for i, (_, _, stage, reason) in enumerate(bad)}
    a, b, c = wire(1), wire(2, implementation="sdk", time=at(2)), wire(3, key="k5")
    one += [(100, a, True), (101, a, True), (102, wire(1, note="other"), True), (103, wire(9, sequence=1), True), (104, b, True), (105, wire(2, stream_id="z"), True), (106, wire(7, sequence=2, stream_id="z"), True)]
    want |= {100: ("ledger",), 101: ("refusals", "replay", "replay"), 102: ("conflicts", "content_substitution", "01"), 103: ("conflicts", "fork", "01"), 104: ("ledger",), 105: ("conflicts", "content_substitution", "02"), 106: ("ledger",)}
    assert take_in(spark, one, registries, tmp_path) == want
    # a second run meets the ledger of the first; what was refused left no trace there
    two = [(200, b, True), (201, wire(9, sequence=2), True), (202, wire(2, note="x"), True), (203, c, True), (204, wire(53, sequence=4), True), (205, wire(7, sequence=2, stream_id="z", note="y"), True)]
    want |= {200: ("refusals", "replay", "replay"), 201: ("conflicts", "fork", "02"), 202: ("conflicts", "content_substitution", "02"), 203: ("ledger",), 204: ("ledger",), 205: ("conflicts", "content_substitution", "07")}
    assert take_in(spark, two, registries, tmp_path) == want


def test_a_batch_that_runs_again_changes_nothing(spark, registries, tmp_path):
    rows = [(1, wire(1), True), (2, wire(1), True), (3, wire(8, sequence=1), True), (4, "x", True)]
    checked = ingestion.checked(spark.createDataFrame(rows, "submission_id long, wire string, sig_ok boolean"), *registries)
    root = str(tmp_path)
    see = lambda: {t: sorted(r.submission_id for r in ingestion.committed(spark, root, t).collect()) for t in ingestion.TABLES}
    shared = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir")
    before = set(os.listdir(shared.removeprefix("file:")))
    ingestion.write_batch(checked, 0, root)
    once = see()
    ingestion.write_batch(checked, 0, root)
    assert see() == once == {"ledger": [1], "conflicts": [3], "refusals": [2, 4]}
    left = [x for x in os.listdir(shared.removeprefix("file:")) if x.startswith(("batch-", "submissions-"))]
    assert not set(left) - before  # what a batch worked with is gone
    # a batch whose commit is missing is not seen
    spark.read.parquet(f"{root}/ledger").where("false").withColumn("epoch", ingestion.F.lit(1)).write.mode("append").partitionBy("tenant_id", "epoch").parquet(f"{root}/ledger")
    ingestion.write_batch(ingestion.checked(spark.createDataFrame([(9, wire(2), True)], "submission_id long, wire string, sig_ok boolean"), *registries), 1, root)
    assert see()["ledger"] == [1, 9]
    (tmp_path / "commits" / "epoch=1").rename(tmp_path / "gone")
    assert see() == once


def test_order_of_nulls_and_ties(spark):
    schema = "tenant_id string, stream_id string, sequence long, record_id string, wire_digest string, submission_id long, note string"
    rows = [("t", "s", 1, "a", "d1", 1, ""), ("t", "s2", 1, "a", "d2", 2, ""), ("t", "s2", 1, "b", "d3", 3, ""), ("t", "s2", 1, None, "d4", 4, ""), (None, "s", 1, "a", "d", 5, ""), ("t", None, 1, "q", "d", 6, ""), ("t", "s", None, "q", "d", 7, ""), ("t", "s", 3, "n", None, 8, ""), ("t", "s", 3, "n", None, 9, "")]
    got = {r.submission_id: r.outcome for r in ingest.classify_in_order(spark.createDataFrame(rows, schema)).collect()}
    assert got == {1: "accept", 2: "content_substitution", 3: "accept", 4: "unidentified", 5: "unidentified", 6: "unidentified", 7: "unidentified", 8: "accept", 9: "replay"}
    # equal arrivals: the smaller id first; one of equal rows is first, and the same one at its position and under its id
    ties = [("t", "s", 1, "b", "d", 1, "x"), ("t", "s", 1, "a", "d", 1, "y"), ("t", "s", 1, "a", "d", 1, "z"), ("t", "s2", 1, "b", "e", 1, "u"), ("t", "s2", 1, "b", "e", 1, "v")]
    got = ingest.classify_in_order(spark.createDataFrame(ties, schema)).collect()
    assert sorted((r.record_id, r.stream_id, r.outcome) for r in got) == [("a", "s", "accept"), ("a", "s", "replay"), ("b", "s", "fork"), ("b", "s2", "accept"), ("b", "s2", "replay")]
    assert ingest.classify_in_order(spark.createDataFrame([], schema)).count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_order_with_ties_equals_one_after_the_other(spark, seed):
    r = random.Random(seed)
    subs = [("t", f"s{r.randint(0, 2)}", r.randint(1, 5), f"r{r.randint(0, 7)}", f"d{r.randint(0, 1)}", r.randint(0, 25)) for _ in range(90)]
    held, known, want = {}, {}, []
    for t, s, q, rid, d, i in sorted(subs, key=lambda x: (x[5], x[3], x[4], x[1], x[2])):
        if held.get((s, q), rid) != rid:
            outcome = "fork"
        elif rid in known:
            outcome = "replay" if known[rid] == d else "content_substitution"
        else:
            outcome, held[s, q], known[rid] = "accept", rid, d
        want.append((s, q, rid, d, i, outcome))
    df = spark.createDataFrame(subs, "tenant_id string, stream_id string, sequence long, record_id string, wire_digest string, submission_id long").repartition(3)
    assert sorted((x.stream_id, x.sequence, x.record_id, x.wire_digest, x.submission_id, x.outcome) for x in ingest.classify_in_order(df).collect()) == sorted(want)


def several_runs(spark, batches, schema, read, rows, at, idle=True):
    """Output after each run, and the last measures of the state."""
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    out, told = [], None
    for batch in batches:
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(f"{at}/in")
        told = state.drain(read(evidence.parquet_stream(spark, f"{at}/in", schema)), f"{at}/out", f"{at}/checkpoint", idle)
        out.append([tuple(r) for r in spark.read.schema(rows).parquet(f"{at}/out").collect()])
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    return out, told


def test_ids_over_all_streams_of_a_tenant(spark, tmp_path):
    schema = "tenant_id string, record_id string, stream_id string, sequence long, wire_digest string, arrival long"
    batches = [
        [("t", "a", "s", 1, "d", 1), ("t", "a", "s", 1, "d", 2), ("t", "a", "s2", 1, "d", 3), ("t", "b", "s", 2, "d", 4), ("u", "a", "s", 1, "d", 5), (None, "a", "s", 1, "d", 6), ("t", None, "s", 1, "d", 7)],
        [("t", "b", "s", 2, "other", 8), ("t", "a", "s", 1, "d", 9), ("t", "c", "s", 3, "d", 10), ("t", "b", "s9", 2, "d", 11)],
    ]
    out, told = several_runs(spark, batches, schema, lambda s: state.identity_memory(s, buckets=3), state.ID_ROWS, tmp_path)
    assert sorted((x[2], x[3], x[4], x[5]) for x in out[-1]) == [
        (1, "first", None, None), (2, "replay", "s", 1), (3, "content_substitution", "s", 1), (4, "first", None, None), (5, "first", None, None),
        (8, "content_substitution", "s", 2), (9, "replay", "s", 1), (10, "first", None, None), (11, "content_substitution", "s", 2),
    ]
    assert told["numRowsTotal"] == 4  # one entry an id
    assert {(r.key.tenant_id, r.user_map_key.record_id) for r in state.held(spark, f"{tmp_path}/checkpoint", "ids").collect()} == {("t", "a"), ("t", "b"), ("t", "c"), ("u", "a")}


def test_ids_are_forgotten_after_their_time(spark, tmp_path):
    import time

    schema = "tenant_id string, record_id string, stream_id string, sequence long, wire_digest string, arrival long"
    read = lambda s: state.identity_memory(s, buckets=1, ttl=timedelta(seconds=1))
    several_runs(spark, [[("t", "a", "s", 1, "d", 1)]], schema, read, state.ID_ROWS, tmp_path, idle=False)
    time.sleep(2)
    out, _ = several_runs(spark, [[("t", "a", "s", 1, "d", 2)]], schema, read, state.ID_ROWS, tmp_path, idle=False)
    assert sorted((x[2], x[3]) for x in out[-1]) == [(1, "first"), (2, "first")]


def test_silences_open_and_close(spark, tmp_path):
    m = lambda x: T0 + timedelta(minutes=x)
    collectors = spark.createDataFrame([("t", "c", 600), ("t", "d", 3600)], "tenant_id string, collector_id string, expected_cadence_s int")
    batches = [[("t", "c", m(0)), ("t", "c", m(8)), ("t", "c", m(4)), ("t", "d", m(0)), ("t", "unknown", m(0))], [("t", "d", m(50))], [("t", "c", m(70)), ("t", "c", m(66)), ("t", "d", m(90))], [("t", "d", m(300))]]
    out, _ = several_runs(spark, batches, "tenant_id string, collector_id string, source_time timestamp", lambda s: state.silence_stream(s, collectors, "5 minutes"), state.SILENCE_ROWS, tmp_path)
    minutes = lambda rows: [(c, int((a - T0).total_seconds() / 60), None if b is None else int((b - T0).total_seconds() / 60), s) for _, c, a, b, s in rows]
    told = [sorted(map(str, minutes(x))) for x in out[:3]]
    assert told == [[], ["('c', 8, None, 'open')"], ["('c', 70, None, 'open')", "('c', 8, 66, 'closed')", "('c', 8, None, 'open')"]]  # by then it is 85 minutes past
    final = spark.createDataFrame(out[3], state.SILENCE_ROWS)
    assert sorted((r.collector_id, r.gap_start, str(r.gap_end)) for r in state.gaps_now(final).collect()) == [("c", m(8), str(m(66))), ("c", m(70), "None"), ("d", m(90), "None")]


@pytest.mark.parametrize("seed", [1])
def test_silences_over_many_runs_equal_the_batch_form(spark, tmp_path, seed):
    r = random.Random(seed)
    collectors = spark.createDataFrame([("t", f"c{i}", 300 * (i + 1)) for i in range(4)], "tenant_id string, collector_id string, expected_cadence_s int")
    times = sorted(r.randint(0, 20_000) for _ in range(120))
    rows = [("t", f"c{r.randint(0, 3)}", T0 + timedelta(seconds=t)) for t in times]
    batches = [rows[i : i + 40] for i in range(0, 120, 40)]
    for x in batches:
        r.shuffle(x)
    late = [(*batches[1].pop()[:2], T0 + timedelta(seconds=times[39] - 100))]  # out of order over two runs, within the delay
    batches[1] += late
    seen = [x for b in batches for x in b]
    out, _ = several_runs(spark, batches, "tenant_id string, collector_id string, source_time timestamp", lambda s: state.silence_stream(s, collectors, "10 minutes"), state.SILENCE_ROWS, tmp_path)
    clock = max(x[2] for x in seen) - timedelta(minutes=10)
    want = set()
    for i in range(4):
        own = sorted({x[2] for x in seen if x[1] == f"c{i}"})
        for a, b in zip(own, [*own[1:], None]):
            end = b if b is not None and b <= clock else None
            if a <= clock and (end or clock) - a > timedelta(seconds=300 * (i + 1)):
                want.add((f"c{i}", a, end))
    assert {(x.collector_id, x.gap_start, x.gap_end) for x in state.gaps_now(spark.createDataFrame(out[-1], state.SILENCE_ROWS)).collect()} == want


def test_settlement_by_family_is_never_early(spark, tmp_path):
    h = lambda x: T0 + timedelta(hours=x)
    lags = spark.createDataFrame([("f", 3600), ("g", 172800)], "action_family string, lag_s long")
    batches = [[("t", "f", h(1)), ("t", "g", h(1)), ("t", "none", h(1))], [("t", "f", h(24.5))], [("t", "f", h(2)), ("t", "f", h(25.5))], [("t", "f", h(3)), ("t", "g", h(5)), ("t", "g", h(71))], [("t", "g", h(73))], [("t", "g", h(400))]]
    out, _ = several_runs(spark, batches, "tenant_id string, action_family string, authoritative_time timestamp", lambda s: state.settlement_stream(s, lags, "1 day", timedelta(days=2)), state.SETTLED_ROWS, tmp_path)
    days = [sorted((f, (a - T0).days, n, s) for _, f, a, _, n, s in x) for x in out]
    assert days[0] == days[1] == []
    assert days[2] == [("f", 0, 2, "settled")]
    assert days[3] == [("f", 0, 1, "late"), ("f", 0, 2, "settled"), ("f", 1, 2, "settled")]
    assert days[4] == sorted([*days[3], ("g", 0, 2, "settled")])
    assert days[5] == sorted([*days[4], ("g", 2, 1, "settled"), ("g", 3, 1, "settled")])


class _Calls:
    """State held in a processor's test: each call is noted."""

    def __init__(self):
        self.calls, self.map, self.list, self.value = [], {}, [], None

    def __getattr__(self, name):
        def call(*args):
            self.calls.append(name)
            return {
                "exists": lambda: bool(self.map or self.list or self.value), "getValue": lambda k: self.map.get(k), "updateValue": lambda k, v: self.map.update({k: v}), "get": lambda: self.value if self.value else iter(list(self.list)),
                "update": lambda v: setattr(self, "value", v), "put": lambda v: setattr(self, "list", list(v)), "appendList": lambda v: self.list.extend(v), "clear": lambda: setattr(self, "list", []), "listTimers": lambda: [],
            }.get(name, lambda: None if name in ("deleteTimer", "registerTimer") else self)(*(args if name in ("getValue", "updateValue", "update", "put", "appendList") else ()))

        return call


def test_ids_ask_the_state_once_an_id(spark):
    import pandas as pd

    own, ids = state._Ids(0), _Calls()
    own.ids = ids
    rows = pd.DataFrame({"record_id": ["a", "b"] * 50, "stream_id": "s", "sequence": 1, "wire_digest": "d", "arrival": range(100)})
    one = pd.concat(own.handleInputRows(("t", 0), iter([rows]), None))
    assert one.outcome.tolist() == ["first", "first"] + ["replay"] * 98 and ids.calls.count("getValue") == 0 and ids.calls.count("updateValue") == 2
    two = pd.concat(own.handleInputRows(("t", 0), iter([rows.replace("b", "c")]), None))
    assert sorted(two.outcome) == ["first"] + ["replay"] * 99 and ids.calls.count("getValue") == 2 and ids.calls.count("updateValue") == 3


def test_silences_ask_the_state_as_often_for_many_records_as_for_few(spark):
    import pandas as pd

    class Clock:
        ms = 0

        def getCurrentWatermarkInMs(self):
            return self.ms

    calls = []
    for n in (1, 500):
        s, clock = state._Silences(), Clock()
        s.handle, s.now, s.waiting, clock.ms = _Calls(), _Calls(), _Calls(), 0
        at = pd.DataFrame({"source_time": pd.to_datetime([60 * k for k in range(1, n + 1)], unit="s", utc=True), "cadence_s": 90})
        assert list(s.handleInputRows(("t", "c"), iter([at]), clock)) == [] and len(s.waiting.list) == n
        clock.ms = 60_000 * n + 200_000
        out = pd.concat(s.handleExpiredTimer(("t", "c"), clock, None))
        assert out.state.tolist() == ["open"] and s.waiting.list == []
        calls.append(len(s.now.calls) + len(s.waiting.calls))
    assert calls[0] == calls[1] < 12


def test_a_streams_memory_moves_only_what_it_reads(spark, tmp_path):
    schema = "tenant_id string, stream_id string, sequence long, record_id string, record_digest string, source_time timestamp, note string"
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/in")
    plan = evidence.stream_memory(evidence.parquet_stream(spark, f"{tmp_path}/in", schema))._jdf.queryExecution().analyzed().toString()
    moved = plan[plan.index("FlatMapGroupsInPandasWithState") :].split("\n")[1:]
    assert "note" not in "\n".join(moved[:2]) and "Project" in "\n".join(moved[:3]), plan


def test_a_batch_meets_the_ledger_once(spark, registries, tmp_path, monkeypatch):
    kept, keep = [], ingestion.keep

    def told(df, path):
        kept.append(path.rsplit("/", 1)[1])
        return keep(df, path)

    monkeypatch.setattr(ingestion, "keep", told)
    rows = [(1, wire(1), True), (2, wire(1), True), (3, wire(8, sequence=1), True), (4, wire(2, note='": 1.5,2e3,[7.5'), True), (5, wire(3)[:-1] + ', "x" :\n-2.5}', True)]
    batch = ingestion.checked(spark.createDataFrame(rows, "submission_id long, wire string, sig_ok boolean"), *registries)
    ingestion.write_batch(batch, 0, str(tmp_path))
    assert kept == ["checked", "against"]  # what both sides of the ledger's answer are read from
    assert {r.submission_id for r in ingestion.committed(spark, str(tmp_path), "ledger").collect()} == {1, 4}
    found = {r.submission_id: list(r.codes) for r in ingestion.committed(spark, str(tmp_path), "refusals").collect()}
    assert found == {2: [], 5: ["record.envelope.member_unknown", "record.number.float"]}
