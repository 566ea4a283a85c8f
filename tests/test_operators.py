"""Branches and properties of the operators on hand-made rows."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest

from provenix.functions import intervals
from provenix.operators import attest, chain, coverage, ingest, population, qualify, reconcile, validate
from provenix.plans import verify
from provenix.sources import ledger

T0 = datetime(2024, 1, 1)
S = ("t", "b")


def test_reconciliation_branches(spark):
    ids = ["match", "none", "evidence", "twin1", "twin2", "two_receipts", "two_confirmations", "family", "system", "span1", "span2", "family_by_confirmation", "two_proposals"]
    items = spark.createDataFrame([(*S, "p", i, "f", "erp") for i in ids], "tenant_id string, boundary_ref string, population_ref string, destination_record_id string, action_family string, destination_system string")
    receipts = [("match", "a1"), ("evidence", "a2"), ("two_receipts", "a3"), ("two_receipts", "a4"), ("family", "a5"), ("system", "a6"), ("span1", "a7"), ("span2", "a7"), ("two_proposals", "a9"), ("elsewhere", "a1")]
    receipts = spark.createDataFrame([(*S, d, a, f"r{i}") for i, (d, a) in enumerate(receipts)], "tenant_id string, boundary_ref string, destination_record_id string, action_id string, record_id string")
    conf = [("match", "a1", "erp", "1"), ("twin1", "x1", "erp", "same"), ("twin2", "x2", "erp", "same"), ("two_confirmations", "x3", "erp", "2"), ("two_confirmations", "x4", "erp", "3"), ("system", "a6", "crm", "4"), ("family_by_confirmation", "a8", "erp", "5"), ("two_proposals", "a9", "erp", "6")]
    conf = spark.createDataFrame([(*S, d, a, s, c, f"c{i}") for i, (d, a, s, c) in enumerate(conf)], "tenant_id string, boundary_ref string, destination_record_id string, action_id string, destination_system string, destination_record_digest string, record_id string")
    props = spark.createDataFrame([(*S, a, f) for a, f in [("a1", "f"), ("a5", "other"), ("a8", "other"), ("a9", "f"), ("a9", "f"), ("a2", "f")]], "tenant_id string, boundary_ref string, action_id string, action_family string")
    got = {r.destination_record_id: (r.status, r.action_id, r.confirmation_record_id) for r in reconcile.classify(items, receipts, conf, props).collect()}
    assert got == {
        "match": ("matched", "a1", "c0"), "none": ("unmatched_without_evidence", None, None), "evidence": ("unmatched_with_evidence", "a2", None), "twin1": ("duplicate", None, "c1"), "twin2": ("duplicate", None, "c2"),
        "two_receipts": ("ambiguous", None, None), "two_confirmations": ("ambiguous", None, None), "family": ("out_of_scope", "a5", None), "system": ("out_of_scope", "a6", None), "span1": ("ambiguous", None, None), "span2": ("ambiguous", None, None),
        "family_by_confirmation": ("out_of_scope", None, None), "two_proposals": ("ambiguous", None, None),
    }


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_gaps_and_cover_tile_every_window(spark, seed):
    r = random.Random(seed)
    end = T0 + timedelta(hours=100)
    gaps = [(f"w{r.randint(0, 5)}", T0 + timedelta(hours=a), T0 + timedelta(hours=min(100, a + r.randint(1, 9)))) for a in (r.randint(0, 99) for _ in range(40))]
    windows = spark.createDataFrame([(f"w{i}", T0, end) for i in range(8)], "w string, window_start timestamp, window_end timestamp")
    df = spark.createDataFrame(gaps, "w string, gap_start timestamp, gap_end timestamp")
    merged = intervals.merge(df, ["w"])
    covered = intervals.complement(windows, merged, ["w"])
    assert all(x.tiled for x in intervals.partition_audit(windows, merged, covered, ["w"]).collect())
    hours = {(w, h) for w, a, b in gaps for h in range(int((a - T0).total_seconds() // 3600), int((b - T0).total_seconds() // 3600))}
    assert {(m.w, h) for m in merged.collect() for h in range(int((m.gap_start - T0).total_seconds() // 3600), int((m.gap_end - T0).total_seconds() // 3600))} == hours
    points = spark.createDataFrame([(f"w{i}", h, T0 + timedelta(hours=h)) for i in range(8) for h in range(100)], "w string, h int, at timestamp")
    assert {(p.w, p.h) for p in intervals.inside(points, merged, ["w"], "at").collect()} == hours


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_arrival_order_equals_one_after_the_other(spark, seed):
    r = random.Random(seed)
    subs = [("t", f"s{r.randint(0, 2)}", r.randint(1, 6), f"r{r.randint(0, 9)}", f"d{r.randint(0, 1)}", i) for i in range(80)]
    held, known, want = {}, {}, {}
    for t, s, q, rid, d, i in subs:
        if held.get((s, q), rid) != rid:
            want[i] = "fork"
        elif rid in known:
            want[i] = "replay" if known[rid] == d else "content_substitution"
        else:
            want[i], held[s, q], known[rid] = "accept", rid, d
    df = spark.createDataFrame(subs, "tenant_id string, stream_id string, sequence int, record_id string, wire_digest string, submission_id int")
    assert {x.submission_id: x.outcome for x in ingest.classify_in_order(df).collect()} == want


def test_chain(spark):
    cols = "tenant_id string, stream_id string, sequence long, record_id string, record_digest string, prev_digest string, key_id string, has_continuity boolean, sig_ok boolean, source_time timestamp"
    row = lambda s, q, prev, key="k", cont=False, sig=True: ("t", s, q, f"{s}{q}", f"d{s}{q}", prev, key, cont, sig, T0 + timedelta(minutes=q))
    rows = [row("good", 1, None), row("good", 2, "dgood1", "k2", True), row("hole", 1, None), row("hole", 4, "dhole3"), row("hole", 5, "dhole4"), row("late", 2, "x"), row("bad", 1, None), row("bad", 2, "dbad1", "k2"), row("first", 1, "x"), row("unsigned", 1, None, sig=False)]
    df = spark.createDataFrame(rows, cols)
    linked = chain.links(df)
    assert {x.record_id: list(x.codes) for x in linked.collect() if x.codes} == {"hole4": ["sequence_gap"], "late2": ["sequence_gap"], "bad2": ["key_discontinuity"], "first1": ["chain_link_broken"], "unsigned1": ["signature_invalid"]}
    twice = df.unionByName(spark.createDataFrame([("t", "good", 2, "other", "e", "dgood1", "k2", True, True, T0)], cols)).unionByName(df.where("stream_id = 'hole'"))
    assert [(x.stream_id, x.sequence) for x in chain.forks(twice).collect()] == [("good", 2)]
    prefix = {x.stream_id: (x.valid_through, x.fatal, x.last_digest) for x in chain.valid_prefix(df, linked, chain.forks(twice)).collect()}
    assert prefix["hole"] == (1, False, "dhole1") and prefix["good"] == (0, True, None) and prefix["bad"] == (1, False, "dbad1") and prefix["late"] == (0, False, None)
    gap = {x.stream_id: (x.last_known, x.at) for x in chain.break_gaps(df, linked).collect()}
    assert gap == {"hole": (1, 4), "bad": (1, 2)}
    assert {x.sequence: x.duplicate_count for x in chain.settled(twice).where("stream_id = 'hole'").collect()} == {1: 2, 4: 2, 5: 2}


def test_classes_in_force(spark):
    q = lambda ref, c, at, rec=None: (ref, "t", "f", "d", c, c < "c4", T0 + timedelta(days=at), T0 + timedelta(days=at if rec is None else rec))
    hist = spark.createDataFrame([q("strong", "c1", 0), q("weak", "c4", 10), q("backdated", "c1", 9, 40), q("same_instant", "c2", 20)], "qualification_ref string, tenant_id string, action_family string, destination_system string, assigned_class string, enumeration_capable boolean, qualified_at timestamp, recorded_at timestamp")
    w = lambda ref, a, b: ("t", "f", "d", ref, T0 + timedelta(days=a), T0 + timedelta(days=b), "c1")
    wins = spark.createDataFrame([w("before", 0, 5), w("down", 5, 15), w("after", 11, 20), w("up", 20, 30)], "tenant_id string, action_family string, destination_system string, window_ref string, window_start timestamp, window_end timestamp, claimed_class string")
    got = {x.window_ref: (x.governing_ref, x.class_in_force, x.admissible_level) for x in qualify.in_force(wins, hist).collect()}
    assert got == {"before": (None, None, None), "down": ("strong", "c4", "observed"), "after": ("weak", "c4", "observed"), "up": ("weak", "c4", "observed")}
    assert {x.window_ref: x.verdict for x in qualify.claimability(wins, hist).collect()} == {"before": "unqualified window", "down": "not qualified", "after": "not qualified", "up": "not qualified"}
    assert [x.months for x in spark.createDataFrame([("P1Y6M",), ("P3M",), ("PT1H",), ("P",)], "c string").select(qualify.months_of("c").alias("months")).collect()] == [18, 3, None, None]


def test_ratio_text(spark):
    df = spark.createDataFrame([(2, 3), (0, 5), (5, 5), (1, 0)], "n long, d long")
    from pyspark.sql import functions as F

    assert [r.x for r in df.select(coverage.four_places(F.col("n"), F.col("d")).alias("x")).collect()] == ["0.6666", "0.0000", "1.0000", None]


def test_lifecycle_instants(spark):
    a = spark.createDataFrame([("t", x, T0, T0 + timedelta(days=10)) for x in ("plain", "revoked", "superseded", "later")], "tenant_id string, attestation_id string, validity_from timestamp, validity_until timestamp")
    r = spark.createDataFrame([("t", "revoked", T0 + timedelta(days=5), 1, None), ("t", "superseded", T0 + timedelta(days=5), 1, "n"), ("t", "later", T0 + timedelta(days=6), 1, None)], "tenant_id string, attestation_id string, effective_at timestamp, sequence long, superseding_attestation_id string")
    status = lambda at: {x.attestation_id: x.status for x in attest.lifecycle(a, r, str(at)).collect()}
    assert status(T0 + timedelta(days=5)) == {"plain": "valid", "revoked": "revoked", "superseded": "superseded", "later": "valid"}
    assert status(T0 + timedelta(days=10))["plain"] == "expired" and status(T0 - timedelta(seconds=1))["plain"] == "not_yet_valid"


def test_population_checks(spark):
    p = spark.createDataFrame([("a", ["x", "y"], 2), ("b", None, 1), ("c", ["x"], 2), ("d", ["x", ""], 2), ("e", ["x", "x"], 2)], "population_ref string, record_identifiers array<string>, signed_count long")
    good, bad = population.integrity(p)
    assert [x.population_ref for x in good.collect()] == ["a"]
    assert {x.population_ref: x.reason for x in bad.collect()} == {"b": "digest_only", "c": "count_differs", "d": "empty_identifier", "e": "repeated_identifier"}


def test_validation_and_ledger(spark, tmp_path):
    ok = '{"body":{"action_family":"f","action_id":"a","parameters_digest":"sha256:' + "0" * 64 + '","proposed_at":"2024-01-01T00:00:00.000Z","purpose":"p","risk_class":"r","target_ref":"t","tool":"x"},"boundary_ref":"b","clocks":{"source_time":"2024-01-01T00:00:00.000Z"},"prev_digest":null,"record_id":"0190a000-0000-7000-8000-000000000001","record_type":"ActionProposal","schema_version":"1.0.0","sequence":1,"signature":{},"source":{},"stream_id":"s","tenant_id":"t"}'
    bad = [ok.replace('"sequence":1', '"sequence":0'), ok.replace("1.0.0", "1.0"), ok.replace('"source_time"', '"ingest_time"'), ok[:-1], ok.replace("ActionProposal", "Nothing"), ok.replace('"a"', "1.5")]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "x.json").write_text("\n".join([ok, *bad]))
    good, refused = ledger.read_lines(spark, str(tmp_path / "in"))
    assert [r.wire for r in good.collect()] == [ok]
    wanted = ["record.sequence.range", "record.schema_version.invalid", "record.clocks.hosted_member", "record.json.malformed", "record.type.unknown", "record.number.float"]
    found = {r.wire: r.errors for r in refused.collect()}
    assert [x if x in found[b] else found[b] for b, x in zip(bad, wanted)] == wanted
    assert [r.action_family for r in ledger.typed_view(good, "ActionProposal").collect()] == ["f"]
    rows = validate.project(good)
    ledger.append(rows, str(tmp_path / "ledger"))
    assert ledger.ledger(spark, str(tmp_path / "ledger")).count() == 1
    stored = good.select(*(c.alias(k) for k, c in validate.projection().items()), "wire").withColumn("sequence", validate.F.lit(9).cast("long"))
    assert [(r["column"], r.stored, r.derived) for r in validate.drift(stored).collect()] == [("sequence", "9", "1")]
    assert {r.sequence for r in validate.rebuild(stored).collect()} == {9}


def test_bundles(spark):
    df = spark.createDataFrame([("b", '{"z":1}'), ("b", '{"a":1}'), ("c", "{}")], "bundle_id string, wire string")
    assert {r.bundle_id: r.document for r in verify.export(df).collect()} == {"b": '[{"a":1},{"z":1}]', "c": "[{}]"}
    items = spark.createDataFrame([("b", 0, "a", "AttestationWindow"), ("b", 1, "b", "AssuranceBoundary"), ("c", 0, "b", "AttestationWindow"), ("c", 1, "a", "AttestationWindow")], "bundle_id string, pos int, wire string, record_type string")
    assert {r.bundle_id: r.well_formed for r in verify.read_audit(items).collect()} == {"b": True, "c": False}


def test_checks_can_be_added(spark):
    from pyspark.sql import functions as F

    b = spark.createDataFrame([("x", 1), ("y", 0)], "bundle_id string, matched int")
    for s in reconcile.STATUSES[1:]:
        b = b.withColumn(s, F.lit(0))
    b = b.withColumns({"signed_count": F.col("matched"), "coverage_ratio": F.lit(None).cast("string"), "claimed_class": F.lit("c1"), "claimed_level": F.lit("reconciled"), "capped_by_class": F.lit(False), "as_of": F.lit(T0), "validity_from": F.lit(T0), "validity_until": F.lit(T0 + timedelta(days=1))})
    verify.register_check("empty", lambda d: d.where("signed_count = 0").select("bundle_id", F.lit(1).alias("ord"), F.lit("empty").alias("code")))
    try:
        assert {r.bundle_id: (r.verdict, r.code) for r in verify.verdicts(b).collect()} == {"x": ("verified", None), "y": ("refused", "empty")}
    finally:
        verify._checks.clear()


def test_every_kind_of_bad_record(spark):
    """Cases that null-blind checks let through."""
    body = '"action_family":"f","action_id":"a","parameters_digest":"sha256:' + "0" * 64 + '","proposed_at":"2024-01-01T00:00:00.000Z","purpose":"p","risk_class":"r","target_ref":"t","tool":"x"'
    ok = '{"body":{%s},"boundary_ref":"b","clocks":{"source_time":"2024-01-01T00:00:00.000Z"},"prev_digest":null,"record_id":"0190a000-0000-7000-8000-000000000001","record_type":"ActionProposal","schema_version":"1.0.0-rc.1","sequence":1,"signature":{},"source":{},"stream_id":"s","tenant_id":"t"}' % body
    empty = ok.replace(body, "").replace("ActionProposal", "HumanReview")
    cases = [
        (ok, ""), (empty, "record.body.member_missing"), (ok.replace('"sequence":1', '"sequence":1234567890123456789'), "record.sequence.range"), (ok.replace('"sequence":1', '"sequence":"1"'), "record.sequence.range"),
        (ok.replace('"0190a000-0000-7000-8000-000000000001"', "null"), "record.id.invalid"), (ok.replace('"ActionProposal"', "null"), "record.type.unknown"), (ok.replace('"source":{}', '"source":{"x":1.5}'), "record.number.float"),
        (ok.replace('"source":{}', '"source":{"x":"1.5, 2e5"}'), ""), (ok.replace('"tenant_id":"t"', '"tenant_id":"t","tenant_id":"t"'), "record.json.malformed"), ("[]", "record.json.malformed"), ("", "record.json.malformed"), (None, "record.json.malformed"),
        (ok.replace('"purpose":"p"', '"purpose":null'), "record.body.member_invalid"), (ok.replace('"tool":"x"', '"tool":7'), "record.body.member_invalid"),
    ]
    df = spark.createDataFrame([(i, w) for i, (w, _) in enumerate(cases)], "i int, wire string")
    assert {r.i: ",".join(r.errors) for r in validate.report(df).collect()} == {i: e for i, (_, e) in enumerate(cases)}


def test_response_binding_and_capabilities(spark):
    from pyspark.sql import functions as F

    from provenix.operators import binding

    end = T0 + timedelta(days=1)
    asked = spark.createDataFrame([(x, "f", "d", T0, end, "p", 60) for x in ("good", "empty", "none", "clock")], "request_id string, action_family string, destination_system string, window_start timestamp, window_end timestamp, parameters string, settlement_lag_s int")
    row = lambda x, n, lo, hi, at: (x, "f", "d", T0, end, "p", T0, end, n, n, lo, hi, at, False, True, None)
    got = spark.createDataFrame([row("good", 2, T0, T0 + timedelta(hours=1), T0 + timedelta(hours=1)), row("empty", 0, None, None, T0), row("clock", 1, T0, T0, end)], "request_id string, action_family string, destination_system string, window_start timestamp, window_end timestamp, echoed_parameters string, echoed_start timestamp, echoed_end timestamp, count long, n_identifiers long, ts_min timestamp, ts_max timestamp, authoritative_time timestamp, result_cap_hit boolean, pagination_complete boolean, observed_lag_ms long")
    assert {r.request_id: list(r.codes) for r in binding.response_binding(asked, got).collect()} == {"good": [], "empty": ["time_of_empty_population"], "none": ["unanswered"], "clock": ["time_is_not_the_newest_record"]}
    c = spark.createDataFrame([(True, True, True, 5, "enumerated", "own"), (False, True, True, 5, "enumeration_unavailable", "own"), (True, True, False, None, "enumerated", "own")], "enumeration boolean, confirmation boolean, authoritative_time boolean, settlement_lag_s int, attribution_surface string, confirmation_access string")
    assert [r.supports_window_claim for r in binding.capability_audit(c).orderBy(F.monotonically_increasing_id()).collect()] == [True, False, False]


def test_stream_positions(spark, tmp_path):
    from provenix.streaming import evidence as streaming

    rec = lambda q, rid, d="d": ("t", "s", q, rid, d, T0 + timedelta(seconds=q % 1000))
    cols = "tenant_id string, stream_id string, sequence long, record_id string, record_digest string, source_time timestamp"
    far = 2**53 - 1
    files = [[rec(1, "a"), rec(2, "b"), rec(5, "e")], [rec(q, f"r{q}") for q in range(6, 706)] + [rec(1, "a"), rec(2, "other")], [rec(3, "c"), rec(3, "c"), rec(far, "z"), rec(1, "a", "changed")]]
    for k, rows in enumerate(files):  # one micro-batch each
        spark.createDataFrame(rows, cols).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        streaming.positions_stream(streaming.parquet_stream(spark, str(tmp_path / "in"), cols), str(tmp_path / "ledger"), str(tmp_path / "out"), str(tmp_path / "checkpoint"))
    got = sorted((r.sequence, r.record_id, r.record_digest, r.outcome) for r in spark.read.parquet(str(tmp_path / "out")).where("outcome <> 'gap' and (sequence < 6 or sequence > 705)").collect())
    assert got == sorted([
        (1, "a", "d", "accept"), (2, "b", "d", "accept"), (5, "e", "d", "accept_after_hole"), (1, "a", "d", "replay"), (2, "other", "d", "fork"), (3, "c", "d", "fills_hole"), (3, "c", "d", "replay"), (far, "z", "d", "accept_after_hole"), (1, "a", "changed", "fork"),
    ])


def test_a_text_is_parsed_once_however_many_checks_read_it(spark):
    plan = validate.report(spark.createDataFrame([("{}",)], "wire string"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parseJson") == 1, plan.count("parseJson")


def test_split_judges_each_text_once(spark):
    good, bad = validate.split(spark.createDataFrame([("{}",), (None,), ("x",)], "wire string"))
    assert good.count() == 0 and bad.count() == 3
    assert all("parseJson" not in df._jdf.queryExecution().optimizedPlan().toString() for df in (good, bad))


def test_located_counts_meet_no_action_with_a_gap(spark):
    r = random.Random(8)
    t = lambda: r.choice([T0, datetime(1960, 1, 1)]) + timedelta(minutes=r.randint(0, 600), microseconds=r.randint(0, 1))
    acts = [(r.choice("ab"), t()) for _ in range(400)] + [("a", None), (None, T0), ("b", datetime(9999, 12, 31, 23, 59, 59, 999999))]
    gaps = [(r.choice("abc"), i, t(), r.choice([None, t(), T0 + timedelta(days=900)])) for i in range(300)] + [("a", 900, None, T0), (None, 901, T0, None), ("a", 902, acts[0][1], acts[0][1])]
    df = coverage.located_counts(spark.createDataFrame(acts, "k string, occurred_at timestamp"), spark.createDataFrame(gaps, "k string, gap_id long, gap_start timestamp, gap_end timestamp"), ["k"])
    want = {g: sum(k is not None and s is not None and k == a and o is not None and o >= s and (e is None or o < e) for a, o in acts) for k, g, s, e in gaps}
    assert {x.gap_id: x.n_located for x in df.collect()} == want and max(want.values()) > 100
    # a join of actions with gaps puts out a row for each pair
    assert "occurred_at < gap_end" not in (plan := df._jdf.queryExecution().optimizedPlan().toString()).replace("#", " #") and "_block" not in plan


def test_backdated_upgrades_by_running_minima(spark):
    r = random.Random(9)
    day = lambda: r.choice([None, *(T0 + timedelta(days=d) for d in range(6))])
    rows = [(r.choice(["t", "u", None]), "f", "erp", r.choice([None, *(f"q{k}" for k in range(40))]), r.choice(["c1", "c2", "c3", "c9", None]), day(), day(), i) for i in range(150)]
    df = qualify.without_backdated_upgrades(spark.createDataFrame(rows, "tenant_id string, action_family string, destination_system string, qualification_ref string, assigned_class string, qualified_at timestamp, recorded_at timestamp, i int"))

    def beats(a, b):
        return None not in (*a[:7], *b[:7]) and a[:3] == b[:3] and a[4] < b[4] and b[5] >= a[5] and b[6] < a[6] and b[3] != a[3]

    want = {a[7] for a in rows if not any(beats(a, b) for b in rows)}
    assert {x.i for x in df.collect()} == want and 0 < len(want) < len(rows)
    assert df.columns[-1] == "i"
    # rows of a key are not compared pair by pair: only a repeated reference's are
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" in plan
