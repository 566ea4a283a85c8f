"""Durations, instants, time blocks, key continuity, digests of identifiers, scoped gaps, withheld ratios: each rule on rows of its own."""

from __future__ import annotations

import hashlib
import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from provenix.functions import durations, instants, intervals
from provenix.operators import attest, chain, coverage, population, validate
from provenix.plans import verify
from provenix.sources import ledger

T0 = datetime(2024, 1, 1)


def test_durations(spark):
    at = datetime(2026, 8, 18, 12)
    cases = {
        "PT1H": datetime(2026, 8, 18, 13), "P1D": datetime(2026, 8, 19, 12), "P1DT2H30M15.5S": datetime(2026, 8, 19, 14, 30, 15, 500_000), "P2W": datetime(2026, 9, 1, 12), "P1M": datetime(2026, 9, 18, 12), "P1Y": datetime(2027, 8, 18, 12),
        "PT0,0000019S": datetime(2026, 8, 18, 12, 0, 0, 1), "P1Y18M": datetime(2029, 2, 18, 12), "P0Y1D": datetime(2026, 8, 19, 12),
    } | dict.fromkeys(["", "P", "PT", "P0D", "PT0S", "P-1D", "1H", "P1W1D", "P1.5M", "P1DT", "P1W0D", "P1D\n", "p1D", "PT0.0000001S", "P99999999999999999999999999999999999999999999Y", "P9000Y", "P9999999D"])
    got = spark.createDataFrame([(t, at) for t in cases] + [(None, at)], "t string, at timestamp").select("t", durations.add(F.col("at"), F.col("t")).alias("due")).collect()
    assert {r.t: r.due for r in got} == cases | {None: None}
    clamp = spark.createDataFrame([(datetime(2027, 1, 31, 12),)], "at timestamp").select(durations.add(F.col("at"), F.lit("P1M")).alias("x")).first().x
    assert clamp == datetime(2027, 2, 28, 12)


def test_instants(spark):
    good = ["0001-01-01T00:00:00.000Z", "1969-12-31T23:59:59.999999999Z", "2024-02-29T00:00:00.000000001Z", "2024-02-29T00:00:00.000000002Z", "2024-02-29T05:30:00.000000002Z", "2262-04-12T00:00:00.000Z", "9999-12-31T23:59:59.999Z"]
    bad = {
        "2024-01-01T00:00:60.000Z": "leap_second", "2024-01-01T00:00:00.00Z": "not_rfc3339", "2024-01-01T00:00:00.0000000001Z": "finer_than_nanoseconds", "2023-02-29T00:00:00.000Z": "invalid_date", "2024-01-01T24:00:00.000Z": "invalid_time", "2024-01-01T00:00:00.000+24:00": "invalid_offset",
        "2024-01-01 00:00:00.000Z": "not_rfc3339", "2024-01-01T00:00:00.000": "not_rfc3339", "0000-01-01T00:00:00.000Z": "invalid_date", "2024-01-01T00:00:00.000Z\n": "not_rfc3339", None: "not_rfc3339", "": "not_rfc3339",
    }
    df = spark.createDataFrame([(t,) for t in [*good, *bad]], "t string").select("t", instants.refusal(F.col("t")).alias("why"), instants.instant(F.col("t")).alias("i"))
    rows = {r.t: r for r in df.collect()}
    assert {t: rows[t].why for t in bad} == bad and all(rows[t].i is None for t in bad)
    assert all(rows[t].why is None for t in good) and [rows[t].i for t in good] == sorted(rows[t].i for t in good)
    same = spark.createDataFrame([("2024-02-29T00:00:00.000000001Z", "2024-02-29T05:30:00.000000001+05:30", "2024-02-28T18:00:00.000000001-06:00")], "a string, b string, c string").select(*(instants.instant(F.col(c)).alias(c) for c in "abc")).first()
    assert same.a == same.b == same.c and same.a.ns == 1


def test_lifecycle_to_the_nanosecond(spark):
    at = lambda n: f"2024-01-01T00:00:00.{n:09d}Z"
    attested = spark.createDataFrame([("t", k, at(a), at(b)) for k, a, b in [("valid", 1, 9), ("early", 6, 9), ("late", 1, 5), ("revoked", 1, 9), ("pending", 1, 9), ("superseded", 1, 9), ("odd", 1, 9), ("odd_and_revoked", 1, 9), ("empty", 5, 5)]], "tenant_id string, attestation_id string, validity_from string, validity_until string")
    moves = [("revoked", at(5), None, 1), ("pending", at(6), None, 1), ("superseded", at(4), None, 1), ("superseded", at(5), "next", 2), ("odd", "2024-01-01T00:00:60.000Z", None, 1), ("odd_and_revoked", "x", None, 1), ("odd_and_revoked", at(2), None, 2)]
    got = instants.lifecycle(attested, spark.createDataFrame([("t", *m) for m in moves], "tenant_id string, attestation_id string, effective_at string, superseding_attestation_id string, sequence int"), at(5)).collect()
    assert {r.attestation_id: r.status for r in got} == {"valid": "valid", "early": "not_yet_valid", "late": "expired", "revoked": "revoked", "pending": "valid", "superseded": "superseded", "odd": "unchecked", "odd_and_revoked": "revoked", "empty": "empty_interval"}


def test_time_blocks(spark):
    r = random.Random(7)
    long = [(T0 - timedelta(days=2000), T0), (T0, None), (T0 - timedelta(days=40_000), T0 - timedelta(days=39_000)), (T0, T0), (T0 + timedelta(seconds=1), T0)]
    short = [(a, a + timedelta(microseconds=r.choice([1, 59_000_000, 61_000_000, 3_600_000_000, 10**11, 10**13]))) for a in (T0 + timedelta(seconds=r.randint(-10**6, 10**6)) for _ in range(60))]
    gaps = [(i % 3, i, a, b) for i, (a, b) in enumerate(long + short)]
    points = [(i % 3, i, T0 + timedelta(seconds=r.randint(-10**6, 10**6), microseconds=r.randint(0, 1))) for i in range(400)] + [(0, 900, T0), (1, 901, T0), (2, 902, T0), (0, 903, None)]
    points += [(k, 1000 + i, x) for i, (k, _, a, b) in enumerate(gaps) for x in (a, b) if x]
    g = spark.createDataFrame(gaps, "k int, gap_id int, gap_start timestamp, gap_end timestamp")
    p = spark.createDataFrame(points, "k int, id int, occurred_at timestamp")
    holds = lambda x, a, b: x is not None and x >= a and (b is None or x < b)
    want = {i: sum(1 for k2, _, x in points if k2 == k and holds(x, a, b)) for k, i, a, b in gaps}
    assert {x.gap_id: x.n_located for x in coverage.located_counts(p, g, ["k"]).collect()} == want
    inside = intervals.inside(p, g, ["k"], "occurred_at", merged=False)
    assert inside.columns == p.columns
    assert sorted(x.id for x in inside.collect()) == sorted(i for k, i, x in points if any(k2 == k and holds(x, a, b) for k2, _, a, b in gaps))
    per = {x.gap_id: x.n for x in intervals.blocks(g, "gap_start", "gap_end").groupBy("gap_id").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert max(per.values()) <= 14 * intervals.LEVELS and per[0] <= 98 and 3 not in per and 4 not in per


def test_key_continuity(spark):
    rows = [("t", "s", i, f"r{i}", key) for i, key in [(1, "a"), (2, "a"), (3, "b"), (4, "b"), (5, "c"), (6, "d"), (7, "e"), (8, "f"), (9, "g"), (10, "h"), (11, "i"), (13, "z")]] + [("t", "new", 1, "n1", "a")]
    records = spark.createDataFrame(rows, "tenant_id string, stream_id string, sequence long, record_id string, key_id string")
    say = lambda rid, old, new, **k: ("t", rid, k.get("alg", "ed25519"), old, new, k.get("public", f"pk-{new}"), k.get("tenant", "t"), k.get("stream", "s"), k.get("extra", False), k.get("ok", True))
    said = [say("n1", "x", "a"), say("r2", "a", "a"), say("r3", "a", "b"), say("r6", "x", "y"), say("r7", "d", "e", tenant="u", stream="new"), say("r8", "e", "f", ok=False), say("r9", "f", "g", public="other"), say("r10", "g", "h", alg="rsa"), say("r11", "h", "i", extra=True), say("r13", "i", "z", ok=False)]
    statements = spark.createDataFrame(said, "tenant_id string, record_id string, c_alg string, c_predecessor_key_id string, c_new_key_id string, c_new_public_key string, c_tenant_id string, c_stream_id string, c_extra boolean, c_sig_ok boolean")
    keys = spark.createDataFrame([("t", k, f"pk-{k}") for k in "abcdefghiz"], "tenant_id string, key_id string, public_key string")
    found = chain.continuity(records, statements, keys)
    assert {r.record_id: list(r.codes) for r in found.collect()} == {
        "n1": ["continuity_on_first_record"], "r2": ["continuity_without_rotation"], "r5": ["rotation_without_continuity"], "r6": ["wrong_predecessor", "wrong_new_key", "wrong_public_key"],
        "r7": ["wrong_tenant", "wrong_stream"], "r8": ["not_signed_by_predecessor"], "r9": ["wrong_public_key"], "r10": ["algorithm_unsupported"], "r11": ["members_unknown_or_missing"],
    }
    assert {r.record_id for r in chain.with_continuity(records, found).where("not has_continuity").collect()} == {"n1", "r2", "r5", "r6", "r7", "r8", "r9", "r10", "r11"}


def test_identifier_digest(spark):
    ids = [f"id{i}" for i in range(500)] + ["id3"]
    scope = ("t", "b")
    items = spark.createDataFrame([(*scope, "p", i) for i in ids] + [(*scope, "q", i) for i in reversed(ids)] + [(*scope, "r", "one")], "tenant_id string, boundary_ref string, population_ref string, destination_record_id string").repartition(5)
    chunks = {}
    for h in sorted(hashlib.sha256(i.encode()).hexdigest() for i in ids):
        chunks.setdefault(h[:4], []).append(h)
    want = "sha256:" + hashlib.sha256("".join(hashlib.sha256("".join(v).encode()).hexdigest() for _, v in sorted(chunks.items())).encode()).hexdigest()
    got = {r.population_ref: (r["count"], r.identifier_digest) for r in population.identifier_digest(items).collect()}
    assert got["p"] == got["q"] == (501, want) and got["r"][1] != want
    heads = spark.createDataFrame([(*scope, "p", 501, want), (*scope, "q", 500, want), (*scope, "r", 1, want), (*scope, "s", 1, want), (*scope, "inline", 1, None)], "tenant_id string, boundary_ref string, population_ref string, signed_count long, identifier_digest string")
    assert {r.population_ref: r.state for r in population.digest_audit(heads, items).collect()} == {"p": "confirmed", "q": "count_differs", "r": "digest_differs", "s": "not_enumerated"}


def test_gaps_of_another_scope_are_omitted(spark):
    gap = lambda b, scope: (b, T0, T0 + timedelta(hours=1), "clock_skew", scope)
    schema = "bundle_id string, gap_start timestamp, gap_end timestamp, cause string, affected_scope string"
    signed = spark.createDataFrame([gap("turned", '{"a":[1,2],"b":{"c":1,"d":null}}'), gap("list", '{"a":[1,2]}'), gap("other", '{"a":1}'), gap("text", "plain"), gap("none", None), gap("lacking", '{"a":1}')], schema)
    announced = spark.createDataFrame([gap("turned", '{ "b": {"d":null, "c":1}, "a": [1, 2] }'), gap("list", '{"a":[2,1]}'), gap("other", '{"a":2}'), gap("text", "plain"), gap("none", None)], schema)
    assert sorted(r.bundle_id for r in verify.gap_omission(announced, signed).collect()) == ["lacking", "list", "other"]


def test_ratios_that_are_withheld(spark):
    rows = [("due", "c1", None, False), ("class", "c4", None, False), ("cut", "c2", None, True), ("right", "c3", "0.5000", False), ("of_cut", "c3", "0.5000", True)]
    b = spark.createDataFrame([(i, c, r, t, 5, 10, 0) for i, c, r, t in rows] + [("empty", "c1", None, False, 0, 2, 2)], "bundle_id string, claimed_class string, coverage_ratio string, truncated boolean, matched long, signed_count long, out_of_scope long")
    assert sorted((r.bundle_id, r.code) for r in verify.ratio_recheck(b).collect()) == [("due", "ratio_withheld"), ("of_cut", "ratio_of_truncated_population")]


def test_successors_keep_their_scope(spark):
    hour = lambda n: T0 + timedelta(hours=n)
    attested = spark.createDataFrame([("t", "a", "b1", hour(0), hour(1)), ("t", "same", "b1", hour(0), hour(1)), ("u", "tenant", "b1", hour(0), hour(1)), ("t", "boundary", "b2", hour(0), hour(1)), ("t", "window", "b1", hour(0), hour(2))], "tenant_id string, attestation_id string, boundary_ref string, window_start timestamp, window_end timestamp")
    for successor, want in (("same", []), ("tenant", ["successor_of_other_tenant"]), ("boundary", ["successor_of_other_boundary"]), ("window", ["successor_of_other_window"]), ("a", ["supersedes_itself"])):
        moves = spark.createDataFrame([("t", "r", "a", successor, "late_evidence")], "tenant_id string, revocation_id string, attestation_id string, superseding_attestation_id string, reason string")
        assert [r.codes for r in attest.transition_audit(attested, moves).collect()] == want


def test_views_have_the_members_that_validation_asks_for(spark):
    for kind in validate.BODIES:
        names = [f.split()[0] for f in ledger.body_schema(kind).split(", ")]
        assert {m[0] for m in validate.members_of(kind)} <= set(names)
    body = '{"attestation_ref":"a","reason":"error","issuer":{"x":1},"effective_at":"2024-01-01T00:00:00.000Z","superseding_ref":null,"relying_party_notification_status":"pending"}'
    wire = '{"body":%s,"boundary_ref":"b","clocks":{"source_time":"2024-01-01T00:00:00.000Z"},"prev_digest":null,"record_id":"0190a000-0000-7000-8000-000000000001","record_type":"RevocationRecord","schema_version":"1.0.0","sequence":1,"signature":{},"source":{},"stream_id":"s","tenant_id":"t"}' % body
    one = spark.createDataFrame([(wire,)], "wire string")
    assert validate.report(one).first().errors == []
    seen = ledger.typed_view(one, "RevocationRecord").first()
    assert (seen.attestation_ref, seen.issuer, seen.effective_at, seen.superseding_ref) == ("a", '{"x":1}', T0, None)
