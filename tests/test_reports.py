"""Coverage reports: what they store and how often they read; the queries that rest on one, against DuckDB."""

from __future__ import annotations

from datetime import datetime, timedelta

import duckdb
import pytest

from provenix import queries
from provenix.operators import coverage, reconcile
from provenix.sources.evidence import TABLES, view

DIR = "/root/testdata/sf0.01"
T0 = datetime(2024, 1, 1)


def test_facts_that_are_alike_are_one_row(spark, monkeypatch):
    kept = []

    def keep(df, kind):
        kept.append(df.cache())
        return kept[-1]

    monkeypatch.setattr(coverage, "stored", keep)
    own, at = ("t", "b", "p"), lambda h: T0 + timedelta(hours=h)
    kinds = [("matched", "reconciled", at(1), False, 700), ("matched", "reconciled", at(30), False, 5), ("duplicate", "observed", at(30), False, 3), ("duplicate", "observed", at(40), True, 2), ("unmatched_without_evidence", None, None, False, 4), ("matched", "reconciled", at(90), False, 1), ("out_of_scope", None, None, False, 6)]
    facts = spark.createDataFrame([(*own, f"d{k}-{i}", *x[:4]) for k, x in enumerate(kinds) for i in range(x[4])], "tenant_id string, boundary_ref string, population_ref string, destination_record_id string, status string, support string, occurred_at timestamp, skewed boolean")
    windows = spark.createDataFrame([(*own, at(0), at(72), 721, False, True), ("t", "b", "none", at(0), at(72), 0, False, True)], "tenant_id string, boundary_ref string, population_ref string, window_start timestamp, window_end timestamp, signed_count long, result_cap_hit boolean, pagination_complete boolean")
    classes = spark.createDataFrame([("p", "t", "c1", True, "reconciled", True)], "window_ref string, tenant_id string, class_in_force string, enumeration_capable boolean, admissible_level string, emits_ratio boolean")
    gaps = spark.createDataFrame([(*own, at(24), at(36)), (*own, at(30), at(32))], "tenant_id string, boundary_ref string, population_ref string, gap_start timestamp, gap_end timestamp")
    got = {r.population_ref: r for r in coverage.report(facts, windows, classes, gaps).collect()}
    assert [df.count() for df in kept] == [len(kinds)]
    p = got["p"]
    assert (p.numerator, p.matched, p.duplicate, p.unmatched_without_evidence, p.out_of_scope) == (705, 706, 5, 4, 6)
    assert (p.actions_in_gaps, p.reconciled_in_gaps, p.coverage_ratio, p.ratio_state) == (10, 5, "0.9860", "available")
    assert (got["none"].numerator, got["none"].matched, got["none"].actions_in_gaps) == (0, 0, 0)


def test_a_report_derives_each_view_once(spark):
    asked = []

    def reader(name):
        asked.append(name)
        return view(spark, "/root/testdata/sf0.001", name)

    v = queries.storing(reader, *queries.OF_REPORT, "boundary_windows")
    queries.report_of(v).count()
    assert {x: asked.count(x) for x in queries.OF_REPORT} == {x: 1 for x in queries.OF_REPORT}


@pytest.mark.parametrize("name", ["o104_coverage_report", "o101_ratio_states", "o121_assertions", "o122_exclusions"])
def test_same_rows_as_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    df, rel = queries.QUERIES[name](spark, DIR), con.sql(queries.ORACLES[name])
    cols = sorted(df.columns)
    assert sorted(rel.columns) == cols
    assert sorted(str(tuple(r[c] for c in cols)) for r in df.collect()) == sorted(str(tuple(r[rel.columns.index(c)] for c in cols)) for r in rel.fetchall())


def test_a_report_reads_its_evidence_once_without_storing_it(spark, monkeypatch):
    asked, kept = [], []

    def reader(name):
        asked.append(name)
        return view(spark, "/root/testdata/sf0.001", name)

    store = queries.stored
    monkeypatch.setattr(queries, "stored", lambda df, kind: kept.append(kind) or store(df, kind))
    queries.report_of(queries.storing(reader, "populations"))
    assert {x: asked.count(x) for x in ("population_items", *queries.R_VIEWS)} == {x: 1 for x in ("population_items", *queries.R_VIEWS)}
    assert kept == ["populations"]


def test_results_carry_their_times(spark):
    own, at = ("t", "b"), lambda h: T0 + timedelta(hours=h)
    names = ["good", "late", "none", "none2", "twice", "twin1", "twin2", "bare1", "bare2", "nameless", "span1", "span2", "many"]
    items = spark.createDataFrame([(*own, "p", d, "f", "erp") for d in (*names, "twice")] + [(*own, "q", "none", "f", "erp")], "tenant_id string, boundary_ref string, population_ref string, destination_record_id string, action_family string, destination_system string")
    said = [(d, f"a-{d}") for d in ("good", "late", "twice", "twin1", "twin2", "bare1", "bare2")] + [("nameless", None), ("span1", "s"), ("span2", "s"), ("many", "a-many"), ("many", "a-many")]
    receipts = spark.createDataFrame([(*own, d, a, f"r{k}", at(k), 1000 * k) for k, (d, a) in enumerate(said)], "tenant_id string, boundary_ref string, destination_record_id string, action_id string, record_id string, ingest_time timestamp, clock_skew_ms long")
    digests = {"twin1": "same", "twin2": "same", "bare1": None, "bare2": None}
    confirmed = ("good", "twice", "twin1", "twin2", "bare1", "bare2", "nameless")
    confirmations = spark.createDataFrame([(*own, d, None if d == "nameless" else f"a-{d}", "erp", digests.get(d, f"x-{d}"), f"c-{d}", at(100 + k)) for k, d in enumerate(confirmed)], "tenant_id string, boundary_ref string, destination_record_id string, action_id string, destination_system string, destination_record_digest string, record_id string, authoritative_time timestamp")
    proposals = spark.createDataFrame([(*own, a, "f") for a in {a for _, a in said if a}] + [(*own, "\0none", "other")], "tenant_id string, boundary_ref string, action_id string, action_family string")
    args = (items, receipts, confirmations, proposals)
    plain = reconcile.classify(*args)
    got = sorted((r.population_ref, r.destination_record_id, r.status, r.action_id, r.confirmation_record_id) for r in plain.fillna("-").collect())
    assert got == sorted([
        ("p", "good", "matched", "a-good", "c-good"), ("p", "late", "unmatched_with_evidence", "a-late", "-"), ("p", "none", "unmatched_without_evidence", "-", "-"), ("q", "none", "unmatched_without_evidence", "-", "-"), ("p", "none2", "unmatched_without_evidence", "-", "-"),
        ("p", "twice", "ambiguous", "-", "-"), ("p", "twice", "ambiguous", "-", "-"), ("p", "twin1", "duplicate", "a-twin1", "c-twin1"), ("p", "twin2", "duplicate", "a-twin2", "c-twin2"), ("p", "bare1", "matched", "a-bare1", "c-bare1"), ("p", "bare2", "matched", "a-bare2", "c-bare2"),
        ("p", "nameless", "unmatched_with_evidence", "-", "-"), ("p", "span1", "ambiguous", "-", "-"), ("p", "span2", "ambiguous", "-", "-"), ("p", "many", "ambiguous", "-", "-"),
    ])
    rows = lambda df: sorted(str(tuple(r)) for r in df.collect())
    assert rows(coverage.supported(reconcile.evidenced(*args))) == rows(coverage.support(plain, confirmations, receipts))


def test_out_of_scope_is_counted_without_the_rest(spark):
    text = lambda cols: ", ".join(f"{c} string" for c in cols.split())
    names = ["good", "crm", "null_system", "family", "by_conf", "two_families", "bare", "nameless", "both"]
    items = [("t", "b", "p", d, "f", "erp") for d in names] + [("t", "b", "p", "twice", "f", "erp"), ("t", "b", "p", "twice", "g", "erp"), ("t", "b", "q", "family", "f", "erp"), ("t", "b", "q", "only_g", "g", "crm"), ("u", "b", "p", "good", "g", "crm"), ("u", "b", "p", None, "g", "crm")]
    receipts = [("t", "b", d, f"a-{d}") for d in ("good", "family", "twice", "two_families", "both", "both", "only_g")] + [("t", "b", "nameless", None), ("u", "b", "good", "a-good"), ("u", "b", None, "a-family"), ("t", "b", "unlisted", "a-family")]
    systems = {"crm": "crm", "null_system": None, "both": "crm", "only_g": "crm"}
    confirmations = [("t", "b", d, f"a-{d}", systems.get(d, "erp")) for d in ("good", "crm", "null_system", "by_conf", "both", "only_g")] + [("u", "b", "good", "a-good", "erp"), ("u", "b", "good", "a-good", "crm"), ("t", "b", "bare", None, "erp")]
    proposals = [("t", "b", "a-good", "f"), ("t", "b", "a-family", "g"), ("t", "b", "a-by_conf", "h"), ("t", "b", "a-two_families", "f"), ("t", "b", "a-two_families", "g"), ("t", "b", "a-twice", "f"), ("t", "b", "a-both", "g"), ("t", "b", "a-only_g", "g"), ("u", "b", "a-good", "g"), ("t", "b", None, "g"), ("t", "b", "a-crm", None)]
    i = spark.createDataFrame(items, text("tenant_id boundary_ref population_ref destination_record_id action_family destination_system"))
    r = spark.createDataFrame(receipts, text("tenant_id boundary_ref destination_record_id action_id"))
    c = spark.createDataFrame(confirmations, text("tenant_id boundary_ref destination_record_id action_id destination_system")).selectExpr("*", "concat('c', destination_record_id) record_id", "concat('x', destination_record_id) destination_record_digest")
    p = spark.createDataFrame(proposals, text("tenant_id boundary_ref action_id action_family"))
    got = {(x.tenant_id, x.boundary_ref, x.population_ref): x.out_of_scope for x in reconcile.out_of_scope(i, r, c, p).collect()}
    assert got == {("t", "b", "p"): 7, ("t", "b", "q"): 1, ("u", "b", "p"): 1}
    whole = reconcile.counts(reconcile.classify(i, r, c, p), "tenant_id", "boundary_ref", "population_ref")
    assert got == {(x.tenant_id, x.boundary_ref, x.population_ref): x.out_of_scope for x in whole.collect() if x.out_of_scope}


@pytest.mark.parametrize("name", ["o101_ratio_states", "o122_exclusions"])
def test_no_support_is_derived_where_only_the_state_is_asked_for(spark, monkeypatch, name):
    monkeypatch.setattr(queries, "facts_of", lambda v: pytest.fail("the whole report was made"))
    assert queries.QUERIES[name](spark, "/root/testdata/sf0.001").count() > 0
