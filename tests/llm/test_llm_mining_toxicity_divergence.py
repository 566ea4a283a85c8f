"""Toxic spans, hard negatives and the divergence audit against brute-force versions, with nulls, empty and long texts, ties and repeated rows."""

from __future__ import annotations

import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from provenix.llm import divergence, hard_negatives, toxicity

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")


# -- toxicity


@pytest.mark.parametrize("seed", range(4))
def test_forward_backward_against_all_taggings(seed):
    r = random.Random(seed)
    column = pa.array([" ".join(r.choice("ab") for _ in range(r.randint(0, 6))) for _ in range(5)] + [None])
    tokens = toxicity.Tokens(column)
    energies = np.array([r.gauss(0, 2) for _ in tokens.starts])
    into, out_of, stay = steps = tuple(math.exp(r.gauss(0, 1)) for _ in range(3))
    chain = toxicity.Chain(tokens)
    chain.run(energies, steps)
    got, clean = chain.marginals()[chain.at], np.exp(chain.log_clean(out_of))
    for text in range(len(column)):
        at = np.flatnonzero(tokens.text == text)
        total, tagged, none = 0.0, np.zeros(len(at)), 0.0
        for tags in itertools.product((0, 1), repeat=len(at)):
            weight = 1.0
            for a, b in itertools.pairwise((0, *tags, 0)):
                weight *= {(0, 0): 1.0, (0, 1): into, (1, 0): out_of, (1, 1): stay}[a, b]
            weight *= math.exp(sum(e for e, t in zip(energies[at], tags) if t))
            total += weight
            tagged += weight * np.array(tags)
            none += weight * (not any(tags))
        assert np.allclose(got[at], tagged / total)
        assert math.isclose(clean[text], none / total)


def test_pieces_of_a_long_chain_agree_with_one_step_after_another():
    r = np.random.default_rng(1)
    odds = np.exp(r.normal(0, 3, 70_001)) * (r.random(70_001) > 0.01)
    got, x = toxicity._scan(odds, 0.3, 0.7, 2.5), 0.0
    for i, e in enumerate(odds.tolist()):
        x = e * (0.7 + 2.5 * x) / (1 + 0.3 * x)
        assert math.isclose(got[i], x, rel_tol=1e-9)


def test_field_gradient_finds_the_tags():
    texts = [f"the {w} is here and the end" for w in ("vile", "good", "foul", "kind") for _ in range(8)]
    toxic = np.array([("vile" in t) or ("foul" in t) for t in texts])
    tokens = toxicity.Tokens(pa.array(texts))
    word = {t: int(h) for t, h in zip(" ".join(texts).split(), tokens.hashes[toxicity.WORD])}
    telling = np.array([word["vile"], word["foul"]], np.uint64)
    tags = np.isin(tokens.hashes[toxicity.WORD], telling).astype(float)
    model = toxicity._field(tokens, tags, telling, 40, 0.05)
    chain = toxicity.Chain(tokens)
    chain.run(model.energies(tokens), model.steps)
    assert ((chain.marginals()[chain.at] > 0.5) == (tags > 0)).all()
    assert toxic[tokens.text[tags > 0]].all()


def corpus(seed: int, n: int = 500):
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("aeioubcdfg") for _ in range(r.randint(2, 7))) for _ in range(400)]
    bad, stem = ["nastyword", "vileword"], "grumok"
    rows, toxic = [], []
    for i in range(n):
        words = [r.choice(vocabulary) for _ in range(r.randint(20, 80))]
        y = r.random() < 0.2
        if y:
            for _ in range(3):
                words.insert(r.randint(0, len(words)), r.choice([*bad, stem + r.choice(["a", "end", "isch", "os", "ue"])]))
        rows.append((i, " ".join(words).capitalize() + ".", "x", 3))
        toxic.append((i, int(y), 1))
    return rows, toxic


def test_held_out_accuracy_and_spans(spark):
    rows, toxic = corpus(1)
    rows += [(9001, None, "x", 3), (9002, "", "x", 3), (9003, " \n", "x", 3), (None, "nastyword", "x", 3), (9004, "é vileword, NASTYWORD! " + "good " * 40_000, "x", 3), (9005, "ça va\nvileword nastyword, grumokisch bäh", "x", 3), rows[3]]
    df = spark.createDataFrame(rows, "doc_id long, text string, score string, spans int").repartition(3)
    labels = spark.createDataFrame([*toxic, (None, 1, 0), (3, None, 1), (777_777, 1, 1)], "doc_id long, toxic int, quality int")
    got = toxicity.judge(df, labels).collect()
    assert len(got) == len(rows)
    by = defaultdict(list)
    for x in got:
        by[x.doc_id].append(x)
        assert 0 <= x.score <= 1 and x.predicted == int(x.score >= 0.5)
        assert x.held_out == (zlib.crc32(str(x.doc_id).encode() if x.doc_id is not None else b"") % 5 == 0)
    truth = {i: y for i, y, _ in toxic}
    held = [(truth[x.doc_id], x.predicted) for x in got if x.held_out and x.doc_id in truth]
    assert sum(a == b for a, b in held) >= 0.97 * len(held) and sum(a for a, _ in held) > 5
    for i in (9001, 9002, 9003):
        assert by[i][0].predicted == 0 and by[i][0].spans == "" and by[i][0].n_toxic == 0
    assert by[9005][0].predicted == 1
    text = "ça va\nvileword nastyword, grumokisch bäh"
    found = [text[int(a) : int(b)] for a, b in (s.split(":") for s in by[9005][0].spans.split(","))]
    assert "vileword" in " ".join(found) and all(set(re.findall(r"\w+", f)) <= {"vileword", "nastyword", "grumokisch"} for f in found)
    assert by[9004][0].n_toxic == 2
    assert len({x.score for x in by[3]}) == 1 and len(by[3]) == 2


def test_labels_of_held_out_rows_and_other_columns_do_not_count(spark):
    rows, toxic = corpus(2, 200)
    labels = lambda flip: spark.createDataFrame([(i, (1 - y if flip and zlib.crc32(str(i).encode()) % 5 == 0 else y), 0) for i, y, _ in toxic], "doc_id long, toxic int, quality int")
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source int")
    other = spark.createDataFrame([(i, t, "zz", 9) for i, t, _, _ in rows], "doc_id long, text string, lang string, source int")
    one, two = (sorted((x.doc_id, x.score) for x in toxicity.judge(d, labels(f)).collect()) for d, f in ((df, False), (other, True)))
    assert one == two


@pytest.mark.parametrize("known", [[], [(1, 0, 1)], [(1, 1, 1)], [(None, None, None)]])
def test_nothing_to_learn_from(spark, known):
    df = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    got = toxicity.judge(df, spark.createDataFrame(known, "doc_id long, toxic int, quality int")).collect()
    assert [x.predicted for x in got] == [0, 0] and all(0 <= x.score < 0.5 for x in got)
    assert toxicity.judge(df.limit(0), spark.createDataFrame(known, "doc_id long, toxic int, quality int")).count() == 0


def test_copies_of_one_text_are_no_evidence():
    r = random.Random(5)
    clean = [" ".join(f"w{r.randint(0, 300)}" for _ in range(30)) for _ in range(300)]
    copy = " ".join(f"only{i}" for i in range(30))
    toxic = [copy] * 20 + [" ".join([*(f"w{r.randint(0, 300)}" for _ in range(15)), "awful", *(f"w{r.randint(0, 300)}" for _ in range(15))]) for _ in range(30)]
    tokens = toxicity.Tokens(pa.array(clean + toxic))
    found = toxicity.indicators(tokens, np.array([False] * len(clean) + [True] * len(toxic)))
    names = {bytes(tokens.data[tokens.starts[i] : tokens.ends[i]]).decode() for i, h in enumerate(tokens.hashes[toxicity.WORD].tolist()) if h in found}
    assert "awful" in names and len([n for n in names if n.startswith("only")]) <= 1


# -- hard negatives


@pytest.mark.parametrize("scale", [3, 200, 5000, 10**7, 10**12])
def test_packed_products_are_exact(scale):
    r = random.Random(scale)
    draw = lambda n, d: np.array([[r.randint(-scale, scale) for _ in range(d)] for _ in range(n)], np.int64)
    for n, m, d in ((3, 7, 64), (1, 1, 1), (5, 40, 3), (0, 4, 2), (4, 0, 2), (2, 3, 0)):
        a, c = draw(n, d).reshape(n, d), draw(m, d).reshape(m, d)
        want = [[min(max(sum(int(x) * int(y) for x, y in zip(p, q)), -(1 << 63)), (1 << 63) - 1) for q in c] for p in a]
        assert hard_negatives.packed_scores(a, c).tolist() == want
        assert hard_negatives.packed_scores(np.abs(a), np.abs(c)).tolist() == [[min(sum(abs(int(x)) * abs(int(y)) for x, y in zip(p, q)), (1 << 63) - 1) for q in c] for p in a]


def slow_mine(rows):
    ok = [(i, (y + 1) % 10 if i % 7 == 0 else y, [math.floor(256 * float(x)) for x in v]) for i, v, y in rows if i is not None and y is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = Counter()
    clip = lambda x: min(max(x, -(1 << 63)), (1 << 63) - 1)
    for a in {i: (i, y, v) for i, y, v in sorted(ok, key=lambda x: (x[1], x[2]), reverse=True) if i % 100 == 0}.values():
        scored = sorted(((-clip(sum(p * q for p, q in itertools.zip_longest(a[2], v, fillvalue=0))), i, y) for i, y, v in ok if i != a[0]))
        for s, p, _ in [x for x in scored if x[2] == a[1]][:5]:
            fits = [x for x in scored if x[2] != a[1] and 30 * -s <= 100 * -x[0] <= 90 * -s][:10]
            for k, (t, n, _) in enumerate(fits, 1):
                out[a[0], p, k, n, -s, -t] += 1
    return out


def vectors(seed, n=700, d=8):
    r = random.Random(seed)
    centre = [[r.gauss(0, 0.4) for _ in range(d)] for _ in range(4)]
    rows = [(i, [x + r.gauss(0, 0.3) for x in centre[i % 4]], r.randint(0, 3)) for i in range(n)]
    rows += [(n + i, rows[100][1], r.randint(0, 3)) for i in range(300)]  # one vector many times: ties
    rows += [(2000, None, 1), (2100, [0.5] * d, None), (2200, [None] + [0.1] * (d - 1), 1), (2300, [float("nan")] + [0.1] * (d - 1), 1), (2400, [float("inf")] * d, 1), (None, [0.1] * d, 1)]
    rows += [(2500, [], 1), (2600, [0.3, 0.2], 2), (2700, [0.2] * (d + 3), 0), (-100, [0.4] * d, 1), (2800, [0.9] * d, 55)]
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_hard_negatives(spark, seed, monkeypatch):
    rows = vectors(seed)
    df = spark.createDataFrame([(*x, "k", i) for i, x in enumerate(rows)], "vec_id long, embedding array<float>, label int, score string, band int").repartition(5)
    as_float = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], y) for i, v, y in rows]
    assert Counter(tuple(x) for x in hard_negatives.mine(df).collect()) == slow_mine(as_float)
    monkeypatch.setattr(hard_negatives, "ANCHORS", 3)
    monkeypatch.setattr(hard_negatives, "ROWS", 100)
    got = Counter(tuple(x) for x in hard_negatives.mine(df).collect())
    assert got == slow_mine(as_float) and len(got) > 100
    assert hard_negatives.mine(df.limit(0)).count() == 0


def test_hard_negatives_of_huge_components(spark):
    r = random.Random(3)
    rows = [(i * 10, [r.uniform(-1, 1) * 10.0 ** r.choice([0, 3, 9, 30]) for _ in range(4)], r.randint(0, 2)) for i in range(80)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    assert Counter(tuple(x) for x in hard_negatives.mine(df).collect()) == slow_mine([(i, [float(np.float32(x)) for x in v], y) for i, v, y in rows])


# -- divergence


def slow_audit(rows, least=3, top=200):
    docs = [((lang or ""), (source or ""), TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))) for lang, source, text in rows]
    out = Counter()
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        in_docs = Counter(t for d in own for t in set(d[2]))
        kept = [t for t in in_docs if in_docs[t] >= least]
        groups = {s: Counter(t for d in own if d[1] == s for t in d[2]) for s in {d[1] for d in own}}
        total = sum(groups.values(), Counter())

        def p(count, t):
            return 1 + 10**9 * (count[t] + 1) // (sum(count[x] for x in kept) + len(kept))

        f = lambda a, b: (a - b) ** 2 // b
        for s, here in groups.items():
            pairs = sorted((-sum(f(p(here, t), p(there, t)) for t in kept), h.encode()) for h, there in groups.items() if h != s)
            terms = sorted((-f(p(here, t), p(total, t)), t.encode()) for t in kept if here[t] and p(here, t) > p(total, t))[:top]
            for part, found in (("pair", pairs), ("term", terms)):
                for k, (v, item) in enumerate(found, 1):
                    out[lang, s, part, item.decode(), -v, k] += 1
    return out


def test_divergence(spark, monkeypatch):
    r = random.Random(4)
    vocabulary = [f"{a}{b}{c}" for a in "aéßz" for b in "Bkñ" for c in ("", "ü", "xy")]
    rows = []
    for i in range(220):
        words = [vocabulary[min(int(r.expovariate(0.15)), len(vocabulary) - 1)] for _ in range(r.randint(0, 60))]
        rows.append((r.choice(["en", "de", None, ""]), r.choice(["s1", "s2", "s3", "Ä", None]), r.choice([" ", "1", "_", "\n"]).join(words)))
    rows += [("fr", "alone", "mot mot"), ("it", "a", None), ("it", "b", "123 ..."), ("xx", "a", "one two"), ("xx", "b", "one"), ("en", "quiet", None), ("de", "s1", "wort " * 30_000), rows[0], rows[0], ("en", "s1", "a\x85b \x7f  c\x00d")]
    df = spark.createDataFrame([(*x, i, "k", 1) for i, x in enumerate(rows)], "lang string, source string, text string, n int, term string, kept int").repartition(6)
    want = slow_audit(rows)
    assert Counter(tuple(x) for x in divergence.audit(df).collect()) == want
    monkeypatch.setattr(divergence, "CHUNK_TERMS", 3)
    assert Counter(tuple(x) for x in divergence.audit(df).collect()) == want
    assert {k[2] for k in want} == {"pair", "term"} and max(k[4] for k in want) > 0
    assert sum(1 for x in divergence.audit(df, top=2).collect() if x.part == "term" and x.rank > 2) == 0
    assert divergence.audit(df.limit(0)).count() == 0
