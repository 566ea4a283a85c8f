"""Each operator against a brute-force version on small tables with nulls, empty and long texts, ties and repeated rows."""

from __future__ import annotations

import base64
import gzip
import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import pyarrow as pa
import pytest
import xxhash

import corpus_pipeline
from provenix.llm import components, decontam, html_text, line_dedup, packing, pii, quality, simhash, substring_dedup, url_filter, warc

WORD = re.compile(r"[^\x20\x09-\x0D]+")
VOCAB = [f"w{i}" for i in range(40)] + ["é", "the", "Zug", "ñ", "a\x85b", "x y"]


def texts(seed: int, n: int = 60) -> list[str | None]:
    r = random.Random(seed)
    line = lambda: " ".join(r.choice(VOCAB) for _ in range(r.randint(0, 14)))
    some = ["\n".join(line() for _ in range(r.randint(0, 9))) for _ in range(n)]
    near = [" ".join(w for w in t.split(" ") if r.random() < 0.98) for t in some[: n // 3]]
    long = " ".join(r.choice(VOCAB) for _ in range(3000))
    return [*some, *near, *some[:6], None, "", " \t\n", "one", "x " * 400, "p q r " * 300, long, long + " w1", "w2 " + long]


def table(spark, values: list[str | None], first: int = 0):
    rows = [(first + i, t, "k", 7) for i, t in enumerate(values)]
    rows += [rows[3], (None, values[0], "k", 7), (None, None, "k", 7)]  # a repeated row, rows without an id
    # columns whose names operators use themselves
    return spark.createDataFrame(rows, "doc_id long, text string, fp string, line int").repartition(3)


def words(t: str | None) -> list[str]:
    return WORD.findall(t or "")


def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string")


def slow_print(t: str | None, k: int) -> int:
    w = words(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    shingles = [" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] if len(w) >= k else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def test_simhash(spark):
    df = table(spark, texts(1))
    rows = df.collect()
    prints = [slow_print(r.text, 3) for r in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                root[find(i)] = find(j)
    least = defaultdict(list)
    for i, r in enumerate(rows):
        least[find(i)].append(r.doc_id)
    want = Counter((r.doc_id, prints[i], min(x for x in least[find(i)] if x is not None)) for i, r in enumerate(rows))
    got = Counter((r.doc_id, r.fp % (1 << 64), r.component_id) for r in simhash.near_duplicates(df).collect())
    assert got == want
    assert len(set(least)) < len(set(prints))  # some links join different fingerprints
    assert simhash.near_duplicates(empty(spark)).count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_links_reach_every_pair_within_three_bits(spark, seed):
    r = random.Random(seed)
    base = [r.getrandbits(64) for _ in range(6)]
    prints = {b for b in base}
    for b in base:
        for _ in range(40):
            x = b
            for _ in range(r.randint(1, 5)):
                x ^= 1 << r.randint(0, 63)
            prints.add(x)
    signed = [p - (p >> 63 << 64) for p in prints]
    df = spark.createDataFrame([(p,) for p in signed], "fp long")
    parts = {x.node: x.component for x in components.connected_components(simhash.links(df)).collect()}
    got = defaultdict(set)
    for p in signed:
        got[parts.get(p, p)].add(p)
    left, want = set(signed), []
    while left:
        group, edge = set(), [left.pop()]
        while edge:
            a = edge.pop()
            group.add(a)
            near = {b for b in left if ((a ^ b) % (1 << 64)).bit_count() <= 3}
            left -= near
            edge += near
        want.append(frozenset(group))
    assert {frozenset(g) for g in got.values()} == set(want)


def test_keep_one(spark):
    df = table(spark, texts(1))
    kept = simhash.keep_one(df, 3)
    assert kept.columns == df.columns
    groups = {r.component_id for r in simhash.near_duplicates(df).collect()}
    assert kept.count() == len(groups)


@pytest.mark.parametrize("window", [7, 35])
def test_substring_dedup(spark, window):
    r = random.Random(window)
    values = texts(2)
    values += [(values[i] or "") + " " + (values[5] or "") + " tail " + " ".join(r.choice(VOCAB) for _ in range(50)) for i in range(20)]
    df = table(spark, values)
    rows = [(r.doc_id, r.text) for r in df.collect()]
    seen = Counter(tuple(w[i : i + window]) for _, t in rows for w in [words(t)] for i in range(len(w) - window + 1))
    want = Counter()
    for d, t in rows:
        w, gone = words(t), set()
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone |= set(range(i, i + window))
        want[d, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)] += 1
    assert Counter(tuple(r) for r in substring_dedup.dedup(df, window).collect()) == want
    assert any(k[2] for k in want) and any(not k[2] for k in want)
    assert substring_dedup.dedup(empty(spark)).count() == 0


def test_line_dedup(spark):
    df = table(spark, texts(3))
    rows = [r for r in df.collect()]
    lines = []
    for r in sorted(rows, key=lambda r: (-1 if r.doc_id is None else r.doc_id)):
        for i, x in enumerate((r.text or "").split("\n")):
            if w := frozenset(words(x)):
                lines.append((r.doc_id, r.text, i, w))
    gone = set()
    for k, (d, t, i, w) in enumerate(lines):
        for e, u, j, v in lines[:k]:
            if (e, u, j) != (d, t, i) and not (d is None and e is None) and 5 * len(w & v) >= 4 * len(w | v):
                gone.add((d, t, i))
                break
    got = line_dedup.dedup(df)
    assert got.columns == [*df.columns, "n_lines", "n_removed"]
    for r in got.collect():
        if r.doc_id is None:
            continue
        (t,) = {x.text for x in rows if x.doc_id == r.doc_id}
        if t is None:
            assert r.text is None
        else:
            assert r.text == "\n".join(x for i, x in enumerate(t.split("\n")) if (r.doc_id, t, i) not in gone)
            assert r.n_lines == t.count("\n") + 1
    assert len(gone) > 20
    assert line_dedup.dedup(empty(spark)).count() == 0


def test_line_dedup_judges_short_lines(spark):
    r = random.Random(12)
    some = ["\n".join(" ".join(r.choice("abcdefghij") for _ in range(r.randint(0, 7))) for _ in range(8)) for _ in range(30)]
    values = ["All rights reserved.\none two three four\n\nx", "intro of a text\nAll rights reserved.\nx", "one two three four five\nx y", *some]
    lines, gone = [], set()
    for i, t in enumerate(values):
        for k, x in enumerate(t.split("\n")):
            if w := frozenset(words(x)):
                if any(5 * len(w & v) >= 4 * len(w | v) for v in lines):
                    gone.add((i, k))
                lines.append(w)
    df = spark.createDataFrame(list(enumerate(values)), "doc_id long, text string").repartition(3)
    want = {i: "\n".join(x for k, x in enumerate(t.split("\n")) if (i, k) not in gone) for i, t in enumerate(values)}
    assert {r.doc_id: r.text for r in line_dedup.dedup(df, least=1).collect()} == want
    assert {(1, 1), (1, 2), (2, 0)} <= gone  # equal short lines, and four words of five
    own = spark.createDataFrame([(1, "Home\nAbout us"), (2, "About us\nNews")], "doc_id long, text string")
    _, stage = next(s for s in corpus_pipeline.STAGES if s[0] == "line dedup")
    assert {r.doc_id: r.text for r in stage(spark, own, "").collect()} == {1: "Home\nAbout us", 2: "News"}


def test_decontamination(spark):
    bench = spark.createDataFrame(
        [(1, "Today Alice has 12 apples and gives Bob 5 apples in 3 days. How many apples does Alice keep now?"), (2, "la maison est très grande et le jardin aussi est très beau"), (3, None), (4, ""), (5, "too short")], "item_id long, text string"
    )
    docs = [
        (1, "Intro. Today Alice has 12 apples and gives Bob 5 apples in 3 days. How many apples does Alice keep now? End."), (2, "Today Carol has 40 apples and gives Dave 7 apples in 9 days. How many apples does Carol keep now?"),
        (3, "Today Carol has 40 apples. And some pears in a bowl."), (4, None), (5, ""), (6, "x\nLa maison est TRÈS grande et le jardin aussi est très beau,\ny"), (7, "la maison est petite"), (7, "la maison est petite"),
    ]
    df = spark.createDataFrame([(*d, "z") for d in docs], "doc_id long, text string, item_id string")
    found = {(r.doc_id, r.item_id): r.same_values for r in decontam.find(df, bench).collect()}
    assert found == {(1, 1): True, (2, 1): False, (6, 2): True}
    assert found == {(r.doc_id, r.item_id): r.same_values for r in decontam.find(df, bench, block=2).collect()}  # in blocks
    kept = decontam.clean(df, bench)
    assert sorted(r.doc_id for r in kept.collect()) == [3, 4, 5, 7, 7] and kept.columns == df.columns
    assert decontam.find(empty(spark), bench).count() == 0 and decontam.find(df, bench.limit(0)).count() == 0


def test_slots_must_be_consistent(spark):
    bench = spark.createDataFrame([(1, "we saw 3 and 5 then 3 or 5")], "item_id long, text string")
    df = spark.createDataFrame([(1, "we saw 8 and 9 then 8 or 9"), (2, "we saw 8 and 8 then 9 or 6")], "doc_id long, text string")
    assert [r.doc_id for r in decontam.find(df, bench).collect()] == [1]


def test_packing_is_gapless_and_near_the_bound(spark):
    df = table(spark, [*texts(4), *(t for t in texts(5, 200))])
    rows = packing.pack(df).collect()
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.tokenizer_path())
    want = Counter()
    for r in df.collect():
        ids = [*tok.encode(r.text or "", add_special_tokens=False).ids, 0]
        cuts = [0, *range(len(ids) % 2048 or 2048, len(ids) + 1, 2048)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want[r.doc_id, k, a, b - a, zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids[a:b]))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(by) <= -(-sum(r.length for r in rows) // 2048) + 3
    assert packing.pack(empty(spark)).count() == 0


@pytest.mark.parametrize("text", ["a  b\n\n\nc ", "\n x", "x\t y", "it's  don't\xa0 z", "<|endoftext|>a <|endoftext|> b", "é\x1c b\x85\nq", "  ", "\n", "１２ ab12 ...!!! x　y", "x \x00y", "👍🏽 ok"])
def test_encoder_gives_the_ids_of_tokenizers(text):
    from tokenizers import Tokenizer

    path = packing.tokenizer_path()
    assert packing.encoder(path).ids(text).tolist() == [*Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids, 0]


def test_plan_uses_every_length():
    for seed in range(5):
        r = random.Random(seed)
        h = Counter(min(2048, int(r.expovariate(1 / 500)) + 1) for _ in range(3000))
        used = Counter()
        groups = packing.plan(h)
        for lengths, n in groups:
            assert sum(lengths) <= 2048
            for k in lengths:
                used[k] += n
        assert used == h and sum(n for _, n in groups) <= 1.01 * sum(k * n for k, n in h.items()) / 2048 + 2
    assert packing.plan({}) == []


def test_html(spark):
    page = (
        '<html><head><title>T</title><style>p{}</style></head><body><header><h1>Site</h1></header><div id="cookie-notice">We use cookies on this site, accept them all please.</div>'
        '<div class="content"><h2>Title here</h2><p>A long   paragraph of text with several words &amp; an entity.<p>Short.</p><ul><li>item one is here<li>item two</ul>'
        '<div class="comments"><p>A reader says a lot of words in here, long enough to count</p></div></div><form><label>Name</label></form><aside>side text that is long long long</aside><footer>foot</footer></body>'
    )
    article = '<body><nav><a href="/">Home</a></nav><article class="post"><h1>Head</h1><p>Body text that goes on for a while, with a <b>bold</b> word.<br>Next</p><article class="comment">nested reader comment of some length</article></article><p>outside text of some length that is not the article</p>'
    df = spark.createDataFrame([(1, "u", page, 1), (2, None, article, 1), (3, "u", None, 1), (4, "u", "", 1), (5, "u", "<p>", 1), (5, "u", "plain &lt;words&gt;", 1)], "page_id long, url string, html string, text int")
    got = {(r.page_id, r.text): r.n_chars for r in html_text.extract(df).collect()}
    want = {(1, "Title here\nA long paragraph of text with several words & an entity.\nShort.\nitem one is here\nitem two"), (2, "Head\nBody text that goes on for a while, with a bold word.\nNext"), (3, ""), (4, ""), (5, ""), (5, "plain <words>")}
    assert set(got) == want and all(n == len(t) for (_, t), n in got.items())
    assert html_text.main_text("<p>" + "word " * 200_000 + "</p>") == ("word " * 200_000).strip()


def test_surge_and_dive():
    assert html_text.spans([0, 0, 50, 10, 0, 0, 0, 0, 60]) == [(2, 4), (8, 9)]
    # the surge is half of a short page's peak, so such a page keeps its lines without a second try
    assert html_text.spans([5, 0, 0, 0, 5]) == [(0, 1), (4, 5)] and html_text.spans([500, 0, 0, 0, 5]) == [(0, 1)] and html_text.spans([]) == []


def test_warc_round_trip(spark, tmp_path):
    big, other = "x" * 1500, "é" * 800
    rows = [(1, "http://a/ b", big), (2, "http://b", big), (9, None, big), (9, "http://c", big), (4, "http://d", "small"), (5, "http://e", "small"), (6, "http://f", None), (7, "http://g", ""), (8, "http://h", other), (None, "http://i", other)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, digest int").repartition(3)
    got = warc.round_trip(df, f"file://{tmp_path}/w").collect()
    sha = lambda t: hashlib.sha1((t or "").encode()).hexdigest()
    refers = {1: 9, 2: 9, None: 8}
    want = Counter((p, len((h or "").encode()), sha(h), "revisit" if p in refers else "response", refers.get(p)) for p, _, h in rows)
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == want
    assert all(r.verified for r in got)
    assert warc.round_trip(df.limit(0), f"file://{tmp_path}/none").count() == 0


def test_warc_members_and_framing():
    records = [warc.record_bytes(i, f"http://x/{i}", b"p" * i, None) for i in range(1, 60, 7)]
    blob = b"".join(gzip.compress(r) for r in records)
    assert list(warc.members(blob[i : i + 5] for i in range(0, len(blob), 5))) == [(r, None) for r in records]
    fields, block = warc.parse(records[2])
    assert int(fields["content-length"]) == len(block) and base64.b32decode(fields["warc-block-digest"][5:]) == hashlib.sha1(block).digest()
    with pytest.raises(ValueError):
        warc.parse(records[2] + b"x")
    *whole, (last, why) = warc.members([blob[:-9]])
    assert whole == [(r, None) for r in records[:-1]] and last is None and "ends inside" in why


@pytest.mark.parametrize("step", [1, 7, 1 << 16])
def test_damaged_members_stop_nothing(step):
    records = [warc.record_bytes(i, f"http://x/{i}", bytes(range(256)) * i, None) for i in range(1, 9)]
    parts = [bytearray(gzip.compress(r)) for r in records]
    parts[2][len(parts[2]) // 2] ^= 255
    parts[5][:3] = b"abc"
    blob = b"".join(parts)
    got = list(warc.members(blob[i : i + step] for i in range(0, len(blob), step)))
    assert [r for r, _ in got if r is not None] == [r for i, r in enumerate(records) if i not in (2, 5)]
    assert sum(why is not None for _, why in got) >= 2


def test_damaged_archive_is_read_on(spark, tmp_path):
    good = [warc.record_bytes(i, f"http://x/{i}", b"p" * 50, None) for i in range(4)]
    wrong = [good[1].replace(b"ppp", b"qqq"), good[2][:-6] + b"more\r\n\r\n", b"no record"]
    (tmp_path / "a.warc.gz").write_bytes(b"".join(gzip.compress(r) for r in [good[0], *wrong, good[3]]) + b"\x1f\x8b\x08cut")
    got = warc.read(spark, str(tmp_path)).collect()
    assert [r.page_id for r in got if r.verified] == [0, 3]
    assert sum(not r.verified and r.error is not None for r in got) == 4


def slow_measures(t: str | None) -> tuple[int, ...]:
    t = t or ""
    w = words(t)
    times, covered = Counter(zip(w, w[1:], w[2:])), set()
    for i in range(len(w) - 2):
        if times[tuple(w[i : i + 3])] > 1:
            covered |= {i, i + 1, i + 2}
    seen, again = set(), 0
    for x in t.split("\n"):
        if WORD.search(x):
            again += x in seen
            seen.add(x)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), again, len(covered)


def test_quality(spark):
    df = table(spark, [*texts(6), "a b\na b\na\t\n\na", "#*$%&|<> x"])
    got = quality.judged(df)
    text_of = defaultdict(set)
    for r in df.collect():
        text_of[r.doc_id].add(r.text)
    for r in got.collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) in {slow_measures(t) for t in text_of[r.doc_id]}
        assert r.base_failed == (r.n_words < 50 or 2 * r.n_repeat_words > r.n_words)
        assert not (r.base_failed and r.kept)
    assert got.count() == df.count()
    kept = quality.keep_good(df)
    assert kept.columns == df.columns and kept.count() == got.where("kept").count()
    assert quality.judged(empty(spark)).count() == 0 and quality.keep_good(empty(spark)).count() == 0


def test_low_variety_votes_bad_at_every_length(spark):
    r = random.Random(8)
    few = [f"w{i}" for i in range(190)]
    rows = [(n, " ".join(r.choice(few) for _ in range(n))) for n in (3999, 4001, 5000, 40_000)]
    rows += [(-n, " ".join(f"p{int(r.random() ** 2 * 12 * i**0.5)}" for i in range(n))) for n in (3000, 5000, 40_000)]  # words grow with the root of the length
    df = quality.with_measures(spark.createDataFrame(rows, "doc_id long, text string"))
    got = {x.doc_id: x.v for x in df.select("doc_id", quality.rules()["variety"].alias("v")).collect()}
    assert {d: v for d, v in got.items() if d > 0} == dict.fromkeys((3999, 4001, 5000, 40_000), -1)
    assert all(v >= 0 for d, v in got.items() if d < 0)


def slow_posterior(counts: dict, rounds: int = 100) -> dict:
    """The estimation once more, document pattern by document pattern."""
    rules, total = len(next(iter(counts))), sum(counts.values())
    priors = [{j: quality.ON_GOOD for j in range(rules)}] + [{j: quality.ON_OWN if j == k else quality.ON_OTHER for j in range(rules)} for k in range(rules)]
    shares = [0.9] + [0.1 / rules] * rules
    belief = {}
    for v in counts:
        bad = [j for j in range(rules) if v[j] < 0]
        good = 0.1 if bad else 0.9
        belief[v] = [good] + [((j in bad) / len(bad) if bad else 1 / rules) * (1 - good) for j in range(rules)]
    weight = max(1.0, total / 1000)
    for _ in range(rounds):
        sums = [sum(belief[v][k] * n for v, n in counts.items()) for k in range(rules + 1)]
        mix = [(s + weight * p) / (total + weight) for s, p in zip(sums, shares)]
        table = [[[(sum(belief[v][k] * n for v, n in counts.items() if v[j] == x) + weight * priors[k][j][x + 1]) / (sums[k] + weight) for x in (-1, 0, 1)] for j in range(rules)] for k in range(rules + 1)]
        for j in range(rules):
            own = table[j + 1][j]
            if own[0] < 0.5:
                rest = own[1] + own[2]
                table[j + 1][j] = [0.5, own[1] * 0.5 / rest, own[2] * 0.5 / rest]
        for v in counts:
            x = [mix[k] * math.prod(table[k][j][v[j] + 1] for j in range(rules)) for k in range(rules + 1)]
            belief[v] = [y / sum(x) for y in x]
    return {v: b[0] for v, b in belief.items()}


def test_estimation_decides(spark):
    """Against the estimation written out plainly; a bad vote that nothing bears out is outweighed, one of a common kind of junk is not."""
    r = random.Random(1)
    votes: Counter = Counter()
    for _ in range(4000):
        kind = r.random()
        if kind < 0.06:  # junk that rules 0 and 1 see
            v = (-1 if r.random() < 0.95 else 0, -1 if r.random() < 0.9 else 1, 1, 1)
        elif kind < 0.1:  # junk that rules 2 and 3 see
            v = (1, 1, -1 if r.random() < 0.9 else 1, -1 if r.random() < 0.9 else 0)
        else:
            v = tuple(-1 if r.random() < 0.01 else 0 if r.random() < 0.05 else 1 for _ in range(4))
        votes[v] += 1
    want = slow_posterior(votes)
    mix, t = quality.fit(list(votes.items()))
    df = spark.createDataFrame([(*v,) for v in votes], "a int, b int, c int, d int")
    got = {tuple(x)[:4]: x.p for x in df.withColumn("p", quality.posterior(mix, t, ["a", "b", "c", "d"])).collect()}
    assert all(abs(got[v] - want[v]) < 1e-6 for v in votes)
    assert want[-1, -1, 1, 1] < 0.01 and want[1, 1, -1, -1] < 0.01 and want[1, 1, 1, 1] > 0.99
    assert any(min(v) < 0 and p >= 0.5 for v, p in want.items())  # not what "no rule votes bad" says


def test_quality_agrees_with_labels(spark):
    d = "/root/testdata/sf0.01"
    got = quality.judged(spark.read.parquet(f"{d}/documents.parquet")).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").where("not base_failed").collect()
    right = sum(r.kept == (r.quality == 1) for r in got)
    assert right >= 0.98 * len(got)


def slow_spans(t: str) -> list[tuple[int, int, int]]:
    out = [(m.start(), m.end(), 0) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), m.end(), 1) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [(m.start(), m.end(), 2) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 12 <= len(d := re.sub("[^0-9]", "", m[0])) <= 19 and pii.luhn(d)]
    out += [(m.start(), m.end(), 3) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(out, key=lambda s: (s[0], s[2]))


def test_base_patterns():
    r = random.Random(9)
    for _ in range(3000):
        t = "".join(r.choice("a.@-+ 0123456789()é%") for _ in range(r.randint(0, 60)))
        assert pii.base_spans(t) == slow_spans(t), t
    assert pii.base_spans("9" * 500_000) == pii.base_spans("1." * 3 + "a" * 500_000) == []


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("mail john [at] example [dot] com now", [("email", "john [at] example [dot] com")]), ("john.doe at example dot com", [("email", "john.doe at example dot com")]), ("ｊｏｈｎ＠ｅｘａｍｐｌｅ．ｃｏｍ", [("email", "ｊｏｈｎ＠ｅｘａｍｐｌｅ．ｃｏｍ")]),
        ("jоhn@exаmple.com", [("email", "jоhn@exаmple.com")]), ("call plus four nine one seven two five five five one two three!", [("phone", "plus four nine one seven two five five five one two three")]),
        ("１９２.168.0.1", [("ip", "１９２.168.0.1")]), ("it is at the dot of noon, one or two of them", []), ("", []), ("a@b.c", [("email", "a@b.c")]),
    ],
)
def test_deobfuscation(text, want):
    assert [(pii.KINDS[k], text[s:e]) for s, e, k in pii.all_spans(text, pii.base_spans(text))] == want


@pytest.mark.parametrize("text", ["john(at)example dot com", "john at example (dot) com", "john _at_ example _dot_ com", "john -at- example -dot- com", "john@example dot com", "john at example.com", "john at example dot ru", "john dot doe [at] example dot co dot tv", "john at example dot se", "j.doe at example.cn"])
@pytest.mark.parametrize("around", ["{}", "write to {} today", "x\n{}\ny"])
def test_mixed_disguises(text, around):
    whole = around.format(text)
    assert [(pii.KINDS[k], whole[s:e]) for s, e, k in pii.all_spans(whole, pii.base_spans(whole))] == [("email", text)]


@pytest.mark.parametrize("text", ["call one two six zero one two six zero one", "call 1 2 6 0 1 2 6 0 one", "plus six six one two zero zero one one two"])
def test_spelled_digits_of_few_words(text):
    tape = pii.deobfuscated(text)
    assert tape is not None and re.search("[0-9]{9}", tape.text)


@pytest.mark.parametrize("text", ["you can see more about us at example.com today", "look at the dot in the middle", "he was at home dot and dash", "one or two of them were at school. Then"])
def test_plain_speech_is_no_address(text):
    assert pii.all_spans(text, []) == []


def test_pii_query(spark):
    df = table(spark, ["x a@b.cc, +1 (017) 555-7713", None, "é 4539148803436467", "at [dot] x", ""])
    for r in pii.find(df).collect():
        text = {x.text for x in df.collect() if x.doc_id == r.doc_id}
        assert any(r.base_sha256 == hashlib.sha256(pii.listed(slow_spans(t or "")).encode()).hexdigest() for t in text)
    assert pii.find(empty(spark)).count() == 0


def test_url_rules(spark):
    urls = ["http://a.com/x", "HTTPS://WWW.Example.COM/en/a?b#c", "http://example.com/en/", "http://notexample.com/en/", "http://x.example.com/en/q", "http://b.net/es/1", "http://b.net", "http://b.net/fr/", None, "no scheme", "ftp://c.com", "http://a.com:80/x", "x://com/", "http://a..com/", "http://a.com?/en/"]
    df = spark.createDataFrame([(i, u, 1, 2) for i, u in enumerate(urls)] + [(0, urls[0], 1, 2)], "page_id long, url string, short int, host int")

    def slow(u):
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", u or "")
        host, path = (re.sub("[A-Z]", lambda x: x[0].lower(), m[1]), m[2]) if m else ("", "")
        fits = [(len(h + p), h + p, v) for h, p, v in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return host, path, *(max(fits)[1:] if fits else (None, "allow"))

    got = url_filter.judge(df, url_filter.rules_table(spark))
    assert Counter((r.page_id, r.host, r.path, r.rule, r.verdict) for r in got.collect()) == Counter([*((i, *slow(u)) for i, u in enumerate(urls)), (0, *slow(urls[0]))])
    other = url_filter.rules_table(spark, [("a.com", "/pre", "block"), ("a.com", "", "allow")])
    some = spark.createDataFrame([(1, "http://q.a.com/prefix"), (2, "http://a.com/p")], "page_id long, url string")
    assert {r.page_id: r.verdict for r in url_filter.judge(some, other, "block").collect()} == {1: "block", 2: "allow"}
    assert url_filter.judge(df.limit(0), other).count() == 0


def test_components_of_chains_and_hubs(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(1000, 1000 + i) for i in range(1, 200)] + [(5, 5), (None, 3), (7, 9)]
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(61)} | {1000 + i: 1000 for i in range(200)}


PROSE = ["This paragraph tells at some length what happened, and it ends as it should. " * k for k in (2, 1, 3)]


def test_html_line_blocks_carry_pages_without_names(monkeypatch):
    """A page without article, names or roles: only the distribution of running text tells the story from the links around it."""
    links = "".join(f"<div><a href='/{i}'>Section {i}</a></div>" for i in range(9))
    page = f"<html><body>{links}<div>{PROSE[0]}</div><div>Short line.</div><div><a href='/x'>The whole report</a></div><div>{PROSE[1]}<br>{PROSE[2]}</div>{links}</body></html>"
    want = "\n".join([PROSE[0].strip(), "Short line.", "The whole report", PROSE[1].strip(), PROSE[2].strip()])
    assert html_text.main_text(page) == want
    monkeypatch.setattr(html_text, "spans", lambda lengths: [(0, len(lengths))])
    assert html_text.main_text(page) != want and "Section 3" in html_text.main_text(page)


def test_html_keeps_the_article_whole():
    page = f"<nav><p>{PROSE[0]}</p></nav><article><h1>Title</h1><p>{PROSE[0]}</p><p><a>See the full report</a></p><p class='related'>{PROSE[1]}</p><p>End</p><p class='ad'>Buy</p><div class='comments'><p>{PROSE[2]}</p></div></article><p>{PROSE[2]}</p>"
    assert html_text.main_text(page) == "\n".join(["Title", PROSE[0].strip(), "See the full report", PROSE[1].strip(), "End"])
    assert html_text.main_text("<p>hi</p><p>you &amp; me</p>") == "hi\nyou & me"
    assert html_text.main_text(None) == html_text.main_text("") == html_text.main_text("<script>x</script>") == ""


def slow_html_spans(lengths: list[int]) -> set[int]:
    """Lines kept, from the words of the method: a window reaches the surge, then everything up to three lines of nothing."""
    sums = [sum(lengths[i : i + 3]) for i in range(len(lengths))]
    surge = max(1, min(40, max(sums, default=0) // 2))
    kept: set[int] = set()
    for i, x in enumerate(lengths):
        if x and sums[i] >= surge:
            j = i
            while j < len(lengths) and sums[j]:
                kept.add(j)
                j += 1
            j = i - 1
            while j >= 0 and lengths[j]:
                kept.add(j)
                j -= 1
    return kept


def test_html_spans_against_brute_force():
    r = random.Random(4)
    for _ in range(3000):
        lengths = [r.choice((0, 0, 5, 12, 30, 90)) for _ in range(r.randint(0, 25))]
        assert {i for a, b in html_text.spans(lengths) for i in range(a, b)} == slow_html_spans(lengths), lengths


@pytest.mark.parametrize("page", ["<pre><b>" * 130_000 + "x" * 50, "<b><div>" + "<i>" * 50_000 + "</b>" * 50_000 + "y", "</pre>" * 150_000, "x<" * 300_000, "<!--" * 100_000, "<p>" + "<i>" * 100_000])
def test_html_of_a_megabyte_takes_seconds(page):
    began = time.time()
    html_text.main_text(page)
    assert time.time() - began < 20


def test_decontamination_of_reparameterised_questions():
    items = [(1, "Alice has 12 apples. Bob has 5 apples. How many apples do Alice and Bob have?"), (2, "what is two plus"), (3, "1 2 3 4 5 6 7 8"), (4, "Today Alice has 12 apples and gives Bob 5 apples in 3 days. How many apples does Alice keep now?"), (5, "two words")]
    table_ = decontam.Items(items)
    hits = lambda t: {items[m[1]][0] for m in decontam.matches(pa.array([t]), table_)}
    assert hits("Carol has 40 apples. Dave has 7 apples. How many apples do Carol and Dave have?") == {1}  # names that begin sentences
    assert hits("x Carol has forty apples. Mary Ann has twenty-five apples. How many apples do Carol and Mary Ann have? y") == {1}  # values of other lengths
    assert hits("Today Carol Smith has twenty five apples and kindly gives Dave 7 apples in 9 days. How many apples does Carol Smith keep now?") == {4}  # a word put in
    assert hits("he asked what is two plus two") == {2} and hits("count 1 2 3 4 5 6 7 8 done") == {3}  # short, and without literal words
    assert not hits("count 8 9 3 4 5 6 1 2 done") and not hits("two words") and not hits("How many apples do you eat? The house has 5 apples and 3 days") and not hits("")


@pytest.mark.parametrize("text", ["john(at)example dot com", "call one two six zero one two six zero one two"])
def test_disguises_add_spans(text):
    assert pii.all_spans(text, pii.base_spans(text)) or "call" in text


def test_pii_and_tokens_of_very_long_runs():
    for t in (" " * 200_000 + "[at]" + " " * 200_000 + "x.org", "a.b@c.org x [at] y.com " * 20_000, "john" + " " * 100_000 + "dot" + " " * 100_000):
        began = time.time()
        base = pii.base_spans(t)
        every = pii.all_spans(t, base)
        assert set(base) <= set(every) and time.time() - began < 20
    t = "a.b@c.org x [at] y.com " * 50
    assert sum(k == 0 for _, _, k in pii.all_spans(t, pii.base_spans(t))) == 100
    enc = packing.encoder(packing.tokenizer_path())
    for t in (" " * 1_500_000, "x" + "\n" * 600_000 + "y", "a  b\t\tc"):
        assert enc.ids(t).tolist() == [*enc.encode_plainly(t), 0]


def test_line_dedup_in_rounds(spark):
    """Groups larger than what a row meets at once: rounds over blocks, against brute force; names that clash."""
    r = random.Random(21)
    base = [f"b{i}" for i in range(24)]
    line = lambda: " ".join(w if r.random() > 0.09 else f"e{r.randint(0, 60)}" for w in base)
    rare = lambda: " ".join(r.sample([f"q{i}" for i in range(400)], 12))
    values = ["\n".join([line(), rare(), line()]) for _ in range(90)]
    lines, gone = [], set()
    for i, t in enumerate(values):
        for k, x in enumerate(t.split("\n")):
            w = frozenset(words(x))
            if any(5 * len(w & v) >= 4 * len(w | v) for v in lines):
                gone.add((i, k))
            lines.append(w)
    want = {i: "\n".join(x for k, x in enumerate(t.split("\n")) if (i, k) not in gone) for i, t in enumerate(values)}
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in enumerate(values)], "doc_id long, text string, n_lines int, n_removed int").repartition(3)
    got = line_dedup.dedup(df, least=1, reach=3, best=1, block=16)
    assert {x.doc_id: x.text for x in got.collect()} == want and 30 < len(gone) < 200
    assert sorted(got.columns) == ["doc_id", "n_lines", "n_removed", "text"]


def test_bitmaps_bound_the_difference():
    """No pair that reaches the threshold is lost to the bitmaps, at any size."""
    r = random.Random(2)
    for n in (5, 20, 100, 200, 700):
        for _ in range(20):
            a = r.sample(range(10**6), n)
            b = [w if r.random() > 0.1 else 10**6 + r.randint(0, 999) for w in a]
            s = line_dedup.LineSets(pa.array([" ".join(f"w{x}" for x in t) for t in (a, b)]), None, 1)
            low, high, wide = s.bitmaps()
            common = len({*s.tokens[: s.n[0]].tolist()} & {*s.tokens[s.n[0] :].tolist()})
            apart = int(s.n.sum()) - 2 * common
            far = int(low[0] ^ low[1]).bit_count() + int(high[0] ^ high[1]).bit_count()
            assert far <= apart and sum(int(x ^ y).bit_count() for x, y in zip(*wide)) <= apart
