"""Toxic spans by a linear-chain conditional random field.

Labels mark whole documents, so tokens are labelled first: words and stems that stand in toxic documents far more often than chance allows are picked one
after another until they explain the toxic documents, and in those documents their tokens count as toxic. The field is fitted on these tokens, over words,
stems, endings, neighbours and shape. Forward-backward marginals tag tokens. Their sum over a document, the probability that not every token is clean, and the
number of tokens make its score, by a logistic curve fitted on the same sample.

Documents are one chain with a clean token between any two. With two tags the forward recursion is a fraction r -> e (b + d r) / (1 + c r) of the odds
r of "toxic"; such fractions compose as 2 x 2 matrices, so the chain is cut into equal pieces that run side by side.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provenix.llm.common import pieces
from provenix.llm.words import BYTE_CODES, LOWER, U, mix, span_hashes, spans_of, utf8

TOKEN = np.zeros(256, bool)
TOKEN[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
STOP = np.zeros(256, np.int64)
STOP[[0x0A, 0x21, 0x2E, 0x3F]] = 1
#: Stems are the first so many bytes of a longer word, endings the last.
STEMS, ENDINGS = (3, 4, 5, 6, 7, 8), (3, 4)
WORD, PREVIOUS, NEXT, SHAPE = 0, 20, 21, 22
#: The sample that is collected to fit on: rows of each label, and the longest text (so 24 million characters at most); documents that the field itself is fitted on.
TOXIC_ROWS, CLEAN_ROWS, LONGEST, FIT_ROWS = 1000, 2000, 8000, 1200
CHANCE = 0.01  # that any of the words picked is picked by chance
PIECES = 1024


class Tokens:
    """All tokens of all texts; ``hashes[kind]`` are the features of a kind, zero where a token has none."""

    def __init__(self, column: pa.Array, kinds: bool = True):
        self.data, self.offsets = utf8(column)
        self.starts, self.ends = spans_of(TOKEN[self.data], self.offsets)
        self.text = np.searchsorted(self.offsets, self.starts, side="right") - 1
        self.size = np.diff(np.searchsorted(self.starts, self.offsets))
        codes = BYTE_CODES[LOWER[self.data]]
        length = self.ends - self.starts

        def some(which: np.ndarray, kind: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
            out = np.zeros(len(length), U)
            out[which] = mix(span_hashes(codes, starts[which], ends[which]) + U(kind + 1))
            return out

        every = np.ones(len(length), bool)
        self.hashes = {WORD: some(every, WORD, self.starts, self.ends)}
        for k in STEMS:
            self.hashes[k] = some(length > k, k, self.starts, self.starts + k)
        if kinds:
            for k in ENDINGS:
                self.hashes[k + 10] = some(length > k, k + 10, self.ends - k, self.ends)
            word, same = self.hashes[WORD], np.diff(self.text) == 0
            for kind, at, of in ((PREVIOUS, slice(1, None), slice(None, -1)), (NEXT, slice(None, -1), slice(1, None))):
                out = np.zeros(len(length), U)
                out[at] = np.where(same, mix(word[of] + U(kind + 1)), U(0))
                self.hashes[kind] = out
            if len(length):
                # capital or not, the first of a sentence or not, before a capital or not
                head, second = self.data[self.starts], np.r_[self.data, 0][self.starts + 1]
                capital = (head >= 0x41) & (head <= 0x5A) | (head == 0xC3) & (second >= 0x80) & (second <= 0x9E)
                stops = np.cumsum(np.r_[0, STOP[self.data]])
                opens = np.r_[True, stops[self.starts[1:]] > stops[self.ends[:-1]]] | np.r_[True, ~same]
                follows = np.r_[capital[1:] & same & ~opens[1:], False]
                self.hashes[SHAPE] = mix((capital + 2 * opens + 4 * follows + 8).astype(U) + U(SHAPE << 8))


class Gathered:
    """The tokens of many texts, read a few texts at a time: of each its text and its features, of each text its number of tokens."""

    def __init__(self, column: pa.Array, at_once: int = 64):
        parts = [Tokens(column.slice(i, at_once)) for i in range(0, len(column), at_once)] or [Tokens(column)]
        self.hashes = {k: np.concatenate([p.hashes[k] for p in parts]) for k in parts[0].hashes}
        self.text = np.concatenate([p.text + i * at_once for i, p in enumerate(parts)])
        self.size = np.concatenate([p.size for p in parts])


@dataclass
class Model:
    """features: sorted hashes; weights: theirs; bias of "toxic"; odds of the steps clean-toxic, toxic-clean, toxic-toxic against clean-clean."""

    features: np.ndarray
    weights: np.ndarray
    bias: float
    steps: tuple[float, float, float]
    curve: np.ndarray | None = None  # of the logistic over ``signs``

    def __post_init__(self):
        self.near = np.zeros(1 << 20, bool)
        self.near[(self.features >> U(44)).astype(np.int64)] = True

    def places(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Tokens that have a known feature of this kind, and its place."""
        at = np.flatnonzero(self.near[(hashes >> U(44)).view(np.int64)])
        place = np.minimum(np.searchsorted(self.features, hashes[at]), max(0, len(self.features) - 1))
        known = self.features[place] == hashes[at]
        return at[known], place[known]

    def energies(self, tokens: Tokens | Gathered) -> np.ndarray:
        out = np.full(len(tokens.text), self.bias)
        if len(self.features):
            for hashes in tokens.hashes.values():
                at, place = self.places(hashes)
                out[at] += self.weights[place]
        return out


def _scan(odds: np.ndarray, out_of: float, into: float, stay: float) -> np.ndarray:
    """r[t] = odds[t] * (into + stay * r[t-1]) / (1 + out_of * r[t-1]), from r = 0."""
    n = len(odds)
    wide = min(PIECES, max(1, n // 64))
    deep = -(-n // wide)
    e = np.zeros(wide * deep)
    e[:n] = odds
    e = np.ascontiguousarray(e.reshape(wide, deep).T)
    # (1, r) -> (1 + out_of r, odds (into + stay r)), composed over each piece but the last
    a, b, c, d = np.ones(wide), np.zeros(wide), np.zeros(wide), np.ones(wide)
    for x in e:
        a, b, c, d = a + out_of * c, b + out_of * d, x * (into * a + stay * c), x * (into * b + stay * d)
        most = np.maximum(np.maximum(a, b), np.maximum(c, d))
        a, b, c, d = a / most, b / most, c / most, d / most
    r, begin = 0.0, np.zeros(wide)
    for i, (a1, b1, c1, d1) in enumerate(zip(a.tolist(), b.tolist(), c.tolist(), d.tolist())):
        begin[i] = r
        r = (c1 + d1 * r) / (a1 + b1 * r)
    out, r = np.empty_like(e), begin
    for i, x in enumerate(e):
        r = x * (into + stay * r) / (1 + out_of * r)
        out[i] = r
    return out.T.reshape(-1)[:n]


class Chain:
    """Tokens in one chain, a clean one before each text and one at the end; at: the place of each token."""

    def __init__(self, tokens: Tokens | Gathered):
        self.text, self.size = tokens.text, tokens.size
        self.at = np.arange(len(self.text)) + self.text + 1
        self.n = len(self.text) + len(self.size) + 1

    def run(self, energies: np.ndarray, steps: tuple[float, float, float]) -> None:
        into, out_of, stay = steps
        self.odds = np.zeros(self.n)
        self.odds[self.at] = np.exp(np.clip(energies, -60, 60))
        self.ahead = _scan(self.odds, out_of, into, stay)
        # backwards: s[t] = (out_of + stay q) / (1 + into q), q = odds[t+1] s[t+1]; q obeys the same recursion
        q = _scan(self.odds[::-1], into, out_of, stay)[::-1]
        q_next = np.r_[q[1:], 0.0]
        self.back = (out_of + stay * q_next) / (1 + into * q_next)

    def marginals(self) -> np.ndarray:
        x = self.ahead * self.back
        return x / (1 + x)

    def by_text(self, x: np.ndarray) -> np.ndarray:
        return np.bincount(self.text, x, len(self.size))

    def log_clean(self, out_of: float) -> np.ndarray:
        """By text, the log probability that all its tokens are clean."""
        return -self.by_text(np.log1p(out_of * self.ahead[self.at]))

    def signs(self, out_of: float) -> tuple[np.ndarray, np.ndarray]:
        """Of each token, its marginal; of each text, what its score is made of."""
        p, clean = self.marginals()[self.at], self.log_clean(out_of)
        return p, np.stack([np.ones(len(clean)), np.clip(np.log(-np.expm1(clean) + 1e-12) - clean, -12, 12), np.log1p(self.by_text(p)), np.log1p(self.size)], axis=1)


def _gain(hit: np.ndarray, clean: np.ndarray, rate: float) -> np.ndarray:
    """How far, by a Chernoff bound, chance is out of the question that of ``hit + clean`` texts so many are toxic; -1 where most are clean or one is."""
    n = hit + clean
    share = np.divide(hit, n, out=np.zeros(len(n)), where=n > 0)
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = n * (np.where(share > 0, share * np.log(share / rate), 0) + np.where(share < 1, (1 - share) * np.log((1 - share) / (1 - rate)), 0))
    return np.where((share >= 0.5) & (hit >= 2), gain, -1)


def _distinct(code: np.ndarray, what: np.ndarray, size: int) -> np.ndarray:
    """Of each code, how many different things it stands with."""
    order = np.lexsort((what, code))
    code, what = code[order], what[order]
    return np.bincount(code[np.r_[True, (np.diff(code) != 0) | (what[1:] != what[:-1])]] if len(code) else code, minlength=size)


def indicators(tokens: Tokens | Gathered, toxic: np.ndarray) -> set[int]:
    """Hashes of words and stems that tell toxic texts.

    Chance must be out of the question even for the best of all features tried. First on all texts, most telling feature first, each on the words that
    those before it left over; a feature counts as often as it has neighbours of its own, so that copies of one text are no evidence. Then on the toxic texts that
    hold none of these.
    """
    if not toxic.any() or toxic.all() or not len(tokens.text):
        return set()
    found: dict[int, None] = {}
    names, codes, texts, at_tokens, clean, n_names = [], [], [], [], [], 0
    for k, h in tokens.hashes.items():
        if k != WORD and k not in STEMS:
            continue
        u, code, times = np.unique(h, return_inverse=True, return_counts=True)
        keep = (times >= 2) & (u != 0)  # what occurs once tells nothing
        rank, at = np.cumsum(keep) - 1, np.flatnonzero(keep[code])
        code, of = rank[code[at]], toxic[tokens.text[at]]
        few = np.bincount(code[of], minlength=keep.sum()) >= 2
        without = np.flatnonzero(~of & few[code])
        clean.append(_distinct(code[without], tokens.text[at[without]], len(few))[few])
        at, code = (x[of & few[code]] for x in (at, code))
        codes.append((np.cumsum(few) - 1)[code] + sum(map(len, names)))
        at_tokens.append(at)
        names.append(u[keep][few])
        n_names += len(u)
    names, code, at, clean = (np.concatenate(x) for x in (names, codes, at_tokens, clean))
    clean, bar, around = clean.astype(float), np.log(max(1, n_names) / CHANCE), tokens.hashes[PREVIOUS] ^ (tokens.hashes[NEXT] << U(1))

    def shrink(keep: np.ndarray) -> None:
        nonlocal names, code, at, clean
        code, at = (x[keep[code]] for x in (code, at))
        names, clean, code = names[keep], clean[keep], (np.cumsum(keep) - 1)[code]

    everything = names, code, at, clean
    rate = float(toxic.mean())
    shrink(_gain(_distinct(code, tokens.text[at], len(names)).astype(float), clean, rate) > bar)
    while len(code):
        gain = _gain(np.minimum(_distinct(code, tokens.text[at], len(names)), _distinct(code, around[at], len(names))).astype(float), clean, rate)
        best = int(gain.argmax())
        if gain[best] <= bar:
            break
        found[int(names[best])] = None
        stay = ~np.isin(at, at[code == best])
        code, at = code[stay], at[stay]

    names, code, at, clean = everything
    left, text = toxic.copy(), tokens.text[at]
    left[text[np.isin(names, np.fromiter(found, U, len(found)))[code]]] = False
    while left.any():
        open_ = left[text]
        best = int((gain := _gain(_distinct(code[open_], text[open_], len(names)).astype(float), clean, left.sum() / (left.sum() + (~toxic).sum()))).argmax()) if len(names) else 0
        if not len(names) or gain[best] <= bar:
            break
        found[int(names[best])] = None
        left[text[code == best]] = False
    return set(found)


def _curve(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Logistic regression by Newton's method."""
    theta = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -40, 40)))
        slope = x.T @ (weight * (y - p)) - ridge * theta
        theta = theta + np.linalg.solve((x * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + ridge * np.eye(len(theta)), slope)
    return theta


def _field(tokens: Tokens | Gathered, tags: np.ndarray, telling: np.ndarray, rounds: int, penalty: float) -> Model:
    """Maximises the penalised likelihood of the tags; features are those of telling words and what two or more toxic tokens have."""
    seen = [np.unique(h[(tags > 0) & (h != 0)], return_counts=True) for h in tokens.hashes.values()]
    features = np.unique(np.concatenate([x[n >= 2] for x, n in seen] + [telling]))
    k, model = len(features), Model(features, np.zeros(len(features)), float(np.log((tags.sum() + 1) / (len(tags) + 2))), (1.0, 1.0, 1.0))
    at, place = (np.concatenate(x) for x in zip(*(model.places(h) for h in tokens.hashes.values())))
    chain = Chain(tokens)
    y = np.zeros(chain.n)
    y[chain.at] = tags
    y0 = np.r_[0.0, y[:-1]]
    # full-batch gradients; steps grow while a gradient keeps its sign (Rprop)
    theta = np.r_[model.weights, model.bias, 0.0, 0.0, 0.0]
    pace, last = np.full(len(theta), 0.3), np.zeros(len(theta))
    for _ in range(rounds):
        into, out_of, stay = steps = tuple(np.exp(theta[k + 1 :]).tolist())
        chain.run(np.bincount(at, theta[place], minlength=len(tags)) + theta[k], steps)
        before, after = np.r_[0.0, chain.ahead[:-1]], chain.odds * chain.back
        z = (1 + out_of * before) + after * (into + stay * before)
        off = (chain.marginals() - y)[chain.at]
        both = [(after * into / z - (1 - y0) * y).sum(), (before * out_of / z - y0 * (1 - y)).sum(), (after * stay * before / z - y0 * y).sum()]
        slope = np.r_[np.bincount(place, off[at], minlength=k), off.sum(), both]
        slope[:k] += penalty * theta[:k]
        slope[k + 1 :] += penalty * theta[k + 1 :]
        same = np.sign(slope * last)
        pace = np.clip(np.where(same > 0, pace * 1.2, np.where(same < 0, pace * 0.5, pace)), 1e-4, 1.0)
        last = np.where(same < 0, 0.0, slope)
        theta = theta - np.sign(last) * pace
    return Model(features, theta[:k].copy(), float(theta[k]), tuple(np.exp(theta[k + 1 :]).tolist()))


def fit(column: pa.Array, toxic: np.ndarray, share: float | None = None, rounds: int = 40, penalty: float = 0.05) -> Model:
    """A model of labelled texts; share: that of toxic texts where it will be used (the sample's own). Deterministic.

    Without toxic texts, or a word that tells them, the model calls every text clean, with the share as its score.
    """
    share = share if share is not None else float(toxic.mean()) if len(toxic) else 0.0
    tokens = Gathered(column)
    telling = np.fromiter(indicators(tokens, toxic), U)
    if not len(telling):
        share = min(max(share, 1e-6), 0.499)
        return Model(np.zeros(0, U), np.zeros(0), -60.0, (1.0, 1.0, 1.0), np.array([np.log(share / (1 - share)), 0, 0, 0]))

    def tagged(tokens: Gathered, toxic: np.ndarray) -> np.ndarray:
        hit = np.zeros(len(tokens.text), bool)
        for k, h in tokens.hashes.items():
            if k == WORD or k in STEMS:
                hit |= np.isin(h, telling)
        return hit & toxic[tokens.text]

    explained = np.zeros(len(toxic), bool)
    explained[tokens.text[tagged(tokens, toxic)]] = True  # toxic texts that nothing explains have unknown tags
    some = np.sort(np.concatenate([np.flatnonzero(explained)[: FIT_ROWS // 3], np.flatnonzero(~toxic)[: FIT_ROWS - FIT_ROWS // 3]]))
    part = Gathered(column.take(pa.array(some)))
    model = _field(part, tagged(part, toxic[some]).astype(float), telling, rounds, penalty)
    chain = Chain(tokens)
    chain.run(model.energies(tokens), model.steps)
    _, x = chain.signs(model.steps[1])
    own = toxic.mean()
    model.curve = _curve(x, toxic.astype(float), np.where(toxic, share / own, (1 - share) / (1 - own)))
    return model


def held_out(doc_id: Column) -> Column:
    """Rows that nothing is learned from: crc32 of the id as text (a null id: of '') divisible by 5."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 5 == 0


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Fits on a sample: of the labelled rows that aren't held out, at most TOXIC_ROWS toxic and CLEAN_ROWS clean ones, in the order of a hash of their id, of
    those the texts of at most LONGEST characters. An id with several labels is toxic if one says so; of several texts of an id the smallest counts."""
    known = labels.where("doc_id is not null and toxic in (0, 1)").where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    order = F.xxhash64("doc_id")
    picked = [known.where(F.col("toxic") == v).orderBy(order, "doc_id").limit(n) for v, n in ((1, TOXIC_ROWS), (0, CLEAN_ROWS))]
    sample = F.broadcast(picked[0].unionByName(picked[1]))  # at most TOXIC_ROWS + CLEAN_ROWS rows of two numbers
    texts = docs.select("doc_id", "text").where(F.length("text") <= LONGEST).join(sample, "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    got = texts.toArrow().sort_by("doc_id")
    share = known.agg(F.avg(F.col("toxic").cast("double"))).first()[0]
    return fit(got.column("text").combine_chunks() if got.num_rows else pa.array([], pa.string()), got.column("toxic").to_numpy().astype(bool), share)


def spans_text(tokens: Tokens, tagged: np.ndarray) -> list[str]:
    """By text, start:end of each tagged run of tokens, in code points, end exclusive."""
    out = [""] * (len(tokens.offsets) - 1)
    if len(tagged):
        points = np.cumsum(np.r_[0, (tokens.data & 0xC0) != 0x80])
        base = points[tokens.offsets[tokens.text[tagged]]]
        begin, end = points[tokens.starts[tagged]] - base, points[tokens.ends[tagged]] - base
        text = tokens.text[tagged]
        joins = np.r_[False, (np.diff(tagged) == 1) & (np.diff(text) == 0)]
        heads = np.flatnonzero(~joins)
        tails = np.r_[heads[1:], len(tagged)] - 1
        for t, b, e in zip(text[heads].tolist(), begin[heads].tolist(), end[tails].tolist()):
            out[t] += f"{',' if out[t] else ''}{b}:{e}"
    return out


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score double, n_toxic long, spans string) of every row of docs, from the text alone.

    score: the probability that the text is toxic; n_toxic: tokens whose marginal is a half or more; spans: their runs as start:end in code points. Scores are
    rounded to nine digits, so as not to depend on the texts that one is read with. A null,
    empty or wordless text scores as one of no tokens, close to 0. Repeated rows score alike. Memory is bounded by about 4 MB of text, or one longer text.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            tokens = Tokens(batch.column(1))
            chain = Chain(tokens)
            chain.run(model.energies(tokens), model.steps)
            p, x = chain.signs(model.steps[1])
            tagged = np.flatnonzero(p >= 0.5)
            n = np.bincount(tokens.text[tagged], minlength=batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.round(1 / (1 + np.exp(-np.clip(x @ model.curve, -40, 40))), 9)), pa.array(n.astype(np.int64)), pa.array(spans_text(tokens, tagged), pa.string())], ["doc_id", "score", "n_toxic", "spans"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double, n_toxic long, spans string")


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted, n_toxic, spans) of every row of docs, by a model of labels(doc_id, toxic)."""
    each = score(docs, train(docs, labels))
    return each.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_toxic", "spans")
