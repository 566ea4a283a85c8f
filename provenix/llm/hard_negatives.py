"""Hard-negative mining: of each anchor and positive, the best-scored rows of other labels in a band below the positive's score.

Method: Kronecker-packed products. Components are whole numbers; several candidates' components, made non-negative by a bias, stand in separated fields of
one wide integer. One multiplication by an anchor's (biased) component serves all of them, sums over components never run from a field into the next,
and the fields of the total, less what the biases added, are the exact scores. A double holds a whole number of 53 bits and has the fastest products, so it
carries the fields where two or more fit; else a long does, or one of Python's unbounded integers, in the same code.

Scores are computed block against block: anchors in blocks of a fixed size, candidates in groups that stream past them, twice: for the positives,
of equal labels only, and, when their scores are known, for the negatives. A task holds one block of anchors and one batch of candidates.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from provenix.llm.common import Store

ANCHORS, ROWS, BATCH = 512, 16384, 4096  # of a block of anchors; of a group of candidates; scored at once
DOUBLE, LONG, WIDE = 53, 63, 8  # bits of whole numbers in a double and a long; candidates in one of Python's integers
LEAST, MOST = -(1 << 63), (1 << 63) - 1
SCALE = 256


def whole(vectors: np.ndarray) -> np.ndarray:
    """floor(256 * x) of doubles, as 64-bit integers, or as Python's where those are too small."""
    x = np.floor(vectors * float(SCALE)) if not len(vectors) or np.abs(vectors).max(initial=0) < 2.0**53 else None
    if x is not None:
        return x.astype(np.int64)
    return np.array([[int(v) * SCALE if abs(v) >= 2.0**53 else int(np.floor(v * SCALE)) for v in row] for row in vectors.tolist()], object)


def packed_scores(anchors: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """The exact inner products, anchors x candidates, of whole numbers; beyond 64 bits the nearest 64-bit number."""
    n, m, d = len(anchors), len(candidates), anchors.shape[1]
    if not n or not m or not d:
        return np.zeros((n, m), np.int64)
    bias_a, bias_c = max(0, -int(anchors.min())), max(0, -int(candidates.min()))
    width = (d * (int(anchors.max()) + bias_a) * (int(candidates.max()) + bias_c)).bit_length() or 1
    most = (4 * d * (int(abs(anchors).max()) + bias_a) * (int(abs(candidates).max()) + bias_c)).bit_length()  # of anything computed below
    fields, kind = (DOUBLE // width, np.float64) if max(2 * width, most - 10) <= DOUBLE else (LONG // width, np.int64) if max(2 * width, most) <= LONG else (WIDE, object)
    a, c = (x.astype(object if kind is object else np.int64) + bias for x, bias in ((anchors, bias_a), (candidates, bias_c)))
    groups = -(-m // fields)
    # field k of word j has candidate k * groups + j, so that unpacked fields stand side by side
    padded = np.zeros((fields * groups, d), c.dtype)
    padded[:m] = c
    words = sum(padded[k * groups : (k + 1) * groups] << (k * width) for k in range(fields))
    total = a.astype(kind) @ words.astype(kind).T
    total = total.astype(np.int64) if kind is np.float64 else total
    scores = np.concatenate([(total >> (k * width)) & ((1 << width) - 1) for k in range(fields)], axis=1)[:, :m]
    scores = scores - bias_c * a.sum(1)[:, None] - bias_a * c.sum(1)[None, :] + d * bias_a * bias_c
    return scores if kind is not object else np.array([[min(max(x, LEAST), MOST) for x in row] for row in scores.tolist()], np.int64)


def usable(rows: DataFrame) -> DataFrame:
    """(vec_id, label, vector of doubles) of the rows that take part; where vec_id is divisible by 7 the label is the next of ten."""
    odd = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label").cast("long"))
    return rows.where("vec_id is not null and label is not null and embedding is not null").where(~odd).select("vec_id", label.alias("label"), F.col("embedding").cast("array<double>").alias("v"))


def matrix(column: pa.Array, size: int) -> np.ndarray:
    """Vectors as rows; shorter ones end in zeros."""
    n, flat = column.value_lengths().to_numpy(), column.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(n), size))
    out[np.repeat(np.arange(len(n)), n), np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)] = flat
    return out


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties by smaller id."""
    if len(scores) > 4 * k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        near = np.flatnonzero(scores >= least)
        return near[np.lexsort((ids[near], -scores[near]))[:k]]
    return np.lexsort((ids, -scores))[:k]


class Block:
    """A block of anchors and the best candidates so far of each target: (anchor, label wanted or not, least and highest score)."""

    def __init__(self, batch: pa.RecordBatch, same: bool, k: int):
        self.same, self.k = same, k
        self.ids, self.labels = (batch.column(x).to_numpy(zero_copy_only=False) for x in ("vec_id", "label"))
        self.column, self.size = batch.column("v"), -1
        self.bands = [[(x["low"], x["high"]) for x in band] for band in batch.column("band").to_pylist()]
        self.found: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}

    def look(self, batch: pa.RecordBatch) -> None:
        ids, labels, column = batch.column("vec_id").to_numpy(zero_copy_only=False), batch.column("label").to_numpy(zero_copy_only=False), batch.column("v")
        size = max(int(c.value_lengths().to_numpy().max(initial=0)) for c in (self.column, column))
        if size != self.size:
            self.size, self.whole = size, whole(matrix(self.column, size))
        rows = whole(matrix(column, size))
        if self.same:
            for label in np.intersect1d(self.labels, labels):
                mine, theirs = np.flatnonzero(self.labels == label), np.flatnonzero(labels == label)
                scores, theirs_ids = packed_scores(self.whole[mine], rows[theirs]), ids[theirs]
                for i, row in zip(mine, scores):
                    other = theirs_ids != self.ids[i]
                    self.add((i, 0), row[other], theirs_ids[other])
            return
        scores = packed_scores(self.whole, rows)
        for i, band in enumerate(self.bands):
            row, other = scores[i], labels != self.labels[i]
            for j, (low, high) in enumerate(band):
                fits = np.flatnonzero(other & (row >= low) & (row <= high))
                self.add((i, j), row[fits], ids[fits])

    def add(self, key: tuple[int, int], scores: np.ndarray, ids: np.ndarray) -> None:
        if not len(scores):
            return
        if key in self.found:
            scores, ids = np.concatenate((self.found[key][0], scores)), np.concatenate((self.found[key][1], ids))
        at = best(scores, ids, self.k)
        self.found[key] = scores[at], ids[at]

    def rows(self) -> pa.RecordBatch:
        out = [(int(self.ids[i]), j, int(n), int(s)) for (i, j), (scores, ids) in self.found.items() for s, n in zip(scores, ids)]
        return pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], pa.int32() if c == 1 else pa.int64()) for c in range(4)], ["anchor_id", "target", "other_id", "score"])


def scored(anchors: DataFrame, rows: DataFrame, n_anchors: int, n_rows: int, same: bool, k: int) -> DataFrame:
    """anchors(vec_id, label, v, band), rows(vec_id, label, v) -> (anchor_id, target, other_id, score): each group's k best of each target.

    Anchors are dealt into blocks and rows into groups by hashes of the whole row; each block meets each group in a cell of its own.
    """
    blocks, groups = max(1, -(-n_anchors // ANCHORS)), max(1, -(-n_rows // ROWS))
    place = lambda n: F.pmod(F.xxhash64("vec_id", "label", "v"), F.lit(n)).cast("int")
    spread = lambda n, name: F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(name)
    band = "array<struct<low: long, high: long>>"
    one = anchors.select(place(blocks).alias("block"), spread(groups, "grp"), F.lit(0).alias("kind"), "vec_id", "label", "v", F.col("band").cast(band).alias("band"))
    two = rows.select(spread(blocks, "block"), place(groups).alias("grp"), F.lit(1).alias("kind"), "vec_id", "label", "v", F.lit(None).cast(band).alias("band"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, block = None, [], None

        def met() -> Block:
            return Block(pa.Table.from_batches(held).combine_chunks().to_batches()[0], same, k)

        for batch in batches:
            keys = np.stack([batch.column(x).to_numpy() for x in ("block", "grp", "kind")])
            cuts = np.r_[0, np.flatnonzero((np.diff(keys) != 0).any(0)) + 1, batch.num_rows]
            for at, end in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                b, g, kind = keys[:, at].tolist()
                if (b, g) != now:
                    if block:
                        yield block.rows()
                    now, held, block = (b, g), [], None
                if kind == 0:
                    held.append(batch.slice(at, end - at))
                elif held:
                    block = block or met()
                    for x in range(at, end, BATCH):
                        block.look(batch.slice(x, min(BATCH, end - x)))
        if block:
            yield block.rows()

    # a cell is one place in the hash of its key, and anchors come first in it
    both = one.unionByName(two).repartition(min(10_000, max(blocks * groups, 1)), "block", "grp").sortWithinPartitions("block", "grp", "kind")
    return both.mapInArrow(run, "anchor_id long, target int, other_id long, score long")


def mine(rows: DataFrame, positives: int = 5, negatives: int = 10, every: int = 100) -> DataFrame:
    """rows(vec_id, label, embedding) -> (anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Rows with a null vec_id, label or vector, or a null or non-finite component, take no part. Vectors of unequal lengths are compared as if the shorter ended
    in zeros; an empty vector scores zero. "Other rows" are those of another vec_id; a row that occurs twice takes part twice, an anchor's result is given once
    (of anchors that share a vec_id, the smallest stands for them). Scores beyond 64 bits count as the nearest 64-bit number.
    Anchors and positives without a negative have no row. An empty table gives an empty one. Other columns are not read.
    """
    store = Store(rows.sparkSession, "negatives")
    read = store.keep(usable(rows))
    picked = read.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("x")).select("vec_id", "x.label", "x.v")
    anchors = store.keep(picked)
    n_anchors, n_rows = anchors.count(), read.count()
    first = lambda df, k, *by: df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), "other_id"))).where(F.col("rank") <= k)

    near = first(scored(anchors.withColumn("band", F.array()), read, n_anchors, n_rows, True, positives), positives, "anchor_id")
    of = store.keep(near.groupBy("anchor_id").agg(F.array_sort(F.collect_list(F.struct("rank", F.col("other_id").alias("positive_id"), F.col("score").alias("positive_score")))).alias("positives")))  # at most ``positives`` each
    # 30 p <= 100 n <= 90 p
    band = F.expr("transform(positives, p -> named_struct('low', cast(ceil(cast(p.positive_score as decimal(20,0)) * 3 / 10) as bigint), 'high', cast(floor(cast(p.positive_score as decimal(20,0)) * 9 / 10) as bigint)))")
    targets = anchors.join(of, anchors.vec_id == of.anchor_id).select("vec_id", "label", "v", band.alias("band"))
    far = first(scored(targets, read, n_anchors, n_rows, False, negatives), negatives, "anchor_id", "target")
    named = of.select("anchor_id", F.posexplode("positives").alias("target", "p")).select("anchor_id", "target", "p.positive_id", "p.positive_score")
    return far.join(named, ["anchor_id", "target"]).select("anchor_id", "positive_id", F.col("rank").cast("int"), F.col("other_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


ORACLE = r"""
with e as (select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end label, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) v from embeddings
    where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select a.vec_id anchor_id, b.vec_id other_id, a.label = b.label same, list_sum(list_transform(list_zip(a.v, b.v), lambda x: x[1] * x[2]))::bigint score from e a join e b on a.vec_id <> b.vec_id where a.vec_id % 100 = 0),
p as (select anchor_id, other_id positive_id, score positive_score from s where same qualify row_number() over (partition by anchor_id order by score desc, other_id) <= 5),
n as (select s.anchor_id, positive_id, row_number() over (partition by s.anchor_id, positive_id order by score desc, other_id)::int rank, other_id negative_id, positive_score, score negative_score
    from p join s on s.anchor_id = p.anchor_id and not same and 30 * positive_score <= 100 * score and 100 * score <= 90 * positive_score)
select anchor_id, positive_id, rank, negative_id, positive_score, negative_score from n where rank <= 10
"""
