"""SimHash near-duplicates: 64-bit fingerprints of word shingles, linked at three or fewer differing bits.

Method: meet in the middle. Of two fingerprints at distance three, one lies one bit and the other two bits
from a common variant, so each sends out the ball of half the radius and equal variants meet. Two savings keep
the ball small and lose no link. (1) Distance three joins an even and an odd number of set bits, so only odd
ones need two flips. (2) Of three flipped bits, two lie in the same half, so only pairs of bits in one half are
flipped. Variants that differ in one half only share the other half, and travel as one row keyed by it; they
are unfolded after the shuffle, beside the rest of their variant's group.

At one variant, everything within one flip is within three bits of all others there, so a star around the
smallest such fingerprint has every link's component and no pair is formed twice.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from provenix.llm.common import pieces, settle, width
from provenix.llm.components import connected_components
from provenix.llm.words import U, Words

RADIUS = 3
# Fixed values of XXH64.
P1, P2, P3, P4, P5 = (U(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def _turn(x: np.ndarray, by: int) -> np.ndarray:
    return (x << U(by)) | (x >> U(64 - by))


def xxh64_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 42) -> np.ndarray:
    """XXH64 of data[start:end] for many spans: those under 32 bytes all at once, longer ones by the library."""
    size = ends - starts
    out = np.zeros(len(starts), U)
    long = np.flatnonzero(size >= 32)
    raw = data.tobytes()
    for i, s, e in zip(long.tolist(), starts[long].tolist(), ends[long].tolist()):
        out[i] = xxhash.xxh64_intdigest(raw[s:e], seed)
    short = np.flatnonzero(size < 32)
    if not len(short):
        return out
    raw += bytes(40)
    lanes = np.ndarray((len(raw) - 7,), "<u8", raw, strides=(1,))
    fours = np.ndarray((len(raw) - 7,), "<u4", raw, strides=(1,))
    octets = np.frombuffer(raw, np.uint8)
    s, n = starts[short], size[short]
    h = U(seed) + P5 + n.astype(U)
    whole = n >> 3
    for k in range(3):
        has = np.flatnonzero(whole > k)
        h[has] = _turn(h[has] ^ (_turn(lanes[s[has] + 8 * k] * P2, 31) * P1), 27) * P1 + P4
    at = s + 8 * whole
    has = np.flatnonzero(n & 4)
    h[has] = _turn(h[has] ^ (fours[at[has]].astype(U) * P1), 23) * P2 + P3
    at = at + (n & 4)
    for k in range(3):
        has = np.flatnonzero((n & 3) > k)
        h[has] = _turn(h[has] ^ (octets[at[has] + k].astype(U) * P5), 11) * P1
    h = (h ^ (h >> U(33))) * P2
    h = (h ^ (h >> U(29))) * P3
    out[short] = h ^ (h >> U(32))
    return out


def majority(h: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Of consecutive groups of hashes, the 64-bit word of the bits set in over half; an empty group gives zero."""
    cut = 255  # eight byte counters in a word hold so many without a carry
    parts = -(-counts // cut)
    out = np.zeros(len(counts), U)
    if not len(h):
        return out
    owner = np.repeat(np.arange(len(counts)), parts)
    begin = np.concatenate(([0], np.cumsum(counts)[:-1]))
    nth = np.arange(len(owner)) - np.repeat(np.concatenate(([0], np.cumsum(parts)[:-1])), parts)
    at = begin[owner] + nth * cut
    lead = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
    full = np.flatnonzero(counts)
    for b in range(8):
        sums = np.add.reduceat((h >> U(b)) & U(0x0101010101010101), at)
        lanes = sums.astype("<u8").view(np.uint8).reshape(-1, 8).astype(np.int64)
        each = np.add.reduceat(lanes, lead, axis=0)
        bits = (2 * each > counts[full][:, None]).astype(U)
        for byte in range(8):
            out[full] |= bits[:, byte] << U(8 * byte + b)
    return out


def shingles_of(column: pa.Array, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the word shingles of all texts, one text after another, and how many each has; a shorter text is one shingle."""
    words = Words(column)
    data, starts, ends = words.joined(lower=True)
    n = np.diff(words.first)
    count = np.where(n >= shingle, n - shingle + 1, np.minimum(n, 1))
    first = words.first[:-1]
    owner = np.repeat(np.arange(len(n)), count)
    at = first[owner] + np.arange(len(owner)) - np.repeat(np.concatenate(([0], np.cumsum(count)[:-1])) if len(count) else count, count)
    last = at + np.minimum(n[owner], shingle) - 1
    return xxh64_spans(data, starts[at], ends[last]), count


def fingerprints_of(column: pa.Array, shingle: int) -> np.ndarray:
    return majority(*shingles_of(column, shingle))


def fingerprints(docs: DataFrame, shingle: int = 3, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(keys, fp long) for every row of docs. A null or wordless text has fingerprint zero."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, most=1 << 20):
            fp = fingerprints_of(batch.column(len(keys)), shingle).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keys)], pa.array(fp)], [*keys, "fp"])

    read = docs.select(*keys, "text")
    return read.mapInArrow(run, ", ".join(f"{k} {read.schema[k].dataType.simpleString()}" for k in keys) + ", fp long")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def links(prints: DataFrame) -> DataFrame:
    """prints(fp), distinct -> links (a, b), a star in each variant's group; all within the radius."""
    n = width(prints.sparkSession)
    even = F.expr("bit_count(fp) % 2 = 0")
    high, low = F.expr("shiftrightunsigned(fp, 32)"), F.expr("fp & 4294967295")
    # kind 0: keyed by the high half, its variants differ in the low half; kind 1 the other way round
    one = lambda op, kind, half: F.struct(F.lit(op).alias("op"), F.lit(kind).alias("kind"), half.alias("half"))
    single = lambda k, kind: F.struct(F.lit(k + 10).alias("op"), F.lit(kind).alias("kind"), (high.bitwiseXOR(F.lit(1 << (k - 32))) if k >= 32 else low.bitwiseXOR(F.lit(1 << k))).alias("half"))
    outs_even = F.array(one(0, 0, high), one(1, 1, low), *(single(k, 0) for k in range(32, 64)), *(single(k, 1) for k in range(32)))
    outs_odd = F.array(one(2, 0, high), one(3, 1, low), *(single(k, 0) for k in range(32, 64)))
    sent = prints.select("fp", F.explode(F.when(even, outs_even).otherwise(outs_odd)).alias("o")).select("fp", "o.op", "o.kind", "o.half").repartition(n, "kind", "half")

    lows, highs = [1 << k for k in range(32)], [_signed(1 << k) for k in range(32, 64)]
    pairs = lambda bits: [_signed((a | b) & ((1 << 64) - 1)) for i, a in enumerate(bits) for b in bits[:i]]
    many = lambda xs: F.expr("array(" + ",".join(f"{x}L" if x > -(1 << 63) else "shiftleft(1L, 63)" for x in xs) + ")")
    masks = (
        F.when(F.col("op") == 0, many(lows)).when(F.col("op") == 1, many(highs))
        .when(F.col("op") == 2, many([0, *lows, *pairs(lows)])).when(F.col("op") == 3, many(pairs(highs)))
        .otherwise(F.array(F.expr("shiftleft(1L, op - 10)")))
    )
    met = sent.select("kind", "half", "fp", F.explode(masks).alias("mask")).withColumn("variant", F.expr("fp ^ mask"))
    group = Window.partitionBy("kind", "half", "variant")
    near = F.min(F.when(F.expr("bit_count(mask) = 1"), F.col("fp"))).over(group)
    self = F.min(F.when(F.expr("mask = 0"), F.col("fp"))).over(group)
    return met.select(F.col("fp").alias("b"), F.coalesce(near, self).alias("a")).where("a is not null and a <> b").where(f"bit_count(a ^ b) <= {RADIUS}").distinct()


def near_duplicates(docs: DataFrame, shingle: int = 3, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(keys, fp, component_id): component_id is the smallest doc_id (or struct of keys) reachable over links of at most three bits.

    Every row of docs gives one row, repeated ids and null ids included (a null id never is the smallest).
    Only the keys and text are read. An empty table gives an empty one.
    """
    each = settle(fingerprints(docs, shingle, keys))
    prints = each.groupBy("fp").agg(F.min(keys[0] if len(keys) == 1 else F.struct(*keys)).alias("least"))
    parts = connected_components(links(prints.select("fp")))
    label = prints.join(parts, prints.fp == parts.node, "left").select("fp", "least", F.coalesce("component", "fp").alias("label"))
    named = label.join(label.groupBy("label").agg(F.min("least").alias("component_id")), "label").select("fp", "component_id")
    return each.join(named, "fp").select(*keys, "fp", "component_id")


def keep_one(docs: DataFrame, shingle: int = 5) -> DataFrame:
    """The rows of docs, with their columns, of which each is the smallest (doc_id, text hash) of its near-duplicates; one of equal rows."""
    own = docs.columns
    keyed = docs.select(F.struct(*own).alias("_row"), F.coalesce("doc_id", F.lit(-(1 << 63))).alias("key_id"), F.xxhash64("text").alias("key_text"), "text")
    found = near_duplicates(keyed, shingle, ("key_id", "key_text"))
    kept = found.select("component_id.key_id", "component_id.key_text").distinct()
    return keyed.join(kept, ["key_id", "key_text"], "left_semi").dropDuplicates(["key_id", "key_text"]).select("_row.*")


def hexed(fp: str = "fp") -> F.Column:
    return F.lower(F.lpad(F.hex(F.col(fp)), 16, "0"))
