"""Best-fit packing: documents into sequences of at most 2048 tokens, by length patterns fitted to the length histogram.

1. Every text is tokenized where it is read; only (document, piece, length, checksum) rows leave that step.
2. The histogram of lengths (at most 2048 numbers) goes to the driver. Patterns of up to three coarse lengths that fill a
   sequence are enumerated, and non-negative least squares finds how often each should be used.
3. Counts are rounded down and exact lengths that fill a sequence to the last token take the patterns' slots; what is left is
   packed best fit, longest first. The plan says "n sequences with these lengths"; its size depends on the number of lengths only.
4. Every piece gets its number among the pieces of equal length (counted in two steps, so that one very common length
   is spread over many tasks) and reads its sequence and offset from the plan.
"""

from __future__ import annotations

import bisect
import json
import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from provenix.llm.common import pieces, settle, width

CONTEXT = 2048
GRID = 128  # coarse lengths for the least squares


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


SPLIT = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|"  # fixed value: the split of such byte-level BPE files


LONG_RUN = r"\s{4096}"


class Encoder:
    """The ids that ``tokenizers`` gives for a byte-level BPE file, found five times faster by ``tiktoken`` from the same file.

    Where no two white-space characters stand together, the split needs no look-ahead, which is faster again. The look-ahead steps back over
    a run of white space and has a bounded stack, so a text with a very long run goes to ``tokenizers`` itself.
    """

    def __init__(self, path: str):
        import tiktoken

        self.path, self.plain = path, None
        spec = json.load(open(path, encoding="utf-8"))
        if spec["normalizer"] is not None or spec["pre_tokenizer"]["type"] != "ByteLevel" or spec["pre_tokenizer"]["add_prefix_space"]:
            self.encode = self.encode_spaced = self.encode_plainly
            return
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]  # the bytes that stand for themselves in such files
        letters = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(sorted({*range(256)} - {*printable}))}
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ranks = {bytes(letters[c] for c in k): v for k, v in spec["model"]["vocab"].items() if k not in special}
        with_ = lambda end: tiktoken.Encoding("bytes" + end, pat_str=SPLIT + end, mergeable_ranks=ranks, special_tokens=special)
        near, far = with_(r"\s"), with_(r"\s+(?!\S)|\s+")
        self.encode = lambda t: near.encode(t, allowed_special="all", disallowed_special=())
        self.encode_spaced = lambda t: far.encode(t, allowed_special="all", disallowed_special=())

    def ids(self, text: str | None) -> np.ndarray:
        """The ids of a text, then id 0."""
        if not text:
            return np.zeros(1, "<u4")
        how = self.encode if not re.search(r"\s\s", text) else self.encode_plainly if re.search(LONG_RUN, text) else self.encode_spaced
        return np.array([*how(text), 0], "<u4")

    def encode_plainly(self, text: str) -> list[int]:
        from tokenizers import Tokenizer

        self.plain = self.plain or Tokenizer.from_file(self.path)
        return self.plain.encode(text, add_special_tokens=False).ids


_loaded: dict = {}


def encoder(path: str) -> Encoder:
    if path not in _loaded:
        _loaded[path] = Encoder(path)
    return _loaded[path]


def token_pieces(docs: DataFrame, path: str | None = None, context: int = CONTEXT) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every row of docs; a null text is empty and still ends with id 0.

    A document longer than ``context`` is cut from its end, so only its first piece may be shorter.
    """
    path = path or tokenizer_path()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in pieces(batches, most=1 << 20):
            doc, piece, start, length, crc = [], [], [], [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = enc.ids(text)
                cuts = [0, *range(len(ids) % context or context, len(ids) + 1, context)]
                for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
                    doc.append(doc_id), piece.append(k), start.append(a), length.append(b - a), crc.append(zlib.crc32(ids[a:b].tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def nnls(a: np.ndarray, b: np.ndarray, rounds: int = 400) -> np.ndarray:
    """Non-negative least squares by an active set: minimises |a x - b| with x >= 0."""
    n = a.shape[1]
    x, free = np.zeros(n), np.zeros(n, bool)
    for _ in range(rounds):
        slope = a.T @ (b - a @ x)
        slope[free] = -np.inf
        k = int(np.argmax(slope))
        if slope[k] <= 1e-9 * max(1.0, float(np.abs(b).max(initial=0))):
            break
        free[k] = True
        while True:
            z = np.zeros(n)
            z[free] = np.linalg.lstsq(a[:, free], b, rcond=None)[0]
            if z[free].min(initial=0) >= -1e-12:
                x = np.maximum(z, 0)
                break
            down = free & (z < 0)
            step = np.min(x[down] / np.maximum(x[down] - z[down], 1e-300))
            x = x + step * (z - x)
            free &= x > 1e-12
            x[~free] = 0
    return x


def plan(histogram: dict[int, int], context: int = CONTEXT, grid: int = GRID) -> list[tuple[tuple[int, ...], int]]:
    """[(lengths of one sequence, number of such sequences)], using every length as often as the histogram says."""
    left = Counter({k: n for k, n in histogram.items() if n})
    out: list[tuple[tuple[int, ...], int]] = []
    if left.get(context):
        out.append(((context,), left.pop(context)))
    step = max(1, context // grid)
    top = context // step
    bin_of = lambda k: -(-k // step)
    coarse = np.zeros(top + 1)
    for k, n in left.items():
        coarse[bin_of(k)] += n
    here = [k for k in range(1, top + 1) if coarse[k]]
    patterns = [(i, top - i) for i in here if i <= top - i and coarse[top - i]]
    patterns += [(i, j, top - i - j) for i in here for j in here if i <= j <= top - i - j and coarse[top - i - j]]
    uses: list[tuple[tuple[int, ...], int]] = []
    if patterns:
        a = np.zeros((top + 1, len(patterns)))
        for c, p in enumerate(patterns):
            for k in p:
                a[k, c] += 1
        weight = np.sqrt(np.arange(top + 1))[:, None]  # a long document left over costs more than a short one
        uses = [(p, int(n)) for p, n in zip(patterns, np.floor(nnls(a * weight, coarse * weight[:, 0]) + 1e-9)) if n >= 1]
    by_bin: dict[int, list[int]] = defaultdict(list)
    for k in sorted(left):
        by_bin[bin_of(k)].append(k)
    groups: list[tuple[tuple[int, ...], int]] = []
    for p, n in sorted(uses, reverse=True):
        # exact lengths of the pattern's bins that fill a sequence to the last token, as often as the fit says
        for lead in product(*(by_bin[b] for b in p[1:])):
            need = context - sum(lead)
            took = (*lead, need)
            if need <= 0 or abs(bin_of(need) - p[0]) > 1 or any(left[k] < took.count(k) for k in took):
                continue
            m = min([n, *(left[k] // took.count(k) for k in set(took))])
            for k in took:
                left[k] -= m
            groups.append((took, m))
            n -= m
            if not n:
                break
    # best fit, longest first, into what space the patterns leave, then into sequences of their own
    room: dict[int, list[tuple[tuple[int, ...], int]]] = defaultdict(list)
    spaces: list[int] = []

    def put(lengths: tuple[int, ...], n: int) -> None:
        space = context - sum(lengths)
        if not space:
            out.append((lengths, n))
            return
        if not room[space]:
            bisect.insort(spaces, space)
        room[space].append((lengths, n))

    for lengths, n in groups:
        put(lengths, n)
    for k in sorted((k for k in left if left[k]), reverse=True):
        n = left[k]
        while n:
            at = bisect.bisect_left(spaces, k)
            if at < len(spaces):
                space = spaces[at]
                lengths, m = room[space].pop()
                if not room[space]:
                    spaces.pop(at)
                use = min(n, m)
                if m > use:
                    put(lengths, m - use)
                put((*lengths, k), use)
                n -= use
            else:
                each = context // k  # new sequences, filled with this length alone and open for shorter ones
                full, rest = divmod(n, each)
                if full:
                    put((k,) * each, full)
                if rest:
                    put((k,) * rest, 1)
                n = 0
    for space in spaces:
        out.extend(room[space])
    return out


def slots(groups: list[tuple[tuple[int, ...], int]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """By length: the first rank of each slot, the sequence number that rank 0 of the slot would have, and its offset."""
    out: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
    used: Counter = Counter()
    base = 0
    for lengths, n in groups:
        offset = 0
        for k in lengths:
            out[k].append((used[k], base - used[k], offset))
            used[k] += n
            offset += k
        base += n
    return {k: tuple(np.array(x, np.int64) for x in zip(*v)) for k, v in out.items()}


def pack(docs: DataFrame, path: str | None = None, context: int = CONTEXT) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset), one row for each piece of each row of docs.

    Repeated documents are packed like others; an empty table gives no rows. Ties (pieces of equal length) may be given to
    sequences in any order.
    """
    spark = docs.sparkSession
    n = max(1, width(spark))
    got = settle(token_pieces(docs, path, context).withColumn("chunk", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(4 * n)).cast("int")))
    counts = got.groupBy("length", "chunk").agg(F.count(F.lit(1)).alias("n"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most ``context`` rows
    table = spark.sparkContext.broadcast(slots(plan(histogram, context)))
    ahead = Window.partitionBy("length").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("length", "chunk", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("before"))
    inside = Window.partitionBy("length", "chunk").orderBy("doc_id", "piece", "ids_crc32")
    ranked = got.withColumn("nth", F.row_number().over(inside) - 1).join(before, ["length", "chunk"]).withColumn("rank", F.col("before") + F.col("nth"))

    def place(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(k).to_numpy(zero_copy_only=False) for k in (3, 5))
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            order = np.argsort(length, kind="stable")
            cut = np.flatnonzero(np.diff(length[order])) + 1
            for rows in np.split(order, cut) if len(order) else ():
                first, base, place_ = table.value[int(length[rows[0]])]
                at = np.searchsorted(first, rank[rows], "right") - 1
                sequence[rows], offset[rows] = base[at] + rank[rows], place_[at]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)], [*batch.schema.names[:5], "sequence_id", "offset"])

    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
