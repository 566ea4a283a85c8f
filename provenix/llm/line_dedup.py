"""Line deduplication by an exact set-similarity join.

A line is its set of words. Words are ordered from rare to common, and lines that reach the Jaccard threshold must share a word
among their first few (prefix filter); the rest of both lines must be long enough from there (positional filter), the
lines about equally long (length filter), and their parity bitmaps close (bitmap filter). What passes is verified on the
full word sets. Of two matching lines the later one goes, by (doc_id, line number).

The order need not be exact to be right, only the same everywhere: word counts are kept in a table of fixed size, filled from
the whole corpus by a distributed sum. Equal word sets are one entry of the join, so a line that a third of all documents
share is one row there.

A line goes as soon as one earlier match is known, so not all matching pairs are formed. In the group of a word, rows stand by size and each meets
the REACH after it; of those that pass, the BEST nearest by bitmap are candidates. Most groups are smaller than that and thereby done. Lines of larger groups
that have no earlier match yet are *open*: their groups are cut into blocks, and the open lines meet the earlier rows of more blocks and more candidates each
round, until they have a match or have met all. So a large group of near copies costs rows in proportion, and nothing is left out.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provenix.llm.common import Store, pieces, width
from provenix.llm.words import U, Words, mix, runs

LEAST = 1  # different words a line must have to be judged, if the caller names no other number
NUM, DEN = 4, 5  # Jaccard of 0.8
ALONE = 4  # sets of fewer words match equal sets only: 3 of 4 is under 0.8, but 4 of 5 is not
TABLE = 1 << 18  # entries of the count table
SLICES = 64
TOP = (1 << 15) - 1  # sizes and positions from here on are not told apart
SENT = 1 << 20  # word sets a task remembers, to send each once
NO_ID = -(1 << 63)
REACH = 512  # rows of a word's group that a row meets at once
BEST = 24  # candidates of a row in one group at once
LOOK = 4  # candidates of an open row in the one group that it looks into first
BLOCK = 4096  # rows in a block of a larger group
HELD = 1 << 19  # rows that a task joins at a time
PARTS = 2  # parts of the words that are dealt one after the other, so that the disk holds the prefix rows of one
BLOOM_BITS = 1 << 27  # largest Bloom filter that is broadcast: 16 MB; beyond, it passes more rows than need be, and loses none
WIDE = 144  # words from which a set has 256 more bits of bitmap; 96 say nothing of a long one
CANDIDATE = "a long, b long, far int, tok long, info long, bits long, wide binary"  # b is null: a is a row in a group of tok that is not done, far tells whether it is open


def _counts(docs: DataFrame) -> np.ndarray:
    """Word counts of the whole corpus by hash, as an 8-bit logarithmic rank."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(TABLE, np.int64)
        for batch in pieces(batches, most=2 << 20):
            h = Words(batch.column(0)).hashes()
            total += np.bincount((h >> U(40)).astype(np.int64) & (TABLE - 1), minlength=TABLE)
        if total.any():
            parts = total.reshape(SLICES, -1)
            yield pa.RecordBatch.from_arrays([pa.array(range(SLICES), pa.int32()), pa.array([p.tobytes() for p in parts], pa.binary())], ["slice", "counts"])

    def add(rows: pd.DataFrame) -> pd.DataFrame:
        total = np.sum([np.frombuffer(c, np.int64) for c in rows["counts"]], axis=0)
        return pd.DataFrame({"slice": rows["slice"].iloc[:1], "counts": [total.tobytes()]})

    # one row a task and slice; summed in two steps so that no task holds more than a few hundred
    rows = docs.select("text").mapInArrow(run, "slice int, counts binary").withColumn("part", F.spark_partition_id() % 16)
    some = rows.groupBy("slice", "part").applyInPandas(lambda g: add(g), "slice int, counts binary")
    got = some.groupBy("slice").applyInPandas(add, "slice int, counts binary").collect()  # 2 MB
    total = np.zeros((SLICES, TABLE // SLICES), np.int64)
    for r in got:
        total[r["slice"]] = np.frombuffer(r["counts"], np.int64)
    return np.minimum(255, np.log2(total.ravel() + 1) * 6).astype(np.uint8)


class LineSets:
    """Lines of a text column as word sets in rare-first order: row, line, n by line; tokens flat, at[line]..at[line + 1]."""

    def __init__(self, column: pa.Array, rank: np.ndarray | None, least: int = LEAST):
        w = Words(column)
        breaks = np.sort(np.concatenate([np.flatnonzero(w.data == 10) + 1, w.offsets[:-1]]))
        line = np.searchsorted(breaks, w.starts, "right")  # counts doc starts and line ends, over the whole column
        h = w.hashes()
        key = h & U(0xFFFFFFFF) if rank is None else (rank[(h >> U(40)).astype(np.int64) & (TABLE - 1)].astype(U) << U(32)) | (h & U(0xFFFFFFFF))
        if len(breaks) < 1 << 24:
            order = np.argsort((line.astype(U) << U(40)) | key)
        else:  # a text of very many lines: two sorts keep the line number whole
            order = np.argsort(key)
            order = order[np.argsort(line[order], kind="stable")]
        line, h = line[order], h[order]
        new = np.ones(len(h), bool)
        new[1:] = (line[1:] != line[:-1]) | (h[1:] != h[:-1])
        line, h = line[new], h[new]
        lead = np.flatnonzero(np.concatenate(([True], line[1:] != line[:-1]))) if len(line) else np.zeros(0, np.int64)
        n = np.diff(np.append(lead, len(line)))
        keep = n >= least
        self.tokens = h[np.repeat(keep, n)] if len(n) else h
        self.n = n[keep]
        at_line = line[lead][keep]
        self.row = np.searchsorted(w.offsets, breaks[at_line - 1], "right") - 1 if len(at_line) else np.zeros(0, np.int64)
        # empty rows share an offset with the next one; the row that owns the words is the last with that offset
        first = np.searchsorted(breaks, w.offsets[:-1], "right")
        self.line = at_line - first[self.row] if len(at_line) else np.zeros(0, np.int64)
        self.at = np.concatenate(([0], np.cumsum(self.n)))[:-1] if len(self.n) else np.zeros(0, np.int64)
        if len(self.n):
            self.sig = mix(np.add.reduceat(mix(self.tokens ^ U(0x5851F42D4C957F2D)), self.at) + self.n.astype(U))
        else:
            self.sig = np.zeros(0, U)

    def bitmaps(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Parity bitmaps of 32, of 64 and of 256 bits (four columns): every word flips one of the first 96 bits and one of the 256."""
        if not len(self.n):
            return np.zeros(0, U), np.zeros(0, U), np.zeros((0, 4), U)
        bit = ((self.tokens >> U(7)) & U(0xFFFFFFFF)) * U(96) >> U(32)
        low = np.where(bit < U(32), U(1) << bit, U(0))
        high = np.where(bit < U(32), U(0), U(1) << (bit - U(32)))
        wide = np.zeros((len(self.n), 4), U)
        long = np.flatnonzero(self.n >= WIDE)
        at = runs(self.at[long], self.n[long])
        if len(at):
            lead = np.cumsum(self.n[long]) - self.n[long]
            spot = (self.tokens[at] >> U(39)) & U(255)
            flip = U(1) << (spot & U(63))
            for k in range(4):
                wide[long, k] = np.bitwise_xor.reduceat(np.where(spot >> U(6) == U(k), flip, U(0)), lead)
        return np.bitwise_xor.reduceat(low, self.at), np.bitwise_xor.reduceat(high, self.at), wide


class Bloom:
    """Which hashes may be among those it was filled with: two bits each, by their highest and their lowest bits."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits

    @staticmethod
    def of(longs: DataFrame, column: str) -> Bloom:
        """Filled by Spark; at most BLOOM_BITS / 64 numbers come to the driver."""
        n = longs.count()
        size = 1 << max(12, min(BLOOM_BITS.bit_length() - 1, (16 * n).bit_length()))
        slot = longs.select(F.explode(F.expr(f"array(shiftrightunsigned({column}, {65 - size.bit_length()}), {column} & {size - 1}L)")).alias("s"))
        words = slot.groupBy(F.expr("s div 64").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(s % 64 as int))")).alias("bits")).toPandas()
        out = np.zeros(size // 64, np.int64)
        out[words["w"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int64)
        return Bloom(out.view(U))

    def has(self, x: np.ndarray) -> np.ndarray:
        x, size = x.view(U), 64 * len(self.bits)
        found = np.ones(len(x), bool)
        for s in (x >> U(65 - size.bit_length()), x & U(size - 1)):
            found &= (self.bits[(s >> U(6)).astype(np.int64)] >> (s & U(63))) & U(1) == U(1)
        return found


def _prefixes(docs: DataFrame, table, least: int, part: int = 0, parts: int = 1) -> DataFrame:
    """(tok, sig, info, bits, wide): the prefix words of every distinct word set that can match another; info packs size, position and 32 bits of the bitmap.

    A set that several tasks hold comes from each of them. Of ``parts`` parts of all words, these are the rows of one.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent = np.zeros(0, U)
        for batch in pieces(batches, most=2 << 20):
            s = LineSets(batch.column(0), table.value, max(least, ALONE))
            _, one = np.unique(s.sig, return_index=True)
            one = one[~np.isin(s.sig[one], sent)]
            sent = np.concatenate([sent, s.sig[one]]) if len(sent) < SENT else s.sig[one]
            n = s.n[one]
            size = n - -(-NUM * n // DEN) + 1
            at = runs(s.at[one], size)
            pos = at - np.repeat(s.at[one], size)
            own = np.flatnonzero(s.tokens[at] % U(parts) == U(part))
            of = np.repeat(np.arange(len(one)), size)[own]
            at, pos = at[own], pos[own]
            low, high, wide = (x[one] for x in s.bitmaps())
            info = (np.minimum(n, TOP)[of].astype(U) << U(48)) | (np.minimum(pos, TOP).astype(U) << U(32)) | low[of]
            cols = [pa.array(x.view(np.int64)) for x in (s.tokens[at], s.sig[one][of], info, high[of])]
            yield pa.RecordBatch.from_arrays([*cols, _packed(wide[of], n[of] >= WIDE)], ["tok", "sig", "info", "bits", "wide"])

    return docs.select("text").mapInArrow(run, "tok long, sig long, info long, bits long, wide binary")


def _packed(wide: np.ndarray, has: np.ndarray) -> pa.Array:
    """Binary values of 32 bytes where there are any, else null."""
    ends = np.concatenate(([0], np.cumsum(has * 32))).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(has), [pa.array(has).buffers()[1], pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(wide[has]))])


def _unpacked(column: pa.Array) -> np.ndarray:
    """The 256 bits as four columns; zeros where there are none."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    out = np.zeros((len(column), 4), U)
    has = column.is_valid().to_numpy(zero_copy_only=False)
    if has.any():
        ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
        out[has] = np.frombuffer(column.buffers()[2], np.uint8)[ends[0] : ends[-1]].view(U).reshape(-1, 4)
    return out


class Rows:
    """Prefix rows as arrays."""

    def __init__(self, tok: np.ndarray, sig: np.ndarray, info: np.ndarray, bits: np.ndarray, wide: np.ndarray):
        self.all = (tok, sig, info, bits, wide)
        self.tok, self.sig, self.info, self.bits, self.wide = self.all
        self.n = info >> 48
        self.pos = (info >> 32) & TOP
        self.low = (info & 0xFFFFFFFF).astype(np.uint32)

    def cut(self, k: slice | np.ndarray) -> Rows:
        return Rows(*(c[k] for c in self.all))

    def far(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Differing bits, of which a pair has at most as many as words that only one of its sets has: the larger count of the two bitmaps."""
        out = np.bitwise_count(self.low[i] ^ self.low[j]).astype(np.int32) + np.bitwise_count((self.bits[i] ^ self.bits[j]).view(U))
        both = np.flatnonzero((self.n[i] >= WIDE) & (self.n[j] >= WIDE))
        if len(both):
            out[both] = np.maximum(out[both], np.bitwise_count(self.wide[i[both]] ^ self.wide[j[both]]).sum(1, dtype=np.int32))
        return out

    def may_match(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Length, positional and bitmap filter for rows of one word."""
        n, m = self.n[i], self.n[j]
        need = -(-NUM * (n + m) // (NUM + DEN))  # least common words
        open_end = (n >= TOP) | (m >= TOP)
        placed = np.minimum(self.pos[i], self.pos[j]) + np.minimum(n - self.pos[i], m - self.pos[j]) >= need
        ok = (DEN * np.minimum(n, m) >= NUM * np.maximum(n, m)) & (placed | open_end) & (self.sig[i] != self.sig[j])
        near = np.flatnonzero(ok)
        ok[near] = open_end[near] | (self.far(i[near], j[near]) <= n[near] + m[near] - 2 * need[near])
        return ok


def _chosen(rows: Rows, i: np.ndarray, j: np.ndarray, best: int, first_only: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of pairs that may match: those that are among the ``best`` nearest of either end (or of the first), with their distance, and the ends that had more."""
    far = rows.far(i, j)
    own, other = (i, j) if first_only else (np.concatenate([i, j]), np.concatenate([j, i]))
    pair = np.concatenate([np.arange(len(i))] * (1 if first_only else 2))
    order = np.lexsort((other, far[pair], own))
    own, pair = own[order], pair[order]
    lead = np.flatnonzero(np.append(True, own[1:] != own[:-1])) if len(own) else np.zeros(0, np.int64)
    n = np.diff(np.append(lead, len(own)))
    rank = np.arange(len(own)) - np.repeat(lead, n)
    kept = np.unique(pair[rank < best])
    return i[kept], j[kept], far[kept], own[lead][n > best]


def _told(rows: Rows, i: np.ndarray, j: np.ndarray, far: np.ndarray, listed: np.ndarray, opened: np.ndarray) -> pa.RecordBatch:
    """Candidates, each once, and the listed rows."""
    a, b = np.minimum(rows.sig[i], rows.sig[j]), np.maximum(rows.sig[i], rows.sig[j])
    _, one = np.unique(np.stack([a, b], 1), axis=0, return_index=True) if len(a) else (None, np.zeros(0, np.int64))
    k, z = len(one), len(listed)
    pad = np.zeros(k, np.int64)
    cols = [
        pa.array(np.concatenate([a[one], rows.sig[listed]])), pa.array(np.concatenate([b[one], np.zeros(z, np.int64)]), mask=np.arange(k + z) >= k),
        pa.array(np.concatenate([far[one], opened[listed]]).astype(np.int32)), *(pa.array(np.concatenate([pad, x[listed]])) for x in (rows.tok, rows.info, rows.bits)),
        _packed(np.concatenate([np.zeros((k, 4), U), rows.wide[listed]]), np.concatenate([pad > 0, rows.n[listed] >= WIDE])),
    ]
    return pa.RecordBatch.from_arrays(cols, ["a", "b", "far", "tok", "info", "bits", "wide"])


def _met(rows: Rows, going: bool, cut: bool, reach: int, best: int) -> pa.RecordBatch:
    """Each row and up to ``reach`` after it in its group. going: the first group has begun before, cut: the last one goes on; all rows of such a group are open."""
    lead = np.flatnonzero(np.append(True, rows.tok[1:] != rows.tok[:-1]))
    size = np.diff(np.append(lead, len(rows.tok)))
    end_of = np.repeat(lead + size, size)
    opened = np.zeros(len(rows.tok), bool)
    if cut:
        opened[lead[-1] :] = True
    if going:
        opened[: size[0]] = True
    i = np.arange(len(rows.tok))
    left, right = [], []
    for k in range(1, reach + 2):
        i = i[i + k < end_of[i]]
        i = i[DEN * rows.n[i] >= NUM * rows.n[i + k]]  # sizes rise, so what is too long stays too long
        if not len(i):
            break
        if k > reach:
            opened |= np.isin(rows.tok, rows.tok[i])
            break
        fresh = i[rows.may_match(i, i + k)]
        left.append(fresh), right.append(fresh + k)
    none = np.zeros(0, np.int64)
    a, b, far, crowded = _chosen(rows, np.concatenate([none, *left]), np.concatenate([none, *right]), best)
    opened[crowded] = True
    listed = np.flatnonzero(np.repeat(np.logical_or.reduceat(opened, lead), size))
    return _told(rows, a, b, far, listed, opened)


def _candidates(prefixes: DataFrame, reach: int = REACH, best: int = BEST, held: int = HELD) -> DataFrame:
    """prefixes -> CANDIDATE rows. A task holds ``held`` rows and the reach of one group, whatever the groups' sizes."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple[np.ndarray, ...]] = []
        size = 0
        going = False  # the first group here has begun in rows that are gone; all of it is open
        for batch in batches:
            parts.append((*(c.to_numpy() for c in batch.columns[:4]), _unpacked(batch.column(4))))
            size += batch.num_rows
            if size < held:
                continue
            rows = _sorted(parts)
            lead = int(np.searchsorted(rows.tok, rows.tok[-1]))  # the last group may go on
            if lead:
                yield _met(rows.cut(slice(0, lead)), going, False, reach, best)
                parts, going = [rows.cut(slice(lead, None)).all], False
            else:
                yield _met(rows, going, True, reach, best)
                parts, going = [rows.cut(slice(len(rows.tok) - 1, None)).all], True
            size = len(parts[0][0])
        if size:
            yield _met(_sorted(parts), going, False, reach, best)

    dealt = prefixes.repartition(width(prefixes.sparkSession), "tok").sortWithinPartitions("tok")
    return dealt.mapInArrow(run, CANDIDATE)


def _sorted(parts: list[tuple[np.ndarray, ...]]) -> Rows:
    """Rows by word, size and position, each set once."""
    cols = [np.concatenate(c) for c in zip(*parts)]
    order = np.lexsort((cols[1], cols[2], cols[0]))
    cols = [c[order] for c in cols]
    new = np.append(True, (cols[0][1:] != cols[0][:-1]) | (cols[1][1:] != cols[1][:-1])) if len(order) else np.zeros(0, bool)
    return Rows(*(c[new] for c in cols))


def _candidates_of_open(rows: DataFrame, opened: DataFrame, turn: int, block: int = BLOCK, best: int = BEST) -> DataFrame:
    """rows(tok, sig, info, bits, wide, place) of the groups that are not done, opened(tok, sig) without an earlier match -> CANDIDATE rows.

    A group is cut into blocks of about ``block`` rows by a hash; an open row meets the earlier rows up to 4 ** turn blocks away. Two blocks meet in a task of their own.
    """
    # of a group, only what stands before the last open row can be an earlier match
    last = opened.join(rows.select("tok", "sig", F.col("place").alias("own_place")), ["tok", "sig"]).groupBy("tok").agg(F.max("own_place").alias("last"))
    rows = rows.join(last, "tok").where("place <= last").drop("last").join(opened.withColumn("asked", F.lit(True)), ["tok", "sig"], "left")
    sizes = rows.groupBy("tok").agg(F.count(F.lit(1)).alias("size"))
    rows = rows.join(sizes, "tok").withColumn("blocks", F.expr(f"cast((size + {block - 1}) div {block} as int)")).withColumn("own", F.expr("cast(pmod(xxhash64(sig), blocks) as int)"))
    # a row goes to the pair of its block and the one that many after it, and to that of the one before it and its own
    there = F.expr(f"explode(flatten(transform(sequence(0, least(blocks div 2, {4**turn - 1})), d -> array_distinct(array(named_struct('at', own, 'away', d), named_struct('at', pmod(own - d, blocks), 'away', d))))))")
    sent = rows.withColumn("m", there).select(
        "tok", "m.at", "m.away", "sig", "info", "bits", "wide", F.col("place.doc_id").alias("doc_id"), F.col("place.mark").alias("mark"), F.col("place.line").alias("line"),
        F.coalesce("asked", F.lit(False)).alias("asked"), (F.col("own") == F.col("m.at")).alias("here"), F.expr(f"blocks div 2 >= {4**turn}").alias("on")
    )
    most = best * 4**turn

    def run(group: pa.Table) -> pa.Table:
        cols = {k: group.column(k).to_numpy() for k in ("tok", "sig", "info", "bits", "doc_id", "mark", "line", "asked", "here", "on")}
        order = np.lexsort((cols["sig"], cols["info"]))
        cols = {k: v[order] for k, v in cols.items()}
        rows = Rows(*(cols[k] for k in ("tok", "sig", "info", "bits")), _unpacked(group.column("wide"))[order])
        turn_of = np.empty(len(order), np.int64)
        turn_of[np.lexsort((cols["line"], cols["mark"], cols["doc_id"]))] = np.arange(len(order))
        asked, here = cols["asked"].astype(bool), cols["here"].astype(bool)
        inside = group.column("away")[0].as_py() == 0
        low, high = np.searchsorted(rows.n, -(-NUM * rows.n // DEN)), np.searchsorted(rows.n, rows.n * DEN // NUM, "right")
        low[rows.n >= TOP] = np.searchsorted(rows.n, NUM * TOP // DEN)
        ends: list[tuple[np.ndarray, np.ndarray]] = []
        for k in np.flatnonzero(asked).tolist():
            j = np.arange(low[k], high[k])
            j = j[(turn_of[j] < turn_of[k]) & (inside | (here[j] != here[k]))]
            i = np.full(len(j), k)
            ok = rows.may_match(i, j)
            ends.append((i[ok], j[ok]))
        none = np.zeros(0, np.int64)
        i, j = (np.concatenate([none, *(e[x] for e in ends)]) for x in (0, 1))
        a, b, far, crowded = _chosen(rows, i, j, most, first_only=True)
        opened = asked & bool(cols["on"][0])
        opened[crowded] = True
        return pa.Table.from_batches([_told(rows, a, b, far, np.flatnonzero(opened), opened)])

    return sent.groupBy("tok", "at", "away").applyInArrow(run, CANDIDATE)


def _lines(docs: DataFrame, least: int, wanted: Bloom) -> DataFrame:
    """(sig, doc_id, mark, line, words) of every line that is judged; words, once in a task, of the sets that may be compared."""
    bloom = docs.sparkSession.sparkContext.broadcast(wanted)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: set[int] = set()
        for batch in pieces(batches, most=2 << 20):
            s = LineSets(batch.column(1), None, least)
            rows, sig, tokens = pa.array(s.row), s.sig.view(np.int64), s.tokens.view(np.int64)
            words: list[np.ndarray | None] = [None] * len(sig)
            for k in np.flatnonzero(bloom.value.has(sig)).tolist():
                if int(sig[k]) not in sent:
                    words[k] = tokens[s.at[k] : s.at[k] + s.n[k]]
                    sent.add(int(sig[k]))
            if len(sent) > SENT:
                sent.clear()
            yield pa.RecordBatch.from_arrays([pa.array(sig), batch.column(0).take(rows), batch.column(2).take(rows), pa.array(s.line, pa.int32()), pa.array(words, pa.list_(pa.int64()))], ["sig", "doc_id", "mark", "line", "words"])

    return docs.select("doc_id", "text", "mark").mapInArrow(run, "sig long, doc_id long, mark long, line int, words array<long>")


def _touched(docs: DataFrame, keys: DataFrame) -> F.Column:
    """Whether a row of docs(doc_id, mark) may be among keys(doc_id, mark): all that are, and few others."""
    bloom = docs.sparkSession.sparkContext.broadcast(Bloom.of(keys.select(F.xxhash64("doc_id", "mark").alias("h")), "h"))

    @F.pandas_udf("boolean")
    def may_be(h: pd.Series) -> pd.Series:
        return pd.Series(bloom.value.has(h.to_numpy(np.int64)))

    return may_be(F.xxhash64("doc_id", "mark"))


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """pairs(sig, other) that reach the threshold on their whole sets."""
    both = pairs.join(sets, "sig").join(sets.select(F.col("sig").alias("other"), F.col("words").alias("theirs")), "other")
    common = F.size(F.array_intersect("words", "theirs"))
    return both.where(DEN * common >= NUM * (F.size("words") + F.size("theirs") - common)).select("sig", "other")


def removed_lines(keyed: DataFrame, store: Store, least: int = LEAST, reach: int = REACH, best: int = BEST, block: int = BLOCK) -> DataFrame:
    """keyed(doc_id, mark, text) -> (doc_id, mark, lines): the numbers of the lines that go, from 0. What it needs on the way stands in store."""
    read = keyed.select("doc_id", "mark", "text")
    table = keyed.sparkSession.sparkContext.broadcast(_counts(read))  # 256 KB whatever the corpus
    met = store.together(_candidates(_prefixes(read, table, least, k, PARTS), reach, best) for k in range(PARTS))
    # ends of pairs, and the rows that later rounds may pair
    ends = met.select("a").unionByName(met.where("b is not null").select(F.col("b").alias("a"))).distinct()
    lines = store.keep(_lines(read, least, Bloom.of(ends, "a")))
    place = F.struct("doc_id", "mark", "line")
    first = lines.groupBy("sig").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n"), F.first("words", ignorenulls=True).alias("words"))
    first = store.keep(first.where("n > 1 or words is not null"))  # other lines stay
    sets = first.where("words is not null")
    at = sets.select("sig", "first")
    found: list[DataFrame] = []  # sets with an earlier match
    rows = all_open = None
    turn = 0
    while True:
        pairs = met.where("b is not null").groupBy("a", "b").agg(F.min("far").alias("far"))
        placed = pairs.join(at.select(F.col("sig").alias("a"), F.col("first").alias("first_a")), "a").join(at.select(F.col("sig").alias("b"), F.col("first").alias("first_b")), "b")
        later = F.col("first_a") > F.col("first_b")
        aimed = placed.select(F.when(later, F.col("a")).otherwise(F.col("b")).alias("sig"), F.when(later, F.col("b")).otherwise(F.col("a")).alias("other"), "far")
        for x in found:
            aimed = aimed.join(x, "sig", "left_anti")
        aimed = store.keep(aimed)
        # the nearest first: most lines are settled by it, and their other pairs never move
        nearest = aimed.groupBy("sig").agg(F.min_by("other", F.struct("far", "other")).alias("other"))
        found.append(store.keep(_verified(nearest, sets).select("sig")))
        rest = aimed.join(nearest, ["sig", "other"], "left_anti").join(found[-1], "sig", "left_anti")
        found.append(store.keep(_verified(rest.select("sig", "other"), sets).select("sig").distinct()))
        opened = all_open if all_open is not None and not turn else met.where("b is null and far = 1").select(F.col("a").alias("sig"), "tok").distinct()
        for x in found:
            opened = opened.join(x, "sig", "left_anti")
        opened = store.keep(opened)
        if opened.isEmpty():
            break
        if rows is None:
            rows = met.where("b is null").groupBy("tok", F.col("a").alias("sig")).agg(F.first("info").alias("info"), F.first("bits").alias("bits"), F.first("wide").alias("wide"))
            rows = store.keep(rows.join(opened.select("tok").distinct(), "tok", "left_semi").join(at.withColumnRenamed("first", "place"), "sig"))
        if all_open is None:
            # near copies stand together in nearly all groups of their words: first each open set looks into one
            all_open = opened
            met = store.keep(_candidates_of_open(rows, opened.groupBy("sig").agg(F.min("tok").alias("tok")), 0, block, min(best, LOOK)).where("b is not null"))
        else:
            met = store.keep(_candidates_of_open(rows, opened, turn, block, best))
            turn += 1
    # the first line of a matched set goes, and every other line of any set
    matched = found[0]
    for x in found[1:]:
        matched = matched.unionByName(x)
    since = first.drop("words").join(matched.withColumn("also", F.lit(True)), "sig", "left").where("n > 1 or also").select("sig", "first", "also")
    gone = lines.drop("words").join(since, "sig").where(F.col("also") | (place > F.col("first"))).select("doc_id", "mark", "line")
    return gone.groupBy("doc_id", "mark").agg(F.collect_set("line").alias("lines"))  # lines of one document


def dedup(docs: DataFrame, least: int = LEAST, **limits: int) -> DataFrame:
    """All rows and columns of docs, ``text`` without the lines that go, and n_lines, n_removed (and n_chars, if docs has it) to match.

    Lines of under ``least`` different words are not judged and stay; with 1, every line that has a word is judged. Lines are cut at \\n; what is kept is joined by \\n. A null text stays
    null. Rows of the same doc_id and text are one place: neither goes for the other. A null doc_id comes before all others. Columns of docs
    that are named n_lines or n_removed are replaced by those of this operator.
    """
    own = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    rest = [c for c in own if c != "text"]
    keyed = docs.select(F.struct(*rest).alias("_row"), F.coalesce("doc_id", F.lit(NO_ID)).alias("doc_id"), F.xxhash64("text").alias("mark"), "text")
    spark = docs.sparkSession
    work = Store(spark, "lines")
    gone = Store(spark, "lines").keep(removed_lines(keyed, work, least, **limits))
    work.drop()
    touched = _touched(keyed, gone)
    # only documents that lose a line are moved
    moved = keyed.where(touched).join(gone, ["doc_id", "mark"], "left").withColumn("_cut", F.when(F.col("lines").isNotNull(), F.split("text", "\n")))
    kept = F.expr("array_join(transform(array_except(sequence(0, size(_cut) - 1), lines), i -> _cut[i]), '\n')")
    moved = moved.withColumn("_text", F.when(F.col("lines").isNull(), F.col("text")).otherwise(kept))
    breaks = F.coalesce(F.length("text") - F.length(F.translate("text", "\n", "")) + 1, F.lit(0)).cast("long").alias("n_lines")
    cut = [F.col("_text").alias(c) if c == "text" else F.when(F.col("lines").isNull(), F.col(f"_row.{c}")).otherwise(F.length("_text").cast("long")).alias(c) if c == "n_chars" else F.col(f"_row.{c}").alias(c) for c in own]
    out = moved.select(*cut, breaks, F.coalesce(F.when(F.col("lines").isNotNull(), F.size("lines")), F.lit(0)).cast("long").alias("n_removed"))
    whole = keyed.where(~touched).select(*(F.col("text") if c == "text" else F.col(f"_row.{c}").alias(c) for c in own), breaks, F.lit(0).cast("long").alias("n_removed"))
    return whole.unionByName(out)
