"""Substring dedup: removes every word covered by a window of words that also starts somewhere else.

Method: super-k-mers. Each window has a minimiser, the least hash among its runs of three words; consecutive windows with the
same minimiser are one packed string and travel together to the bucket of that minimiser, so equal windows always
meet, at about three words sent for each word of text. In its bucket the packed strings of each minimiser are compared
word by word: windows are counted by their bytes, not by a hash.

Skew: equal packed strings of one batch are merged before the shuffle. If there are two or more, all their windows are
repeated and their places are settled on the spot; only the string and "more than one" travel. A passage that a third of all
documents share thus sends one string a batch, whatever the number of documents.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provenix.llm.common import pieces, width
from provenix.llm.words import Words, runs, window_hashes

WINDOW = 35
SEED = 3  # words in a minimiser
LONGEST = 256  # windows in one packed string
PART = 24 << 20  # bytes of text whose packed strings are merged and sent together
RANGES = "doc_id long, mark long, first int, last int"


def minima(h: np.ndarray, size: int) -> np.ndarray:
    """Least value of each run of ``size`` values."""
    out, have = h, 1
    while have < size:
        step = min(have, size - have)
        out = np.minimum(out[: len(out) - step], out[step:])
        have += step
    return out


def twice(seeds: np.ndarray, at: np.ndarray, end: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Whether the seed ``value`` occurs more than once in seeds[at:end]; only then can a window repeat inside its string."""
    names, rank = np.unique(value, return_inverse=True)
    place = np.searchsorted(names, seeds)
    place[place == len(names)] = 0
    spot = np.flatnonzero(names[place] == seeds)
    n = np.int64(len(seeds) + 1)
    keys = np.sort(place[spot] * n + spot)
    low = np.searchsorted(keys, rank * n + at)
    return np.searchsorted(keys, rank * n + end) - low > 1


def packed(words: Words, window: int, seed: int) -> tuple[np.ndarray, ...]:
    """Of each super-k-mer: its text's number, first window (word number in the whole column), windows, minimiser,
    whether the minimiser occurs in it again."""
    n = np.diff(words.first)
    codes = words.hashes()
    seeds = window_hashes(codes, seed)
    least = minima(seeds, window - seed + 1) if len(codes) >= window else np.zeros(0, np.uint64)
    has = np.flatnonzero(n >= window)
    at = runs(words.first[:-1][has], n[has] - window + 1)  # every window's first word
    if not len(at):
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64), np.zeros(0, bool))
    text = np.repeat(has, n[has] - window + 1)
    value = least[at]
    new = np.ones(len(at), bool)
    new[1:] = (value[1:] != value[:-1]) | (text[1:] != text[:-1])
    lead = np.flatnonzero(new)
    length = np.diff(np.append(lead, len(at)))
    parts = -(-length // LONGEST)
    if (parts > 1).any():  # repetitive texts: cut long runs
        nth = runs(np.zeros(len(parts), np.int64), parts)
        lead = np.repeat(lead, parts) + nth * LONGEST
        length = np.diff(np.append(lead, len(at)))
    return text[lead], at[lead], length, value[lead], twice(seeds, at[lead], at[lead] + length + window - seed, value[lead])


def _pack(rows: list[tuple[int, bytes, int, int, int, int]]) -> bytes:
    """rows: minimiser, words joined by a space, 1 or (if more than one) 2 and 2 more if it may repeat a window, doc_id, mark, first window. Compressed, columns apart."""
    body = b"\n".join(r[1] for r in rows)
    numbers = np.array([(r[0], r[2], r[3], r[4], r[5]) for r in rows], np.int64).T
    return zstandard.compress(np.int64(len(rows)).tobytes() + np.ascontiguousarray(numbers).tobytes() + body, 3)


def _unpack(blob: bytes) -> tuple[np.ndarray, list[bytes]]:
    raw = zstandard.decompress(blob)
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    return np.frombuffer(raw, np.int64, 5 * n, 8).reshape(5, n), raw[8 + 40 * n :].split(b"\n")


def _send(docs: DataFrame, buckets: int, window: int, seed: int) -> DataFrame:
    """(bucket, kind, blob): kind 0 are packed strings for a bucket, kind 1 are ranges that are settled already."""

    def flush(found: dict[bytes, list]) -> Iterator[pa.RecordBatch]:
        out: dict[int, list] = {}
        done = []
        for text, (value, places, count, again) in found.items():
            many = len(places) > 1
            if many:
                done += [(d, m, f, f + count - 1) for d, m, f in places]
            d, m, f = places[0]
            out.setdefault(int(value % buckets), []).append((value - (value >> 63 << 64), text, 1 + many + 2 * again, d, m, f))
        rows = [(b, 0, _pack(sorted(r))) for b, r in out.items()]
        step = 1 << 16
        for i in range(0, len(done), step):
            part = np.array(done[i : i + step], np.int64)
            rows.append((int(part[0, 1] % buckets), 1, zstandard.compress(part.tobytes(), 3)))
        for i in range(0, len(rows), 64):
            some = rows[i : i + 64]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in some], t) for k, t in enumerate((pa.int32(), pa.int32(), pa.binary()))], ["bucket", "kind", "blob"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[bytes, list] = {}
        held = 0
        for batch in pieces(batches, most=2 << 20):
            words = Words(batch.column(1))
            text, at, count, value, again = packed(words, window, seed)
            data, starts, ends = words.joined()
            raw = data.tobytes()
            ids, marks = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            first = (at - words.first[text]).tolist()
            last = ends[at + count + window - 2].tolist() if len(at) else []
            for t, a, b, c, v, f, g in zip(text.tolist(), starts[at].tolist(), last, count.tolist(), value.tolist(), first, again.tolist()):
                got = found.get(key := raw[a:b])
                if got is None:
                    found[key] = [v, [(ids[t], marks[t], f)], c, g]
                else:
                    got[1].append((ids[t], marks[t], f))
            held += len(raw)
            if held >= PART:
                yield from flush(found)
                found, held = {}, 0
        yield from flush(found)

    return docs.select("doc_id", "text", "mark").mapInArrow(run, "bucket int, kind int, blob binary")


def _ranges(d: list, m: list, a: list, b: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(d, pa.int64()), pa.array(m, pa.int64()), pa.array(a, pa.int32()), pa.array(b, pa.int32())], ["doc_id", "mark", "first", "last"])


def _count(window: int):
    """One bucket: the windows that occur twice or more, as ranges of first words."""

    def repeats(rows: list[tuple[bytes, int, int, int, int]]) -> Iterator[tuple[int, int, int, int]]:
        # rows of one minimiser: words, 1 or 2, doc_id, mark, first window
        seen: dict[bytes, list] = {}
        for text, many, d, m, f in rows:
            many = 2 - many % 2
            if (got := seen.get(text)) is None:
                seen[text] = [many, [(d, m, f)]]
            else:
                got[0] = 2
                got[1].append((d, m, f))
        times: dict[bytes, int] = {}
        cut = {}
        for text, (many, _) in seen.items():
            ends = np.flatnonzero(np.frombuffer(text, np.uint8) == 32).tolist()
            ends.append(len(text))
            begin = [0, *(e + 1 for e in ends)]
            cut[text] = windows = [text[begin[i] : ends[i + window - 1]] for i in range(len(ends) - window + 1)]
            for w in windows:
                times[w] = times.get(w, 0) + many
        for text, (_, places) in seen.items():
            hit = [i for i, w in enumerate(cut[text]) if times[w] > 1]
            if hit:
                edge = [0, *(k for k in range(1, len(hit)) if hit[k] != hit[k - 1] + 1), len(hit)]
                for a, b in zip(edge, edge[1:]):
                    for d, m, f in places:
                        yield d, m, f + hit[a], f + hit[b - 1]

    def run(group: pa.Table) -> pa.Table:
        out: list[pa.RecordBatch] = [_ranges([], [], [], [])]
        kinds, blobs = group.column("kind").to_pylist(), group.column("blob")
        numbers, texts = [], []
        for kind, blob in zip(kinds, blobs):
            if kind == 1:
                part = np.frombuffer(zstandard.decompress(blob.as_py()), np.int64).reshape(-1, 4).T
                out.append(_ranges(*part))
            else:
                a, b = _unpack(blob.as_py())
                numbers.append(a)
                texts += b
        if numbers:
            n = np.concatenate(numbers, axis=1)
            order = np.argsort(n[0], kind="stable")
            value = n[0][order]
            edge = np.flatnonzero(np.concatenate(([True], value[1:] != value[:-1], [True])))
            rows = list(zip(*n[1:].tolist()))
            got: list[tuple[int, int, int, int]] = []
            for a, b in zip(edge.tolist(), edge[1:].tolist()):
                mine = order[a:b].tolist()
                if len(mine) == 1 and rows[mine[0]][0] <= 2:
                    continue  # alone, and its minimiser is in it once
                got += repeats([(texts[i], *rows[i]) for i in mine])
            # places whose string came more than once in a batch were settled there
            if got:
                out.append(_ranges(*zip(*got)))
        return pa.Table.from_batches(out)

    return run


def mark() -> F.Column:
    """Tells rows of the same doc_id but different text apart."""
    return F.xxhash64("text")


def repeated_ranges(docs: DataFrame, window: int = WINDOW, seed: int = SEED, buckets: int | None = None) -> DataFrame:
    """(doc_id, mark, first, last): the windows first..last (numbers of their first words) that start anywhere else too."""
    n = buckets or 8 * width(docs.sparkSession)
    read = docs.select("doc_id", "text", mark().alias("mark"))
    keyed = _send(read.withColumn("doc_id", F.coalesce("doc_id", F.lit(NO_ID))), n, window, seed)
    return keyed.groupBy("bucket").applyInArrow(_count(window), RANGES)


NO_ID = -(1 << 63)


def dedup(docs: DataFrame, window: int = WINDOW, seed: int = SEED, buckets: int | None = None) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_text) of every row of docs(doc_id, text).

    Words are removed that a window covers whose words also start at another place, in the same text or any other; windows
    are judged on the input. What is kept is joined by one space. A null text has no words. A repeated row repeats
    all its windows. A row with a null id is judged like any other.
    """
    spark = docs.sparkSession
    spots = repeated_ranges(docs, window, seed, buckets).groupBy("doc_id", "mark").agg(F.collect_list(F.struct("first", "last")).alias("ranges"))  # as many as a text has words at most
    read = docs.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("doc_id"), F.coalesce(mark(), F.lit(0)).alias("mark"), "text")
    joined = read.join(spots, ["doc_id", "mark"], "left").select("doc_id", "text", F.col("ranges.first").alias("firsts"), F.col("ranges.last").alias("lasts"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            words = Words(batch.column(1))
            data, starts, ends = words.joined()
            raw = data.tobytes()
            n = np.diff(words.first)
            removed, texts = [], []
            for i, (first, last) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())):
                a, b = int(words.first[i]), int(words.first[i + 1])
                gone = np.zeros(b - a + 1, np.int64)
                if first:
                    np.add.at(gone, np.array(first), 1)
                    np.add.at(gone, np.array(last) + window, -1)
                keep = np.cumsum(gone)[:-1] == 0
                removed.append(int(len(keep) - keep.sum()))
                if removed[-1] == 0:
                    texts.append(raw[starts[a] : ends[b - 1]] if b > a else b"")
                else:
                    texts.append(b" ".join(raw[s:e] for s, e in zip(starts[a:b][keep].tolist(), ends[a:b][keep].tolist())))
            ids = batch.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays(
                [pa.array([None if x == NO_ID else x for x in ids], pa.int64()), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array([t.decode() for t in texts], pa.string())], ["doc_id", "n_words", "n_removed", "kept_text"]
            )

    return joined.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_text string")


def kept_sha256(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


ORACLE = r"""
with w as (select doc_id, [x for x in regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+') if x <> ''] w from documents),
k as (select doc_id, i, array_to_string(w[i:i + 34], ' ') s from w, unnest(range(1, len(w) - 33)) r(i) where len(w) >= 35),
r as (select s from k group by s having count(*) > 1),
g as (select distinct doc_id, i + j p from k join r using (s), unnest(range(35)) u(j)),
n as (select doc_id, list(p) g from g group by doc_id)
select doc_id, cast(len(w) as bigint) n_words, cast(len(coalesce(g, [])) as bigint) n_removed,
  sha256(coalesce(array_to_string([w[i] for i in range(1, len(w) + 1) if not list_contains(coalesce(g, []), i)], ' '), '')) kept_sha256
from w left join n using (doc_id)
"""
