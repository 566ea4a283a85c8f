"""Benchmark decontamination by template canonicalisation.

Words of benchmark items and documents become template codes: a run of numbers, a run of names, or a unit of measure is a typed placeholder, every other
word is itself in lower case without punctuation at its edges. So "12" and "twenty five", "Bob" and "Mary Ann" are one placeholder each. A capital at the
beginning of a sentence may be a name or not: windows that hold one are taken both ways. Windows of five codes of the benchmark are a hash table that
each task probes with the windows of its documents; windows with fewer than three literal words, and items of three or four words, are
compared by their exact words instead. Hits of one item that stand at about the same distance are chained, so a word put in or left out does not part
them; then words are compared literally, and the slots must be consistent: one value of the item stands for one value of the document and
the other way round. A document is reported for an item when at least 0.8 of the item's words are covered, so a question asked again with other
numbers or names is found, and a text that shares a phrase only is not.
"""

from __future__ import annotations


import re
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provenix.llm.common import pieces
from provenix.llm.words import BYTE_CODES, LOWER, U, Words, mix, runs, span_hashes, window_hashes

WINDOW = 5
LITERAL = 3  # words of a window that must not be placeholders
COVER = 0.8
BLOCK = 50_000  # items whose windows are broadcast at once
NUMBER, UNIT, NAME = U(1), U(2), U(3)
UNITS = "mm cm m km in ft yd mi mg g kg t lb lbs oz ml cl l gal s sec min h hr hrs day days week weeks month months year years hour hours minute minutes second seconds meter meters metre metres kilometer kilometers kilometre kilometres mile miles gram grams kilogram kilograms pound pounds litre litres liter liters percent euro euros dollar dollars usd eur cent cents degrees".split()
# Number words of English, German, French and Spanish, without those that are articles too.
SPELLED = (
    "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion"
    " null eins zwei drei vier fünf sechs sieben acht neun zehn elf zwölf dreizehn vierzehn fünfzehn sechzehn siebzehn achtzehn neunzehn zwanzig dreißig vierzig fünfzig sechzig siebzig achtzig neunzig hundert tausend"
    " zéro deux trois quatre cinq sept huit neuf dix onze douze treize quatorze quinze seize vingt trente quarante cinquante soixante cent mille"
    " cero uno dos tres cuatro cinco seis siete ocho nueve diez once doce trece catorce quince dieciséis diecisiete dieciocho diecinueve veinte treinta cuarenta cincuenta sesenta setenta ochenta noventa cien ciento mil"
).split()
ALNUM = np.zeros(256, bool)
ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
DIGIT = np.zeros(256, bool)
DIGIT[48:58] = True
STOP = np.zeros(256, bool)
STOP[[ord(c) for c in ".!?:"]] = True
APART = np.zeros(256, bool)
APART[[ord(c) for c in ",;"]] = True
HYPHEN = re.compile(rb"[a-z\xc3\x80-\xbf]+(?:-[a-z\xc3\x80-\xbf]+)+")
MIXED = re.compile(rb"[0-9][0-9.,]*([a-z]{1,7})")
SHORT = 3  # words of the shortest item that is looked for
DRIFT = 4  # words by which neighbouring hits of one item may be shifted against each other


def _codes_of(words: Iterable[str]) -> np.ndarray:
    w = Words(pa.array([" ".join(words)]))
    return np.sort(w.hashes())


UNIT_CODES, SPELLED_CODES = _codes_of(UNITS), _codes_of(SPELLED)
UNIT_WORDS, SPELLED_WORDS = ({x.encode() for x in xs} for xs in (UNITS, SPELLED))


def _among(x: np.ndarray, known: np.ndarray) -> np.ndarray:
    at = np.searchsorted(known, x)
    at[at == len(known)] = 0
    return known[at] == x


class Template:
    """Template codes of a text column: code by word, and the span of each word without punctuation at its edges."""

    def __init__(self, column: pa.Array):
        w = self.words = Words(column)
        data = w.data
        low = LOWER[data]
        # capital letters of Latin-1: C3 80..9E except 97
        second = np.zeros(len(data), bool)
        if len(data) > 1:
            second[1:] = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
        low = np.where(second, low + np.uint8(0x20), low)
        solid = np.concatenate(([0], np.cumsum(ALNUM[data])))
        spots = np.flatnonzero(ALNUM[data])
        a, b = solid[w.starts], solid[w.ends]
        full = b > a  # words of punctuation only keep their span
        s, e = w.starts.copy(), w.ends.copy()
        s[full] = spots[a[full]]
        e[full] = spots[b[full] - 1] + 1
        self.low, self.starts, self.ends = low, s, e
        digits = np.concatenate(([0], np.cumsum(DIGIT[data])))
        nd = digits[e] - digits[s]
        code = span_hashes(BYTE_CODES[low], s, e) | U(4)  # placeholders are below 4
        plain = code
        number = (nd > 0) & (nd == solid[e] - solid[s]) | _among(plain, SPELLED_CODES | U(4))
        self.raw, self.source = low.tobytes(), data
        # "12kg", "twenty-five": few words, looked at one by one
        for i in np.flatnonzero((nd > 0) & ~number).tolist():
            m = MIXED.fullmatch(self.raw, s[i], e[i])
            number[i] = bool(m) and m[1] in UNIT_WORDS
        dashes = np.concatenate(([0], np.cumsum(data == 45)))
        for i in np.flatnonzero((dashes[e] > dashes[s]) & (nd == 0)).tolist():
            if HYPHEN.fullmatch(self.raw, s[i], e[i]):
                number[i] = all(x in SPELLED_WORDS for x in self.raw[s[i] : e[i]].split(b"-"))
        follows = np.zeros(len(s), bool)
        follows[1:] = number[:-1]
        unit = follows & ~number & _among(plain, UNIT_CODES | U(4))
        first = np.zeros(len(s), bool)
        first[w.first[:-1][w.first[:-1] < len(s)]] = True
        begins = first.copy()
        apart = first.copy()
        if len(s) > 1:
            begins[1:] |= STOP[data[w.ends[:-1] - 1]]
            lines = np.concatenate(([0], np.cumsum(data == 10)))
            begins[1:] |= lines[w.starts[1:]] > lines[w.ends[:-1]]
            apart[1:] |= APART[data[w.ends[:-1] - 1]]
        lead = data[s] if len(s) else data[:0]
        capital = (lead >= 65) & (lead <= 90)
        wide = np.flatnonzero((lead == 0xC3) & (s + 1 < len(data)))
        capital[wide] = second[s[wide] + 1]
        # a single letter or a word in capitals is no name
        after = np.minimum(s + 1, max(0, len(data) - 1))
        shouted = (e - s < 2) | ((data[after] >= 65) & (data[after] <= 90)) if len(s) else np.zeros(0, bool)
        name = capital & ~shouted & ~number
        self.plain = plain
        self.literal = ~number & ~unit & ~(name & ~begins)
        self.owner = w.text_of_words()
        self.streams = [self._stream(np.where(number, NUMBER, np.where(unit, UNIT, np.where(n, NAME, plain))), begins | apart, name & begins & (k == 1)) for k, n in enumerate((name & ~begins, name))]

    def _stream(self, code: np.ndarray, apart: np.ndarray, perhaps: np.ndarray) -> Stream:
        new = np.ones(len(code), bool)
        new[1:] = apart[1:] | (code[1:] != code[:-1]) | ((code[1:] != NUMBER) & (code[1:] != NAME))
        at = np.flatnonzero(new)
        # a unit of a sentence's first word that may be a name
        marked = np.add.reduceat(perhaps.astype(np.int64), at) > 0 if len(at) else np.zeros(0, bool)
        return Stream(code[at], at, np.append(at[1:], len(code)), marked)

    def windows(self, size: int, short: Iterable[int]) -> tuple[np.ndarray, ...]:
        """(hash, way, unit, first word, words) of the windows inside one text. Way 0 and 1: template codes, with sentence beginnings as words or as names
        (those that hold one only); way 2: exact words, where fewer than three are literal, and of the short sizes."""
        out = []
        for way, x in enumerate(self.streams):
            n = len(x.code)
            h = window_hashes(x.code, size)
            at = np.arange(len(h))
            fixed = np.concatenate(([0], np.cumsum(x.code > NAME)))
            marked = np.concatenate(([0], np.cumsum(x.marked)))
            good = (fixed[at + size] - fixed[at] >= LITERAL) & (self.owner[x.at[at]] == self.owner[x.at[at + size - 1]]) if n >= size else np.zeros(0, bool)
            if way:
                good &= marked[at + size] > marked[at]
            at = at[good]
            out.append((h[good], np.full(len(at), way), at, x.at[at], x.end[at + size - 1] - x.at[at]))
        literal = np.concatenate(([0], np.cumsum(self.literal)))
        for k in (size, *sorted(short)):
            h = mix(window_hashes(self.plain, k) ^ U(k))
            at = np.arange(len(h))
            good = self.owner[at] == self.owner[at + k - 1] if len(h) else np.zeros(0, bool)
            if k == size:
                good &= literal[at + k] - literal[at] < LITERAL if len(h) else good
            at = at[good]
            out.append((h[good], np.full(len(at), 2), at, at, np.full(len(at), k)))
        return tuple(np.concatenate(c) for c in zip(*out))

    def units(self, way: int, unit: int, words: int, size: int) -> list[tuple[int, int, bool]]:
        """(first word, end, whether it is a slot) of the units of a window."""
        if way == 2:
            return [(k, k + 1, False) for k in range(unit, unit + words)]
        x = self.streams[way]
        return [(int(x.at[k]), int(x.end[k]), x.code[k] <= NAME) for k in range(unit, unit + size)]

    def words_of(self, a: int, b: int) -> bytes:
        return b" ".join(self.raw[self.starts[i] : self.ends[i]] for i in range(a, b))


class Stream(NamedTuple):
    code: np.ndarray
    at: np.ndarray
    end: np.ndarray
    marked: np.ndarray


class Items:
    """A block of benchmark items: their windows as a sorted table."""

    def __init__(self, rows: list[tuple[int, str | None]], size: int = WINDOW):
        self.ids = [r[0] for r in rows]
        t = self.template = Template(pa.array([r[1] for r in rows], pa.string()))
        self.first, self.size = t.words.first, size
        self.n = np.diff(self.first)
        self.short = {int(k) for k in np.unique(self.n) if SHORT <= k < size}
        h, way, unit, word, words = t.windows(size, self.short)
        item = t.owner[word]
        # a short window stands for an item of that size only
        good = (words >= size) | (way < 2) | (self.n[item] == words)
        order = np.flatnonzero(good)[np.argsort(h[good], kind="stable")]
        self.hashes, self.way, self.unit, self.word, self.words, self.item = (x[order] for x in (h, way, unit, word, words, item))


def matches(column: pa.Array, items: Items, cover: float = COVER) -> list[tuple[int, int, int, int, bool, int]]:
    """(row, item number, words covered, words of the item, the same values, first word) of every match."""
    if not len(items.hashes):
        return []
    t, size = Template(column), items.size
    h, way, unit, word, words = t.windows(size, items.short)
    low, high = np.searchsorted(items.hashes, h, "left"), np.searchsorted(items.hashes, h, "right")
    times = high - low
    hit = np.flatnonzero(times)
    ours = np.repeat(hit, times[hit])  # every window of a document with every equal window of an item
    theirs = runs(low[hit], times[hit])
    if not len(ours):
        return []
    row, item = t.owner[word[ours]], items.item[theirs]
    shift = word[ours] - (items.word[theirs] - items.first[item])
    order = np.lexsort((shift, item, row))
    ours, theirs, row, item, shift = (x[order] for x in (ours, theirs, row, item, shift))
    new = np.append(True, (row[1:] != row[:-1]) | (item[1:] != item[:-1]) | (shift[1:] - shift[:-1] > DRIFT))
    lead = np.flatnonzero(new)
    # a chain that can't cover enough, even if its windows do not overlap, ends here
    enough = np.add.reduceat(items.words[theirs], lead) >= cover * items.n[item[lead]]
    best: dict[tuple[int, int], tuple] = {}
    for a, b in zip(lead[enough].tolist(), np.append(lead[1:], len(ours))[enough].tolist()):
        found = _covered(t, items, a, b, ours, theirs, way, unit, words, shift)
        key, n = (int(row[a]), int(item[a])), int(items.n[item[a]])
        if found[0] >= cover * n:
            found = (found[0], n, found[1], found[2] - int(t.words.first[key[0]]))
            if key not in best or found > best[key]:
                best[key] = found
    return [(*key, *found) for key, found in sorted(best.items())]


def _covered(t: Template, items: Items, a: int, b: int, ours: np.ndarray, theirs: np.ndarray, way: np.ndarray, unit: np.ndarray, words: np.ndarray, shift: np.ndarray) -> tuple[int, bool, int]:
    """Of one chain of hits: how many words of the item are met consistently, whether all values are the same, and the document's first word."""
    middle = int(shift[(a + b) // 2])
    # the hits nearest to the chain's middle speak first; a unit of the item is lined up once
    order = sorted(range(a, b), key=lambda k: (abs(int(shift[k]) - middle), int(items.word[theirs[k]])))
    there, back, taken, same, n_good, first = {}, {}, set(), True, 0, None
    for k in order:
        i, j = int(ours[k]), int(theirs[k])
        mine = t.units(int(way[i]), int(unit[i]), int(words[i]), items.size)
        other = items.template.units(int(items.way[j]), int(items.unit[j]), int(items.words[j]), items.size)
        for (s, e, slot), (x, y, _) in zip(mine, other):
            if any(q in taken for q in range(x, y)):
                continue
            value, wanted = t.words_of(s, e), items.template.words_of(x, y)
            if not slot and value != wanted:
                continue
            if slot:
                if there.setdefault(wanted, value) != value or back.setdefault(value, wanted) != wanted:
                    continue
                same &= value == wanted
            taken.update(range(x, y))
            n_good += y - x
            first = s if first is None else min(first, s)
    return n_good, same, first or 0


def item_blocks(benchmark: DataFrame, block: int = BLOCK) -> Iterator[Items]:
    """The benchmark in blocks of about ``block`` items, each small enough to broadcast; the number of blocks grows with it."""
    n = benchmark.count()
    parts = -(-n // block)
    for k in range(parts):
        part = benchmark.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == k) if parts > 1 else benchmark
        yield Items([(r["item_id"], r["text"]) for r in part.select("item_id", "text").orderBy("item_id", "text").collect()])


def find(docs: DataFrame, benchmark: DataFrame, cover: float = COVER, block: int = BLOCK) -> DataFrame:
    """(doc_id, item_id, n_covered, n_words, same_values, first_word): every document that holds an item, with its best place.

    Items of one or two words are ordinary phrases and match nothing; those of three or four match by their exact words. Null texts match
    nothing. Repeated rows and repeated items are reported each.
    """
    out = docs.sparkSession.createDataFrame([], RESULT)
    for items in item_blocks(benchmark, block):
        table = docs.sparkSession.sparkContext.broadcast(items)

        def run(batches: Iterable[pa.RecordBatch], table=table) -> Iterator[pa.RecordBatch]:
            for batch in pieces(batches, most=2 << 20):
                found = matches(batch.column(1), table.value, cover)
                ids = batch.column(0).to_pylist()
                cols = [[ids[m[0]] for m in found], [table.value.ids[m[1]] for m in found], *([m[k] for m in found] for k in (2, 3, 4, 5))]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [pa.int64()] * 4 + [pa.bool_(), pa.int64()])], ["doc_id", "item_id", "n_covered", "n_words", "same_values", "first_word"])

        out = out.unionByName(docs.select("doc_id", "text").mapInArrow(run, RESULT))
    return out


RESULT = "doc_id long, item_id long, n_covered long, n_words long, same_values boolean, first_word long"


def clean(docs: DataFrame, benchmark: DataFrame, cover: float = COVER, block: int = BLOCK) -> DataFrame:
    """The rows of docs that hold no benchmark item, with all their columns; nothing is shuffled."""
    at = docs.columns.index("text")
    for items in item_blocks(benchmark, block):
        table = docs.sparkSession.sparkContext.broadcast(items)

        def run(batches: Iterable[pa.RecordBatch], table=table) -> Iterator[pa.RecordBatch]:
            for batch in pieces(batches, most=2 << 20):
                keep = np.ones(batch.num_rows, bool)
                keep[[m[0] for m in matches(batch.column(at), table.value, cover)]] = False
                yield batch if keep.all() else batch.filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
