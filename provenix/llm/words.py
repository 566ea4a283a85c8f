"""Words of UTF-8 text as numpy arrays.

A word is a run of bytes other than 0x20 and 0x09-0x0D, the same as the characters
``[^\\x20\\x09-\\x0D]+``, since no byte of a longer UTF-8 sequence is below 0x80.
Everything works on the bytes of a whole Arrow column at once; no Python string is made per word.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BASE = 0x9E3779B97F4A7C13  # odd, 3 modulo 8
MASK = (1 << 64) - 1


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit (the finaliser of SplitMix64)."""
    h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


BYTE_CODES = mix(np.arange(1, 257, dtype=U) * U(0x9E3779B97F4A7C15))
_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i < n."""
    if len(_powers.get("up", ())) < n:
        size = max(n, 1 << 16)
        for name, base in (("up", BASE), ("down", pow(BASE, -1, 1 << 64))):
            x = np.full(size, base, U)
            x[0] = 1
            _powers[name] = np.multiply.accumulate(x)
    return _powers["up"][:n], _powers["down"][:n]


def span_hashes(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of codes[start:end], equal for equal content wherever it stands."""
    if not len(starts):
        return np.zeros(0, U)
    up, down = powers(len(codes) + 1)
    total = np.zeros(len(codes) + 1, U)
    np.cumsum(codes * up[:-1], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(U))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts and the offsets of each; a null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    body = column.buffers()[2]
    data = np.frombuffer(body, np.uint8)[offsets[0] : offsets[-1]] if body is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def spans_of(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of bytes that are inside; a run ends with its text."""
    n = len(inside)
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    begins, ends = inside.copy(), inside.copy()
    if n:
        begins[1:] &= ~inside[:-1] | edge[1:n]
        ends[:-1] &= ~inside[1:] | edge[1:n]
    return np.flatnonzero(begins), np.flatnonzero(ends) + 1


class Words:
    """starts, ends: byte spans of words; first: index of each text's first word, and the number of words at the end."""

    def __init__(self, column: pa.Array):
        self.data, self.offsets = utf8(column)
        inside = ~SPACE[self.data]
        n = len(inside)
        edge = np.zeros(n + 1, bool)
        edge[self.offsets] = True
        begins, ends = inside.copy(), inside.copy()
        if n:
            begins[1:] &= ~inside[:-1] | edge[1:n]
            ends[:-1] &= ~inside[1:] | edge[1:n]
        self.inside = inside
        self.starts, self.ends = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.starts, self.offsets)

    def __len__(self) -> int:
        return len(self.starts)

    def hashes(self) -> np.ndarray:
        return span_hashes(BYTE_CODES[self.data], self.starts, self.ends)

    def text_of_words(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.offsets) - 1), np.diff(self.first))

    def joined(self, lower: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All words with one space after each (none at a text's end without one), and where they then start and end."""
        keep = self.inside.copy()
        if len(keep):
            keep[1:] |= self.inside[:-1]
            # a separator at the start of a text belongs to no word of that text
            at = self.offsets[:-1]
            at = at[at < len(keep)]
            keep[at] = self.inside[at]
        place = np.zeros(len(keep) + 1, np.int64)
        np.cumsum(keep, out=place[1:])
        data = np.where(self.inside, self.data, np.uint8(0x20))[keep]
        return (LOWER[data] if lower else data), place[self.starts], place[self.ends]


def window_hashes(codes: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of ``size`` codes, by its start; runs may cross texts, the caller masks those."""
    n = max(0, len(codes) - size + 1)
    at = np.arange(n)
    return span_hashes(codes, at, at + size)


def runs(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Concatenated ranges start, start+1, ... of the given counts."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    out = np.ones(total, np.int64)
    kept = counts > 0
    s, c = starts[kept], counts[kept]
    at = np.cumsum(c)[:-1]
    out[0] = s[0]
    out[at] = s[1:] - (s[:-1] + c[:-1] - 1)
    return np.cumsum(out)
