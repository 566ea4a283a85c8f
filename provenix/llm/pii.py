"""Personal data in text: plain patterns on the text itself, and the same patterns on a deobfuscated copy whose characters
remember where they came from.

The copy is made by transducers, one after another, each of which reads a string with the source span of every character and
writes another: look-alike letters and digits become ASCII, zero-width characters go, "[at]" and "(dot)" disguises become
signs, runs of spelled-out digits become digits. What is found in the copy is mapped back to source characters. Texts that no
transducer changes (nearly all) are searched once.
"""

from __future__ import annotations

import bisect
import hashlib
import re
import unicodedata
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from provenix.llm.common import pieces

KINDS = ("email", "ip", "card", "phone")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")  # a match always begins where its digits do; looking behind keeps it linear
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
# Letters of other scripts that look like ASCII ones, in the order of the ASCII letters beside them.
HOMOGLYPHS = str.maketrans(
    "аеорсухіјѕԁһԛԝАВЕКМНОРСТУХІЈЅαορνικτΑΒΕΖΗΙΚΜΝΟΡΤΥΧ",
    "aeopcyxijsdhqwABEKMHOPCTYXIJSaopviktABEZHIKMNOPTYX",
)
ZERO_WIDTH = frozenset("​‌‍⁠﻿­")
SPELLED = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
}
_NUMBER = "(?:" + "|".join(sorted(SPELLED, key=len, reverse=True)) + ")"
SPELLED_RUN = re.compile(rf"(?<!\w)(?:(?:plus[\s,-]+)?{_NUMBER}|\+?[0-9]+)(?:[\s,-]+(?:{_NUMBER}|[0-9]+)){{6,}}(?!\w)", re.I)
SPELLED_ONE = re.compile(rf"{_NUMBER}|plus|[0-9]", re.I)
# a run of white space is entered at its beginning only, which keeps a long one linear
AT = re.compile(r"(?<!\s)\s*(?:[\[({<]\s*(?:at|@)\s*[\])}>])\s*|(?<!\s)\s+(?:_at_|-at-)\s+", re.I)
DOT = re.compile(r"(?<!\s)\s*(?:[\[({<]\s*(?:dot|punkt|punto|point|\.)\s*[\])}>])\s*|(?<!\s)\s+(?:_dot_|-dot-)\s+", re.I)
# what is still a word after those: "at", "dot" or both. They are words too, so a known top-level domain or a clear context must confirm
# the dot, and a dot in disguise or a clear context the "at".
TOP_LEVEL = frozenset(
    "ac ad ae af ag ai al am ao aq ar as at au aw ax az ba bb bd be bf bg bh bi bj bm bn bo br bs bt bv bw by bz ca cc cd cf cg ch ci ck cl cm cn co cr cu cv cw cx cy cz de dj dk dm do dz"
    " ec ee eg er es et eu fi fj fk fm fo fr ga gb gd ge gf gg gh gi gl gm gn gp gq gr gs gt gu gw gy hk hm hn hr ht hu id ie il im in io iq ir is it je jm jo jp ke kg kh ki km kn kp kr kw ky kz"
    " la lb lc li lk lr ls lt lu lv ly ma mc md me mg mh mk ml mm mn mo mp mq mr ms mt mu mv mw mx my mz na nc ne nf ng ni nl no np nr nu nz om pa pe pf pg ph pk pl pm pn pr ps pt pw py qa re ro rs ru rw"
    " sa sb sc sd se sg sh si sj sk sl sm sn so sr ss st su sv sx sy sz tc td tf tg th tj tk tl tm tn to tr tt tv tw tz ua ug uk us uy uz va vc ve vg vi vn vu wf ws ye yt za zm zw"
    " com org net edu gov mil int arpa info biz name pro aero coop museum jobs mobi tel cat asia travel post dev app xyz online site shop store tech cloud blog club live email agency systems solutions academy".split()
)
NO_HOST = frozenset("the a an this that these those his her its our your my their each every any some one no which what".split())
WORDY = re.compile(r"(?<![\w.%+-])([A-Za-z0-9](?:[A-Za-z0-9._%+-]|\s+dot\s+(?=[A-Za-z0-9])){0,63})(\s+at\s+|@)((?:[A-Za-z0-9-]+(?:\s+dot\s+|\.)){1,6}([A-Za-z]{2,24}))(?![\w-])", re.I)
CUE = re.compile(r"(?:\b(?:e-?mail|mail|address|contact|write|reach)(?:\s+(?:me|us|him|her|them|to|is|at|address))*\s*[:=]?|^[^\w\n]*|\n[^\w\n]*)\s*\Z", re.I)
ALONE = re.compile(r"[^\w\n]*(?:\n|\Z)")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind number) of the plain patterns; every step reads the text from left to right once."""
    out = []
    at = text.find("@")
    last = 0
    while at >= 0:
        begin = at
        while begin > last and text[begin - 1] in LOCAL:
            begin -= 1
        m = DOMAIN.match(text, at) if begin < at else None
        if m:
            out.append((begin, last := m.end(), 0))
        at = text.find("@", max(at + 1, last))
    if re.search("[0-9]", text):
        for m in IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p[-4:] if p.lstrip("0") else "0") <= 255 for p in m[0].split(".")):
                out.append((m.start(), m.end(), 1))
        for m in CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), m.end(), 2))
        if "+" in text:
            for m in PHONE.finditer(text):
                if 9 <= sum(map(str.isdigit, m[0])) <= 15:
                    out.append((m.start(), m.end(), 3))
    return sorted(out, key=lambda s: (s[0], s[2]))


class Tape:
    """A string whose every character knows the source span it stands for."""

    def __init__(self, text: str):
        self.text, self.starts, self.ends = text, range(len(text)), range(1, len(text) + 1)

    def rewrite(self, pattern: re.Pattern, write) -> None:
        """Replaces each match by write(match); what is written stands for the whole match."""
        out, starts, ends, at = [], [], [], 0
        for m in pattern.finditer(self.text):
            new = write(m)
            if new is None:
                continue
            a, b = m.span()
            out.append(self.text[at:a]), starts.extend(self.starts[at:a]), ends.extend(self.ends[at:a])
            if isinstance(new, list):  # (character, start in the match, end in the match)
                for c, s, e in new:
                    out.append(c), starts.append(self.starts[s]), ends.append(self.ends[e - 1])
            else:
                out.append(new)
                starts.extend([self.starts[a]] * len(new)), ends.extend([self.ends[b - 1]] * len(new))
            at = b
        if at:
            out.append(self.text[at:]), starts.extend(self.starts[at:]), ends.extend(self.ends[at:])
            self.text, self.starts, self.ends = "".join(out), starts, ends

    def each(self, write) -> None:
        """Replaces each character by the string write(character); an empty string removes it."""
        out, starts, ends = [], [], []
        for c, s, e in zip(self.text, self.starts, self.ends):
            for x in write(c):
                out.append(x), starts.append(s), ends.append(e)
        self.text, self.starts, self.ends = "".join(out), starts, ends


def _plain(c: str) -> str:
    if c < "\x80":
        return c
    if c in ZERO_WIDTH:
        return ""
    if (x := c.translate(HOMOGLYPHS)) != c:
        return x
    if (d := unicodedata.decimal(c, None)) is not None:
        return str(d)
    x = unicodedata.normalize("NFKC", c)
    return x if x.isascii() and x.strip() else c


def _at_dot(m: re.Match, tape: Tape) -> list[tuple[str, int, int]] | None:
    text, (local, at, host, top) = m.string, m.groups()
    words = re.findall(r"\s(dot)\s", host, re.I)
    if at == "@" and not words and not re.search(r"\s", local):
        return None  # plain
    head = text[max(0, m.start() - 60) : m.start()]
    cue = CUE.search(head if len(head) == m.start() else "x" + head)
    # an address by its context: after a word like "mail", alone on its line, or with a name no plain word has
    clear = bool(cue and (cue[0].strip(" \t\n:=").isascii() and re.search("[a-z]", cue[0], re.I) or ALONE.match(text, m.end()))) or bool(re.search(r"[0-9_%+.-]|\sdot\s", local, re.I))
    if words:
        if at != "@" and re.match(r"[A-Za-z0-9-]+", host)[0].lower() in NO_HOST:
            return None
        if top.lower() not in TOP_LEVEL and not clear:
            return None
    elif at != "@" and not clear:
        dots = [i for i in range(m.start(3), m.end(3)) if text[i] == "."]
        if not any(tape.ends[i] - tape.starts[i] > 1 for i in dots):
            return None  # "see us at example.com"
    out = []
    for piece in re.finditer(r"\s+(at|dot)\s+|.", text[m.start() : m.end()], re.I | re.S):
        s, e = m.start() + piece.start(), m.start() + piece.end()
        out.append((piece[0] if not piece[1] else "@" if piece[1].lower() == "at" else ".", s, e))
    return out


def _digits(m: re.Match) -> list[tuple[str, int, int]] | None:
    got = [(SPELLED.get(x[0].lower(), "+" if x[0].lower() == "plus" else x[0]), m.start() + x.start(), m.start() + x.end()) for x in SPELLED_ONE.finditer(m[0])]
    if not any(text_char.isalpha() for text_char in m[0]):
        return None
    return ([("+", m.start(), m.start() + 1)] if m[0][0] == "+" else []) + got


ODD = re.compile(r"[Ͱ-ԯ٠-٩۰-۹०-९！-～​-‍⁠﻿­\U0001d400-\U0001d7ff①-⑳]")
HINT = re.compile(r"(?i)[\[({<]\s*(?:at|@|dot|punkt|punto|point|\.)\s*[\])}>]|\s(?:_at_|-at-|_dot_|-dot-|dot)\s|\sat\s+[A-Za-z0-9-]+\.[A-Za-z0-9]")
HINT_DIGITS = re.compile(rf"(?i)(?<!\w)(?:{_NUMBER}[\s,-]+(?:{_NUMBER}|[0-9]+)|[0-9]+[\s,-]+{_NUMBER})(?!\w)")


def deobfuscated(text: str) -> Tape | None:
    """The normalised copy, or None if no transducer finds work."""
    odd, signs, digits = bool(ODD.search(text)), bool(HINT.search(text)), bool(HINT_DIGITS.search(text))
    if not (odd or signs or digits):
        return None
    tape = Tape(text)
    if odd:
        tape.each(_plain)
        signs, digits = bool(HINT.search(tape.text)), bool(HINT_DIGITS.search(tape.text))
    if signs:
        tape.rewrite(AT, lambda m: "@")
        tape.rewrite(DOT, lambda m: ".")
        tape.rewrite(WORDY, lambda m: _at_dot(m, tape))
    if digits:
        tape.rewrite(SPELLED_RUN, _digits)
    return tape if tape.text != text else None


def all_spans(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """The base spans, and those of the deobfuscated copy that touch no base span of their kind."""
    tape = deobfuscated(text)
    if tape is None:
        return base
    out = list(base)
    own = [[s for s in base if s[2] == kind] for kind in range(len(KINDS))]  # spans of one kind stand apart and in order
    for a, b, kind in base_spans(tape.text):
        s, e = tape.starts[a], tape.ends[b - 1]
        before = bisect.bisect_left(own[kind], (e,)) - 1  # the last one that begins before e
        if e > s and (before < 0 or own[kind][before][1] <= s):
            out.append((s, e, kind))
    return sorted(set(out), key=lambda s: (s[0], s[2], s[1]))


def listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, e, k in spans)


def find(docs: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added) of every row of docs(doc_id, text).

    The counts and base_sha256 are of the plain patterns; ``spans`` lists those and what deobfuscation adds (n_added of them).
    Offsets are code points, ends exclusive. A null or empty text has no spans. Repeated rows are treated alike.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            rows = []
            for text in batch.column(1).to_pylist():
                base = base_spans(text) if text else []
                every = all_spans(text, base) if text else base
                rows.append((*(sum(k == i for _, _, k in base) for i in range(4)), hashlib.sha256(listed(base).encode()).hexdigest(), listed(every), len(every) - len(base)))
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds))], ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long")
