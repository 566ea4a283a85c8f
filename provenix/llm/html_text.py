"""Main text of web pages by line-block distribution.

Markup is stripped to one line per block element. Parts that the markup itself names as something other than the article
(navigation, headers outside the article, footers, sidebars, forms, adverts, notices, comments) give no lines. Every other line has a length of
running text: its characters outside links, nothing if most of it is links, and, if the page has an <article> or <main> element, nothing outside it and the
whole line in its paragraphs. These lengths are summed in a sliding window of lines; where the sum surges the main text begins, where it dives
to nothing it ends, and all lines between are kept whole, those that are links only too. The surge is half of the page's peak, and at most SURGE.
Every step takes time in proportion to the page, however its elements nest.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame

from provenix.llm.common import pieces

WINDOW = 3  # lines whose lengths are summed
SURGE = 40  # characters of running text in a window from which the main text may begin, on pages whose peak is twice that or more
# Elements of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset("script style noscript template textarea select button iframe object svg math canvas audio video head title datalist".split())
ASIDE = frozenset("nav footer aside form dialog menu".split())
BLOCK = frozenset(
    "address article blockquote body br center dd details dir div dl dt fieldset figcaption figure h1 h2 h3 h4 h5 h6 header hr html legend li main ol p pre section summary table tbody td tfoot th thead tr ul nav footer aside form menu dialog".split()
)
CLOSES_P = BLOCK - {"br", "html", "body", "li", "dt", "dd", "td", "th", "tr", "tbody", "thead", "tfoot"}
CLOSES_ITSELF = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
INLINE_STOP = BLOCK | SILENT
# names that make even a paragraph of the article something else; others (related, notice, banner ...) may name prose there
NAMED_IN_TEXT = re.compile(r"(?:^|[\s_-])(?:ad|ads|adv|advert\w*|adsense|sponsor\w*|promo\w*|cookie\w*|consent|gdpr|newsletter|subscribe|share\w*|sharing|social\w*|comments?|commentlist|disqus\w*|replies|respond|copyright)(?:$|[\s_-])", re.I)
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre".split())
NAMED = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|adv|advert\w*|adsense|banner|sponsor\w*|promo\w*|cookie\w*|consent|gdpr|notice|notification|alert|popup|modal|overlay|newsletter|subscribe|signup|login"
    r"|nav\w*|menu\w*|breadcrumbs?|crumbs|sidebar\w*|widget\w*|related|recommended|share\w*|sharing|social\w*|comments?|commentlist|disqus\w*|replies|respond|discussion|reader-?comments|footer|header|masthead|topbar|toolbar|copyright|pagination|pager|skip)(?:$|[\s_-])",
    re.I,
)


class _Lines(HTMLParser):
    """Collects (line, characters inside links, inside the article, inside a list); block elements end lines."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, bool]] = []  # element, whether it silences what it holds
        self.at: dict[str, list[int]] = {}  # where elements of a name stand in it
        self.blocks: list[int] = []  # where those stand that an end tag of an inline element does not pass
        self.mute = self.deep = self.linked = self.listed = 0
        self.lines: list[tuple[str, int, bool, bool]] = []
        self.text: list[str] = []
        self.link_chars = 0
        self.seen_article = False

    def flush(self) -> None:
        line = " ".join("".join(self.text).split())
        if line:
            self.lines.append((line, self.link_chars, self.deep > 0, self.listed > 0))
        self.text, self.link_chars = [], 0

    def _push(self, tag: str, silent: bool) -> None:
        self.at.setdefault(tag, []).append(len(self.open))
        if tag in INLINE_STOP:
            self.blocks.append(len(self.open))
        self.open.append((tag, silent))
        self.mute += silent
        self.deep += tag in ("article", "main") and not self.mute
        self.seen_article |= tag in ("article", "main") and not self.mute
        self.linked += tag == "a"
        self.listed += tag == "li"

    def _pop(self, upto: int) -> None:
        while len(self.open) > upto:
            tag, silent = self.open.pop()
            self.at[tag].pop()
            if tag in INLINE_STOP:
                self.blocks.pop()
            self.deep -= tag in ("article", "main") and not self.mute
            self.mute -= silent
            self.linked -= tag == "a"
            self.listed -= tag == "li"

    def _last(self, tags: Iterable[str]) -> int:
        return max((x[-1] for t in tags if (x := self.at.get(t))), default=-1)

    def _close(self, tags: tuple[str, ...], stop: frozenset[str]) -> None:
        if (i := self._last(tags)) > self._last(stop):
            self._pop(i)

    def handle_starttag(self, tag, attrs):
        if tag in BLOCK:
            self.flush()
        if tag in VOID:
            return
        if tag in CLOSES_P:
            self._close(("p",), frozenset("table td th li div section article blockquote body main".split()))
        if tag in CLOSES_ITSELF:
            self._close(CLOSES_ITSELF[tag], frozenset("ul ol dl table select".split()))
        if tag == "body":  # a head left open ends here
            self._close(("head",), frozenset())
        given = dict(attrs)
        silent = tag in SILENT or tag in ASIDE or (tag == "header" and not self.deep) or "hidden" in given or given.get("aria-hidden") == "true" or (given.get("role") or "").lower() in ROLES
        if not silent and tag not in ("html", "body", "h1") and (self.deep or tag not in ("article", "main")):
            names = NAMED_IN_TEXT if self.deep and tag in PROSE else NAMED
            silent = bool(names.search(f"{given.get('class') or ''} {given.get('id') or ''}"))
        silent = silent or "display:none" in (given.get("style") or "").replace(" ", "").lower()
        self._push(tag, silent)

    def handle_startendtag(self, tag, attrs):
        if tag in BLOCK:
            self.flush()

    def handle_endtag(self, tag):
        if tag in BLOCK:
            self.flush()
        i = self._last((tag,))
        # an end tag of an inline element does not close blocks around it
        if i >= 0 and (tag in INLINE_STOP or not self.blocks or i > self.blocks[-1]):
            self._pop(i)

    def handle_data(self, data):
        if not self.mute:
            self.text.append(data)
            if self.linked:
                self.link_chars += len(data.strip())

    def unknown_decl(self, data):
        pass


def lines_of(html: str) -> list[tuple[str, int]]:
    """(line, length of its running text) of the lines that no part of another name holds."""
    p = _Lines()
    # behind the last ">" no tag can end: what looks like one is text (an open comment hides the rest), and is not tried again and again
    head, end, tail = html.rpartition(">")
    p.feed(head + end + tail.partition("<!--")[0].replace("<", "&lt;"))
    p.close()
    p.flush()
    article = p.seen_article and any(inside for _, _, inside, _ in p.lines)
    out = []
    for line, links, inside, listed in p.lines:
        if article:
            n = len(line) if inside and not (listed and links * 2 > len(line)) else 0
        else:
            n = 0 if links * 2 > len(line) else max(0, len(line) - links)
        out.append((line, n))
    return out


def spans(lengths: list[int], window: int = WINDOW, surge: int = SURGE) -> list[tuple[int, int]]:
    """Line ranges between a surge (a window sum of half the peak, at most ``surge``) and the dive to nothing that follows."""
    n, out, at = len(lengths), [], 0
    ahead = [0]
    for x in lengths:
        ahead.append(ahead[-1] + x)
    sums = [ahead[min(n, i + window)] - ahead[i] for i in range(n)]
    surge = max(1, min(surge, max(sums, default=0) // 2))
    while at < n:
        if sums[at] < surge or not lengths[at]:
            at += 1
            continue
        end = at
        while end < n and sums[end]:
            end += 1
        # the window looks ahead: what stood before the surge without a dive belongs to the text
        begin = at
        while begin > 0 and lengths[begin - 1] and (not out or begin > out[-1][1]):
            begin -= 1
        out.append((begin, end))
        at = end
    return out


def main_text(html: str | None) -> str:
    """The main text, its blocks joined by one line break; empty if there is none."""
    if not html:
        return ""
    lines = lines_of(html)
    return "\n".join(line for a, b in spans([n for _, n in lines]) for line, _ in lines[a:b])


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every row of pages; a null html has an empty text. Every line that is kept is whole."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "html"):
            texts = [main_text(h) for h in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")
