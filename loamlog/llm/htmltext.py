"""Main text of web pages by the distribution of text over line blocks.

Markup is stripped first: every block element ends a line, so a page becomes lines, most of them
empty. A line weighs the characters it has outside of links. What a reader does not come for
weighs nothing and leaves an empty line: scripts, styles and other raw elements, hidden ones,
menus, headers, footers, asides, forms, and elements whose class, id or role names one of these,
a notice, an advert or reader comments. Headers inside of an article belong to it. A line of an
``article`` or ``main`` element weighs enough to surge by itself, and a page that has such an
element weighs nothing outside of it.

Weights are then summed over sliding windows of ``WINDOW`` lines. Going down the page, a surge is
the first line with weight whose window sums to ``SURGE`` or more, the dive after it the first
line whose window sums to nothing. The text between them is kept, without the lines that weigh
nothing because of where they stand. A page without any surge keeps the stretch around its
heaviest window, so a short text is not lost.

Null and empty html, and a page without text, give an empty text. Texts of any length are read
whole, in time linear in their length. Pages are treated row by row: repeated rows, ties and null
ids keep their rows, an empty table gives an empty one. Columns named like added ones are replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamlog.llm.common import other_columns

ADDED = ("text", "n_chars")
#: Lines in one window, and the characters in it that make a surge.
WINDOW = 3
SURGE = 86

# HTML's own element names.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style noscript template iframe svg math canvas object textarea title select".split())
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption "
    "figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre "
    "search section summary table tbody td tfoot th thead tr ul".split()
)
_BESIDE = frozenset("nav menu footer aside form fieldset dialog button label head search".split())
_OWN = frozenset(("article", "main"))
#: An open element of the first kind ends where a sibling of these begins.
_ENDS = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}, "tr": {"tr", "tbody", "tfoot"},
    "td": {"td", "th", "tr", "tbody", "tfoot"}, "th": {"td", "th", "tr", "tbody", "tfoot"}, "thead": {"tbody", "tfoot"},
    "tbody": {"tbody", "tfoot"},
}
# Words by which pages name what is not their text.
_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments contentinfo "
    "cookie cookies consent discussion disqus footer gdpr masthead menu nav navbar navigation newsletter notice "
    "pagination paywall popup promo promoted promotion recommended related replies respond search share sharing "
    "sidebar signup skyscraper social sponsor sponsored subscribe toolbar widget".split()
)
_HEADERS = frozenset(("header", "banner", "masthead"))

#: Tags with quotes that never close, after which a page's tags end at the first ``>``: each such
#: tag is read to the end of the page.
_OPEN_QUOTES = 64
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*>", re.S)
_LOOSE = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([A-Za-z][^\s/>]*)([^>]*)>|<[!?][^>]*>", re.S)
_NAMED = re.compile(r"(?:^|[\s\"'])(class|id|role|style|hidden|aria-hidden)\b(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


def _beside(tag: str, attributes: str, inside: bool) -> bool:
    """Whether an element stands beside the text: by its name, its names, or because it is hidden."""
    if tag in _BESIDE or (tag == "header" and not inside):
        return True
    if not attributes or tag in ("html", "body", "main"):
        return False
    for found in _NAMED.finditer(attributes):
        name, value = found[1].lower(), (found[2] or "").strip("\"'")
        if name == "hidden" and value.lower() != "until-found":
            return True
        if name == "aria-hidden":
            if value.lower() == "true":
                return True
        elif name == "style":
            if _UNSEEN.search(value):
                return True
        elif name in ("class", "id", "role"):
            words = {w.lower() for w in _WORD.findall(value)}
            if inside:
                words -= _HEADERS
            elif "header" in words:
                return True
            if words & _NAMES:
                return True
    return False


class _Lines:
    """A page's lines: ``texts``, ``weights`` outside of links, and ``places`` (see below)."""

    BESIDE, PLAIN, OWN = 0, 1, 2

    def __init__(self):
        self.texts: list[str] = []
        self.weights: list[int] = []
        self.places: list[int] = []
        self._parts: list[str] = []
        self._linked = 0

    def add(self, text: str, linked: bool) -> None:
        self._parts.append(text)
        if linked:
            self._linked += len("".join(unescape(text).split()))

    def end(self, place: int) -> None:
        text = " ".join(unescape("".join(self._parts)).split())
        signs = len(text) - text.count(" ")
        self.texts.append(text)
        self.weights.append(len(text) if not self._linked else max(0, signs - self._linked))
        self.places.append(place)
        self._parts, self._linked = [], 0


def _lines(html: str) -> _Lines:
    lines = _Lines()
    open_: list[tuple[str, bool, bool]] = []  # name, beside the text, an article or main
    count: dict[str, int] = {}
    beside = own = 0
    linked = False

    def place() -> int:
        return lines.BESIDE if beside else lines.OWN if own else lines.PLAIN

    def leave() -> None:
        nonlocal beside, own
        name, was_beside, was_own = open_.pop()
        count[name] -= 1
        beside -= was_beside
        own -= was_own

    at, size = 0, len(html)
    last, open_quotes = html.rfind(">"), 0
    while at < size:
        low = html.find("<", at)
        if low < 0:
            break
        token = None
        if low < last or html.startswith("<!--", low):
            if open_quotes < _OPEN_QUOTES:
                token = _TOKEN.match(html, low)
            if token is None:
                token = _LOOSE.match(html, low)
                open_quotes += token is not None
        if token is None:  # a plain sign
            lines.add(html[at : low + 1], linked)
            at = low + 1
            continue
        if low > at:
            lines.add(html[at:low], linked)
        at = token.end()
        if not token.lastindex:  # a comment, a doctype
            continue
        tag = token[2].lower()
        if token[1]:
            if tag == "a":
                linked = False
            if tag in _BLOCK:
                lines.end(place())
            if count.get(tag):
                while open_[-1][0] != tag:
                    leave()
                leave()
            continue
        if tag in _RAW:
            if not token[3].endswith("/") or tag in ("script", "style", "textarea", "title"):
                over = re.compile(rf"</{re.escape(tag)}[\s/>]", re.I).search(html, at)
                close = html.find(">", over.start()) if over else -1
                at = close + 1 if close >= 0 else size
            continue
        if tag == "br":
            lines.add(" ", linked)
            continue
        if tag == "a":
            linked = True
            continue
        block = tag in _BLOCK
        if block:
            lines.end(place())
            if count.get("p"):  # a paragraph ends where another block begins
                while open_[-1][0] != "p":
                    leave()
                leave()
            while open_ and tag in _ENDS.get(open_[-1][0], ()):
                leave()
        if tag in _VOID:
            continue
        aside = _beside(tag, token[3], own > 0)
        if tag in _OWN and not aside and not own and beside and all(o[0] == "form" for o in open_ if o[1]):
            # Some pages put all they have into one form.
            for i, o in enumerate(open_):
                open_[i] = (o[0], False, o[2])
            beside = 0
        if block or aside:
            mine = tag in _OWN and not aside and not beside
            open_.append((tag, aside, mine))
            count[tag] = count.get(tag, 0) + 1
            beside += aside
            own += mine
    if at < size:
        lines.add(html[at:], linked)
    lines.end(place())
    return lines


def line_blocks(weights: list[int], window: int = WINDOW, surge: int = SURGE) -> list[tuple[int, int]]:
    """Stretches of lines between a surge and its dive."""
    n = len(weights)
    sums = [0, *accumulate(weights)]
    block = [sums[min(n, i + window)] - sums[i] for i in range(n)]
    if not n or not sums[-1]:
        return []
    least = min(surge, max(block))
    found: list[tuple[int, int]] = []
    start = None
    for i in range(n):
        if start is None:
            if weights[i] and block[i] >= least:
                start = i
        elif not block[i]:
            found.append((start, i))
            start = None
    if start is not None:
        found.append((start, n))
    return found


def main_text(html: str | None) -> str:
    """The main text of one page, its blocks joined by newlines."""
    if not html:
        return ""
    lines = _lines(html)
    marked = any(p == lines.OWN and t for p, t in zip(lines.places, lines.texts))
    worth = lines.OWN if marked else lines.PLAIN
    weights = []
    for text, weight, place in zip(lines.texts, lines.weights, lines.places):
        if place < worth or not text:
            weights.append(0)
        else:
            weights.append(max(weight, SURGE) if marked else weight)
    kept = []
    for low, high in line_blocks(weights):
        kept += [t for t, p in zip(lines.texts[low:high], lines.places[low:high]) if t and p >= worth]
    return "\n".join(kept)


def extract_text(pages: DataFrame, html: str = "html") -> DataFrame:
    """The pages without their html, with ``text`` and ``n_chars``."""
    kept = other_columns(pages, html, *ADDED)
    rows = pages.select(*kept, F.coalesce(F.col(f"`{html}`").cast("string"), F.lit("")).alias(html))
    schema = rows.drop(html).schema.add("text", "string").add("n_chars", "long")

    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            texts = [main_text(h.as_py()) for h in batch.column(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                [*batch.schema.names[:-1], *ADDED],
            )

    return rows.mapInArrow(batches, schema)
