"""Main text of web pages by tag-path ratios.

Each text block hangs at the end of a path of tags from the root. Over a page, the blocks of a path give it two ratios:
text length for each block and punctuation for each block. Their product scores the path. Scores are smoothed over the
tree of elements: a block takes part of the score of what stands in the same container, so that headings and short
paragraphs between long ones stay. Blocks at a fifth of the page's best score or more are its content. Names and roles
of elements are only prior factors of a score: a menu, a form or an aside needs fifty times the ratio of the rest to
count as content. Scripts and other text that no reader sees are no blocks, nor are adverts, consent texts and reader
comments, which no ratio tells from an article.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .wordhash import slices

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose text is not markup, or that no reader sees; all up to their end tag is left out.
_RAW = frozenset("script style textarea title noscript iframe template xmp noembed noframes".split())
_UNSEEN = frozenset("head svg object canvas select button option".split())
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre search section select summary table "
    "tbody td tfoot th thead title tr ul".split()
)
#: Class or id tokens of elements that seldom hold article text: names, with words of place or shape beside them at most.
_OUT = r"ads?|adverts?|advertisements?|advertising|sponsor(?:ed)?|cookies?|consent|comments?|disqus|replies"
_NAME = (
    rf"(?:{_OUT}|banner|promo(?:tion)?|sidebar|notices?|menu|nav(?:bar|igation)?|breadcrumbs?|footer|header|masthead|shar(?:e|ing)|"
    r"social|related|recommended|newsletter|subscribe|signup|login|popup|modal|widget|pagination|pager|copyright|legal|toolbar|hidden)"
)
_PLACE = r"(?:site|page|global|main|primary|secondary|top|bottom|left|right|inner|outer|box|block|bar|area|section|container|wrap(?:per)?|list|items?|links?|buttons?|form|post|text|slot|unit|[0-9]+)"
_NAMES = re.compile(rf"(?:^|\s)(?:{_PLACE}[_-]+)*{_NAME}(?:[_-]+(?:{_NAME}|{_PLACE}))*(?!\S)", re.IGNORECASE)
_OUT_NAMES = re.compile(rf"(?:^|[\s_-])(?:{_OUT})(?![^\s_-])", re.IGNORECASE)
#: Elements around articles: no name of theirs says anything.
_AROUND = frozenset("html body main article".split())
_SELDOM = frozenset("nav header footer aside form dialog menu".split())
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
_LABEL = re.compile(r"(?:^|\s)(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.IGNORECASE)
#: An opening tag that ends these elements, where they are open, up to an element that holds them.
_ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
_KINDS = {"<block>": _BLOCK, "<holder>": frozenset("ul ol dl table".split()), "<fence>": frozenset("td th table article body".split())}
_OUTER = frozenset("table tr tbody thead tfoot article main section div body html".split())
_PUNCTUATION = re.compile(r"[.,;:!?…。，、！？]")
_SPACE = re.compile(r"\s+")
_NAME_AT = re.compile(r"[A-Za-z][^\s/>]*")
_TAG_STOP = re.compile(r">|=\s*([\"'])")
#: References to numbers that are no code points, which may be too long to read, and zeros before a number.
_ZEROS, _HUGE = re.compile(r"&#([xX]?)0{6,}"), re.compile(r"&#(?:[1-9][0-9]{8,}|[xX]0*[1-9a-fA-F][0-9a-fA-F]{8,});?")
#: Prior factors: of elements that seldom hold article text, and of what stands outside an article that holds the best path.
SELDOM, OUTSIDE = 0.02, 0.05
#: What a block takes of the score of its container, and a container of the score of one inside it.
_OF_CONTAINER, _OF_INNER, _OF_INNER_IN_ARTICLE = 0.5, 0.3, 0.7
#: The least score of a page whose blocks all stand in elements that seldom hold article text.
_PROSE = 100.0


class _Element:
    """An open or closed element: its tag path's number, its prior, whether an article or main is around it."""

    __slots__ = ("name", "up", "path", "prior", "inside", "direct", "value", "held", "weak")

    def __init__(self, name, up, path, prior, inside, weak):
        self.name, self.up, self.path, self.prior, self.inside, self.weak = name, up, path, prior, inside, weak
        self.direct = self.value = 0.0
        self.held = 0


def _prior(name: str, labels: str) -> tuple[float, bool]:
    """The prior factor of an element, and whether only a name or a form asks for it, so that an element with most of
    the page's text goes without."""
    if name in _UNSEEN:
        return 0.0, False
    found, weak = (SELDOM, name == "form") if name in _SELDOM else (1.0, False)
    if labels:
        for m in _LABEL.finditer(labels):
            kind, value = m[1].lower(), m[2] or m[3] or m[4] or ""
            if kind == "hidden" or (kind == "aria-hidden" and value == "true"):
                return 0.0, False
            if kind == "role" and value.lower() in _ROLES:
                found, weak = SELDOM, False
            if kind in ("class", "id") and name not in _AROUND and (named := _NAMES.search(value)):
                if _OUT_NAMES.search(named[0]):
                    return 0.0, False
                if found == 1.0:
                    found, weak = SELDOM, True
    return found, weak


def _decoded(parts: list[str]) -> str:
    text = "".join(parts)
    if "&" in text:
        text = html.unescape(_HUGE.sub("\ufffd", _ZEROS.sub(r"&#\g<1>0", text)))
    return _SPACE.sub(" ", text).strip()


def _tag_end(page: str, at: int, lost: set[str]) -> tuple[int, int]:
    """Where the attributes of a tag end and the text after it begins. Quotes that nothing closes are no quotes."""
    k = at
    while m := _TAG_STOP.search(page, k):
        if not m[1]:
            return m.start(), m.end()
        close = -1 if m[1] in lost else page.find(m[1], m.end())
        if close < 0:
            lost.add(m[1])
        k = max(m.end(), close + 1)
    return len(page), len(page)


def blocks(page: str) -> tuple[list[tuple[_Element, str]], list[_Element]]:
    """Text blocks in page order with the innermost block element of each, and all block elements, outer ones first. A
    path is numbered by the path around it, its tag and whether its prior is below 1; references are decoded. The time
    is linear in the page."""
    root = _Element("", None, 0, 1.0, False, False)
    out: list[tuple[_Element, str]] = []
    elements, numbers = [root], {}
    stack: list[tuple[str, _Element]] = [("", root)]
    places: dict[str, list[int]] = defaultdict(list)  # where elements of a name, or of a kind, are on the stack
    text: list[str] = []
    lost: set[str] = set()

    def flush() -> None:
        if text:
            joined = _decoded(text)
            text.clear()
            if joined:
                out.append((stack[-1][1], joined))

    def last(kind: str) -> int:
        return places[kind][-1] if places[kind] else 0

    def close(at: int) -> None:
        if last("<block>") >= at:
            flush()
        for name, _ in stack[at:]:
            places[name].pop()
            for kind, names in _KINDS.items():
                if name in names:
                    places[kind].pop()
        del stack[at:]

    at, n = 0, len(page)
    while at < n:
        begin = page.find("<", at)
        if begin < 0:
            text.append(page[at:])
            break
        if begin > at:
            text.append(page[at:begin])
        sign = page[begin + 1 : begin + 2]
        if sign == "!" or sign == "?":
            comment = page.startswith("<!--", begin)
            end = page.find("-->" if comment else ">", begin + 2)
            at = n if end < 0 else end + (3 if comment else 1)
            continue
        closing = sign == "/"
        m = _NAME_AT.match(page, begin + 1 + closing)
        if not m:
            text.append("<")
            at = begin + 1
            continue
        name = m[0].lower()
        end, at = _tag_end(page, m.end(), lost)
        if closing:
            k = last(name)
            if k and (name in _OUTER or last("<fence>") <= k):
                close(k)
            continue
        if name in ("br", "wbr"):
            text.append(" " if name == "br" else "")
            continue
        if name in _RAW:
            stop = re.compile(rf"</{name}(?=[\s/>])", re.IGNORECASE).search(page, at)
            at = n if stop is None else _tag_end(page, stop.end(), lost)[1]
            continue
        if name in _BLOCK:
            if last("p") and last("<block>") == last("p"):
                close(last("p"))
            if (k := max(map(last, _ENDS.get(name, ())), default=0)) > last("<holder>"):
                close(k)
            flush()
        if name not in _VOID and page[end - 1] != "/":
            up = stack[-1][1]
            prior, weak = _prior(name, page[m.end() : end])
            if name in _BLOCK or prior < 1:
                number = numbers.setdefault((up.path, name, prior < 1), len(numbers) + 1)
                element = _Element(name, up, number, prior, up.inside or name in ("article", "main"), weak)
                elements.append(element)
            else:
                element = up
            places[name].append(len(stack))
            for kind, names in _KINDS.items():
                if name in names:
                    places[kind].append(len(stack))
            stack.append((name, element))
    flush()
    return out, elements


def block_scores(out: list[tuple[_Element, str]], elements: list[_Element]) -> list[float]:
    """The smoothed score of each block, its prior included."""
    sums: dict[int, list[float]] = {}
    for e, text in out:
        e.held += len(text)
    for e in reversed(elements[1:]):
        e.up.held += e.held
    for e in elements[1:]:  # an element's prior times those around it
        own = 1.0 if e.weak and 2 * e.held > elements[0].held else e.prior
        e.prior, e.weak = e.up.prior * own, own < 1
    for e, text in out:
        if e.prior:
            one = sums.setdefault(e.path, [0, 0, 0])
            one[0] += 1
            one[1] += len(text)
            one[2] += len(_PUNCTUATION.findall(text))
    ratio = {path: length / n * (0.1 + marks / n) for path, (n, length, marks) in sums.items()}
    for e, _ in out:
        if e.prior:
            e.direct = max(e.direct, ratio[e.path])
    for e in reversed(elements[1:]):  # what a container holds, best first: its own blocks, theirs around it, inner ones
        e.value = max(e.value, e.direct)
        if not e.weak:
            share = _OF_INNER_IN_ARTICLE if e.up.inside else _OF_INNER
            e.up.value = max(e.up.value, e.direct, share * e.value)
    for e in elements[1:]:
        if e.up.inside and not e.weak:
            e.value = max(e.value, e.up.value)
    raw = [ratio.get(e.path, 0.0) for e, _ in out]
    scores = [e.prior * max(r, _OF_CONTAINER * max(e.value, e.up.value if e.up and not e.weak else 0.0)) for (e, _), r in zip(out, raw, strict=True)]
    if scores:
        best = max(range(len(scores)), key=scores.__getitem__)
        if out[best][0].inside:
            scores = [s if e.inside else OUTSIDE * s for s, (e, _) in zip(scores, out, strict=True)]
    return scores


def main_text(page: str | None, share: float = 0.2) -> str:
    """The page's content blocks joined by newlines: those with at least `share` of the best score. A page whose blocks
    all stand in menus, forms and the like has content only from a score of prose on."""
    out, elements = blocks(page or "")
    scores = block_scores(out, elements)
    best = max(scores, default=0.0)
    if best <= 0 or (best < SELDOM * _PROSE and all(e.prior < 1 for e, _ in out)):
        return ""
    return "\n".join(text for (_, text), s in zip(out, scores, strict=True) if s >= share * best)


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b in slices(batch.column(2)):
            texts = [main_text(x.as_py()) for x in batch.column(2).slice(a, b - a)]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array(texts, pa.string())], ["id", "url", "text"])


def extract_text(pages: DataFrame, id_column: str = "page_id", url_column: str = "url", html_column: str = "html") -> DataFrame:
    """id_column, url_column and text of every page, one row for each input row. Null or empty html: empty text. Ids and
    urls may be null or repeat; the time for a page, however long, is linear in it; an empty table gives an empty result;
    other columns are left out."""
    rows = pages.select(F.col(id_column).alias("id"), F.col(url_column).cast("string").alias("url"), F.col(html_column).cast("string").alias("html"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(_run, f"id {kind}, url string, text string").withColumnsRenamed({"id": id_column, "url": url_column})
