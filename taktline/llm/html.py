"""Main text of web pages by two passes of block rules.

The page is cut into blocks at block-level tags. Each block has a zone from the elements around it: ``bad`` inside menus,
sidebars, footers, forms, notices, adverts and comments (by element, role or class word), ``main`` inside article or
main, otherwise open. If any block with text is ``main``, open blocks are left out. Class words say nothing on article,
main and body, nor with a modifier (``has-sidebar``, ``comments-open``). Where only a class word made a zone bad, main
opens it again, and so does an article unless the word is of parts that have articles of their own (``OWN_ARTICLES``).

Pass one decides blocks by link density, length and stop-word density: link-dense blocks are bad; long blocks and blocks
rich in stop words are good in ``main``; open blocks have to be both to be good. Pass two gives undecided blocks the
label of their nearest decided neighbours: in ``main`` one good neighbour, or none at all, is enough; open blocks follow
the nearer one, and are bad if both are equally near and differ.

Defined cases: a null or empty html, or one without text, gives an empty text; a null page_id or url is passed on; equal
rows are read alike; unclosed elements end with the element around them; other columns don't matter.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from taktline.llm import chunks as C

LONG = 70  # characters from which length decides
RICH = 0.15  # share of stop words from which density decides
LINKED = 0.5  # share of characters in links from which a block is a menu
LINKED_OPEN = 0.2
# Frequent words of the four languages.
STOP_WORDS = frozenset(
    "the of and to in is it that for on with as was are be by at this an or from not have has he she they but which you we "
    "le la les de des du et un une en que qui dans pour par sur au aux est pas plus avec ce il ne se sont "
    "der die das und ist von zu mit den dem ein eine nicht auf für im des sich als auch es an werden aus er hat "
    "el los las y del se con por una su para al lo como más o pero sus este".split())
# Elements without text of the page; elements around other things than the article; block-level elements.
SKIPPED = frozenset("script style noscript template title svg math iframe object select textarea button canvas audio video".split())
BAD_TAGS = frozenset("nav footer aside form dialog menu fieldset".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th "
    "thead tr ul".split())
CONTAINERS = frozenset("article aside body details dialog div fieldset figure footer form header main menu nav ol section span table ul p li td dl".split())
VOID = frozenset("p li td span".split())  # a zone of theirs ends with the element around them or their own end
BAD_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner cookie cookies consent gdpr notice notices alert comment comments respond reply replies disqus "
    "sidebar menu nav navbar navigation footer breadcrumb breadcrumbs share sharing social related recommended promo promotion sponsor sponsored popup modal "
    "overlay newsletter subscribe subscription signup login widget pagination pager toolbar masthead copyright disclaimer".split())
OWN_ARTICLES = frozenset(
    "ad ads advert adverts advertisement advertising comment comments respond reply replies disqus sidebar related recommended promo promotion sponsor "
    "sponsored widget newsletter".split())
MODIFIERS = (frozenset("has no with without".split()), frozenset("open closed enabled disabled".split()))  # before and behind a word
RAW = frozenset("script style noscript title iframe textarea".split())  # skipped elements that only their own end tag ends
BAD_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())

_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>|<[!?/][^>]*+>""", re.S)
_ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_WORD = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_TRIM = re.compile(r"^\W+|\W+$")
_NAMED = re.compile(r"class|id|role|hidden|style|aria", re.I)


def _words_of(names: str) -> set[str]:
    """Words of class and id names; a name with a modifier has none."""
    out: set[str] = set()
    for name in names.split():
        words = _WORD.findall(_CAMEL.sub(" ", name).lower())
        if len(words) < 2 or words[0] not in MODIFIERS[0] and words[-1] not in MODIFIERS[1]:
            out.update(words)
    return out


def _zone(tag: str, attributes: str, parent: str, cause: str) -> tuple[str, str]:
    """Zone inside an element, and the element that made it: its tag, ``*`` if only a class word of a wrapper did, or
    ``**`` for a class word of ``OWN_ARTICLES``. ``parent``, ``cause``: those around it."""
    named, role, words, hidden = {}, "", set(), False
    if attributes and _NAMED.search(attributes):
        named = {a.lower(): b or c or d for a, b, c, d in _ATTRIBUTE.findall(attributes)}
        role = named.get("role", "").lower()
        words = _words_of(f"{named.get('class', '')} {named.get('id', '')}")
        hidden = "hidden" in named or named.get("aria-hidden") == "true" or "display:none" in named.get("style", "").replace(" ", "").lower()
    main = tag in ("article", "main") or role in ("main", "article")
    made = ""
    if role in BAD_ROLES or hidden and tag != "body":
        made = tag
    elif not main and tag != "body" and words & BAD_WORDS:
        made = "**" if words & OWN_ARTICLES else "*"
    elif not main and "header" in words and parent == "open" and not words & {"article", "post", "entry", "content", "page"}:
        made = "*"
    elif not main and (tag in BAD_TAGS or tag == "header" and parent != "main"):
        made = tag
    if made:
        # The zone around it stays the cause, unless that was a class word and this is more.
        return "bad", made if parent != "bad" or cause == "*" or cause == "**" and made not in ("*", "nav", "header", "footer") else cause
    if main and parent == "bad":
        # An article inside a menu, header or footer means that their end tag is missing.
        opens = cause == "*" or cause == "**" and "main" in (tag, role) or tag in ("article", "main") and cause in ("nav", "header", "footer")
        return ("main", tag) if opens else ("bad", cause)
    return ("main", tag if parent != "main" else cause) if main else (parent, cause)


def _end_of_skipped(page: str, tag: str, at: int) -> int:
    """Where a skipped element that begins before ``at`` ends: behind its end tag, or where the element around it ends."""
    if tag in RAW:
        stop = re.compile(f"</{tag}\\b[^>]*>", re.I).search(page, at)
        return stop.end() if stop else len(page)
    depth, inside = 1, dict.fromkeys(BLOCKS, 0)
    while found := _TOKEN.search(page, at):
        at = found.end()
        end, name, attributes = (found[1], found[2], found[3]) if found[2] else (found[4], found[5], found[6])
        name = name.lower() if name else ""
        if name == tag:
            if end:
                depth -= 1
                if not depth:
                    return at
            elif not attributes.endswith("/"):
                depth += 1
        elif name in RAW and not end and not attributes.endswith("/"):
            at = _end_of_skipped(page, name, at)
        elif name in inside:
            if not end:
                inside[name] += not attributes.endswith("/")
            elif inside[name]:
                inside[name] -= 1
            else:
                return found.start()
    return len(page)


def blocks_of(page: str) -> list[tuple[str, str, int]]:
    """(zone, text, characters in links) of each block with text, in page order."""
    out: list[tuple[str, str, int]] = []
    stack: list[tuple[str, str, str]] = [("", "open", "")]  # element, zone, element that made the zone
    parts: list[str] = []
    linked = 0
    in_link = False
    at = 0

    def close() -> None:
        nonlocal linked
        if parts:
            text = " ".join(unescape("".join(parts)).split())
            if text:
                out.append((stack[-1][1], text, min(linked, len(text))))
            parts.clear()
        linked = 0

    def add(text: str) -> None:
        nonlocal linked
        if text:
            parts.append(text)
            if in_link:
                linked += len(" ".join(unescape(text).split()))

    while found := _TOKEN.search(page, at):
        add(page[at : found.start()])
        at = found.end()
        end, tag, attributes = (found[1], found[2], found[3]) if found[2] else (found[4], found[5], found[6])
        if not tag:
            continue
        tag = tag.lower()
        if tag in SKIPPED:
            if not end and not attributes.endswith("/"):
                at = _end_of_skipped(page, tag, at)
                if tag not in ("svg", "math", "button"):
                    parts.append(" ")
            continue
        if tag in BLOCKS:
            close()
        elif tag == "br":
            parts.append(" ")
        elif tag == "a":
            in_link = not end
        if tag in CONTAINERS:
            if end:
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i][0] == tag:
                        if tag == "span":
                            if stack[i][1] != (stack[i - 1][1]):
                                close()
                        del stack[i:]
                        break
                    if tag in VOID and stack[i][0] not in VOID:
                        break
            else:
                zone, cause = _zone(tag, attributes, stack[-1][1], stack[-1][2])
                if tag in VOID:
                    if tag != "span":  # they close one another
                        while stack[-1][0] == tag:
                            stack.pop()
                        zone, cause = _zone(tag, attributes, stack[-1][1], stack[-1][2])
                    if (zone, cause) == stack[-1][1:] and tag != "span":
                        continue
                    if tag == "span" and zone != stack[-1][1]:
                        close()
                stack.append((tag, zone, cause))
    add(page[at:])
    close()
    return out


def stop_density(text: str) -> float:
    words = text.lower().split()
    return sum(_TRIM.sub("", w) in STOP_WORDS for w in words) / len(words) if words else 0.0


def labels_of(blocks: list[tuple[str, str, int]]) -> list[bool]:
    """Which blocks are main text."""
    has_main = any(zone == "main" for zone, _, _ in blocks)
    first: list[bool | None] = []
    for zone, text, linked in blocks:
        share = linked / len(text)
        if zone == "bad" or zone == "open" and has_main:
            first.append(False)
        elif zone == "main":
            first.append(False if share > LINKED else True if len(text) >= LONG or stop_density(text) >= RICH else None)
        elif share > LINKED_OPEN or "©" in text:
            first.append(False)
        elif len(text) >= LONG:
            first.append(stop_density(text) >= RICH)
        else:
            first.append(None)
    # Nearest decided neighbour on either side; inside ``main`` only neighbours in ``main`` count.
    n = len(blocks)
    before: list[int | None] = [None] * n
    after: list[int | None] = [None] * n
    for order, near in ((range(n), before), (range(n - 1, -1, -1), after)):
        last: int | None = None
        for i in order:
            near[i] = last
            if first[i] is not None and (not has_main or blocks[i][0] == "main"):
                last = i
    out = []
    for i, label in enumerate(first):
        if label is None:
            near = [j for j in (before[i], after[i]) if j is not None]
            if has_main:
                label = not near or any(first[j] for j in near)
            else:
                least = min((abs(i - j) for j in near), default=0)
                label = bool(near) and all(first[j] for j in near if abs(i - j) == least)
        out.append(label)
    return out


def main_text(page: str) -> str:
    """Main text of a page, blocks joined by line feeds."""
    blocks = blocks_of(page)
    return "\n".join(b[1] for b, good in zip(blocks, labels_of(blocks)) if good)


def extract(pages: DataFrame) -> DataFrame:
    """Main text of every row of (page_id, url, html)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x) if x else "" for x in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())],
                names=["page_id", "url", "text", "n_chars"])

    ids = pages.selectExpr("cast(page_id AS long) AS page_id", "cast(url AS string) AS url", "html")
    return ids.mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of all pages."""
    return extract(C.table(spark, sf_dir, "pages"))


QUERIES = {"op6_html_extraction": op6_html_extraction}
ORACLES: dict[str, str] = {}
