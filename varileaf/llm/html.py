"""Main text of web pages by two-pass block rules."""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

from varileaf.llm.common import batches, map_arrow

# Frequent words of four languages.
STOP_LISTS = [
    frozenset(line.split())
    for line in """
    a an and are as at be but by for from had has have he her his i in is it its not of on or she that the their they this to was were what which who will with you
    au aux avec ce ces dans de des du elle en est et il ils je la le les leur mais ne nous on ou par pas plus pour qu que qui sa se ses son sont sur un une vous
    als am an auch auf aus bei das dass dem den der des die doch du durch ein eine einen einer er es für hat ich im in ist mit nach nicht noch oder sich sie sind so über um und uns von war was wenn werden wie wir zu zum zur
    al como con de del el ella en entre era es esta este fue ha hay la las le lo los más me muy no nos o para pero por que se sin sobre su sus también un una y ya
    """.strip().splitlines()
]
STOP_WORDS = frozenset().union(*STOP_LISTS)
# Elements by what they do to the text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe template svg math select".split())
FOREIGN = frozenset(("svg", "math"))
BOILER = frozenset("nav footer aside form button dialog menu head object canvas".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
MAIN = frozenset(("article", "main"))
CLOSES = {"li": frozenset(("li",)), "p": frozenset(("p",)), "dt": frozenset(("dt", "dd")), "dd": frozenset(("dt", "dd")), "tr": frozenset(("tr", "td", "th")), "td": frozenset(("td", "th")), "th": frozenset(("td", "th"))}
#: Words in class, id or role that name what isn't the article.
NAMES = frozenset(
    "ad ads adbox advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist cookie cookies consent disclaimer disqus footer gdpr login menu modal nav navbar navigation newsletter notice notices notification pager pagination popup promo promoted promotion related replies reply search share sharing sidebar signup social sponsor sponsored subscribe toolbar widget complementary contentinfo search alert".split()
)
#: First parts of names that tell a state of an element, not what it is.
STATES = frozenset("has is no not with without show hide hidden enable enabled disable disabled use uses layout".split())

#: First pass: characters of a short and a long block, share of stop words that a text and a sure text have, share of linked characters.
SHORT, LONG, LOW_STOP, HIGH_STOP, LINKED = 70, 200, 0.08, 0.15, 0.33
#: A named element that holds more than this share of the page's unlinked text isn't boilerplate for its name.
MOST = 0.5

_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|$)|<[!?][^>]*>?|</(?P<end>[a-zA-Z][^\s/>]*)[^>]*>?|<(?P<start>[a-zA-Z][^\s/>]*)(?P<attributes>(?:=\s*\"[^\"]*(?:\"|$)|=\s*'[^']*(?:'|$)|[^>])*)>?", re.S)
_NAMED = re.compile(r"""(?:^|\s)(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.I)
_HIDDEN = re.compile(r"""(?:^|\s)(?:hidden(?=[\s=/]|$)|aria-hidden\s*=\s*["']?true|style\s*=\s*["'][^"']*display\s*:\s*none)""", re.I)
#: A slash that isn't the end of an unquoted value.
_SLASH = re.compile(r"""(?:^|[\s"'])/\s*$""")
_PART = re.compile(r"[A-Za-z][a-z]*|[A-Z]+")
_LETTERS = re.compile(r"[^\W\d_]+")
_CLOSE = {name: re.compile(rf"</{name}[\s/>]", re.I) for name in RAW}


@dataclass(slots=True)
class Block:
    text: str
    linked: int
    main: bool
    boiler: bool
    heading: bool
    named: tuple[int, ...] = ()
    label: str = ""


def _named(attributes: str) -> bool:
    """Whether a whole class, id or role, or its final part, names what isn't the article; "has-comments", "no-sidebar" and the like say something else."""
    for m in _NAMED.finditer(attributes):
        for name in (m[1] or m[2] or m[3] or "").split():
            parts = [x.lower() for x in _PART.findall(name)]
            if name.lower() in NAMES or parts and parts[-1] in NAMES and parts[0] not in STATES:
                return True
    return False


def blocks(page: str) -> list[Block]:
    """Text blocks in page order. An element that is never closed ends with its parent."""
    out: list[Block] = []
    stack: list[tuple[str, bool, bool, bool, tuple[int, ...]]] = [("", False, False, False, ())]  # name, boiler, main, link, named elements around
    elements = 0
    heading = False
    parts: list[tuple[str, bool]] = []

    def flush() -> None:
        if parts:
            text = " ".join("".join(p for p, _ in parts).split())
            if text:
                linked = len(" ".join("".join(p for p, link in parts if link).split()))
                out.append(Block(text, linked, stack[-1][2], stack[-1][1], heading, stack[-1][4]))
            parts.clear()

    at, n = 0, len(page)
    while at < n:
        m = _TOKEN.search(page, at)
        stop = m.start() if m else n
        if stop > at:
            parts.append((entities.unescape(page[at:stop]), stack[-1][3]))
        if not m:
            break
        at = max(m.end(), stop + 1)
        if name := m["start"]:
            name, attributes = name.lower(), m["attributes"] or ""
            if name in RAW:
                if name in FOREIGN and _SLASH.search(attributes):
                    continue
                close = _CLOSE[name].search(page, at)
                at = n if not close else page.find(">", close.start()) + 1 or n
                continue
            if name == "br" or name == "wbr":
                if name == "br":
                    parts.append((" ", False))
                continue
            if name in BLOCK:
                flush()
                if name in CLOSES or name in BLOCK and stack[-1][0] == "p":
                    closes = CLOSES.get(name, frozenset()) | {"p"}
                    for k in range(len(stack) - 1, 0, -1):
                        if stack[k][0] in closes:
                            del stack[k:]
                            break
                        if stack[k][0] in BLOCK:
                            break
            if name in VOID:  # on other elements a slash before the end says nothing
                continue
            _, boiler, main, link, named = stack[-1]
            main = main or name in MAIN
            boiler = boiler or name in BOILER or name == "header" and not main or name not in ("html", "body") and bool(_HIDDEN.search(attributes))
            if name not in ("html", "body", *MAIN) and _named(attributes):
                elements += 1
                named = (*named, elements)
            stack.append((name, boiler, main, link or name == "a", named))
            heading = name[0] == "h" and name[1:].isdigit() or heading and name not in BLOCK
        elif name := m["end"]:
            name = name.lower()
            if name in BLOCK:
                flush()
                heading = False
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == name:
                    del stack[k:]
                    break
                if name not in BLOCK and stack[k][0] in BLOCK:
                    break
        elif m["cdata"]:
            parts.append((m["cdata"], stack[-1][3]))
    flush()
    return out


def listed(words: list[str]) -> bool:
    """Whether the page's unlinked blocks are in a language whose frequent words are known."""
    return max(sum(w in own for w in words) for own in STOP_LISTS) >= HIGH_STOP * len(words)


def classify(found: list[Block]) -> list[Block]:
    """First pass: bad, good, near or short by length, link density and stop-word density; on a page in a language without a list
    long unlinked blocks are good and others near. Second: near and short ones inherit.

    An undecided block takes the label of its nearest decided neighbours: between two of one kind theirs; between two kinds
    a near one is good, and a short one good only where the nearer side is. Blocks of an article element start as good when not
    linked, blocks of navigation, adverts and the like are bad. A name makes the blocks of its element bad, unless they hold most of the
    page's unlinked text (of its article elements, where it has them).
    """
    body = [b for b in found if not b.boiler and b.linked <= LINKED * len(b.text)]
    body = [b for b in body if b.main] or body
    held: Counter[int] = Counter()
    for b in body:
        for element in b.named:
            held[element] += len(b.text)
    most = MOST * sum(len(b.text) for b in body)
    words = {i: _LETTERS.findall(b.text.lower()) for i, b in enumerate(found) if not (b.boiler or b.main or b.linked > LINKED * len(b.text)) and len(b.text) >= SHORT}
    known = listed([w for own in words.values() for w in own])
    for i, b in enumerate(found):
        density = sum(w in STOP_WORDS for w in words[i]) / max(1, len(words[i])) if i in words else 0.0
        if b.boiler or b.linked > LINKED * len(b.text) or any(held[x] <= most for x in b.named):
            b.label = "bad"
        elif b.main:
            b.label = "good"
        elif len(b.text) < SHORT:
            b.label = "bad" if b.linked else "short"
        elif density >= HIGH_STOP:
            b.label = "good" if len(b.text) > LONG else "near"
        elif density >= LOW_STOP:
            b.label = "near"
        elif not known:
            b.label = "good" if len(b.text) > LONG else "near"
        else:
            b.label = "bad"
    decided = [i for i, b in enumerate(found) if b.label in ("good", "bad")]
    fallback = "good" if not any(found[i].label == "good" for i in decided) else "bad"
    before, k = -1, 0
    labels = []
    for i, b in enumerate(found):
        if k < len(decided) and decided[k] == i:
            before, k = i, k + 1
            labels.append(b.label)
            continue
        after = decided[k] if k < len(decided) else -1
        left = found[before].label if before >= 0 else "bad"
        right = found[after].label if after >= 0 else "bad"
        if left == right:
            label = left if left == "good" else fallback if b.label == "near" else "bad"
        elif b.label == "near" or b.heading and right == "good":
            label = "good"
        else:
            nearer = left if before >= 0 and (after < 0 or i - before < after - i) else right if after >= 0 and (before < 0 or after - i < i - before) else "good"
            label = nearer
        labels.append(label)
    for b, label in zip(found, labels, strict=True):
        b.label = label
    return found


def main_text(page: str | None) -> str:
    """Good blocks joined by one line feed; null and empty pages have none."""
    return "\n".join(b.text for b in classify(blocks(page or "")) if b.label == "good")


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of each page row; repeated rows and null keys stay, an empty table gives none, other columns are left out."""

    def rows(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in batches(frames, "html"):
            texts = [main_text(h) for h in frame.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([frame.column(0), frame.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return map_arrow(pages.select(pages.page_id.cast("long").alias("page_id"), pages.url.cast("string").alias("url"), pages.html.cast("string").alias("html")), rows, "page_id long, url string, text string, n_chars long")
