"""Main text of web pages by block rules in two passes.

A page is cut into blocks at block-level tags and at doubled line breaks. Scripts, styles, comments, titles and form fields are
never text. The first pass looks at each block alone: what stands in furniture (menus, headers, footers,
sidebars, notices, adverts, forms, comments of readers; by tag, role, class or id) is bad; of the rest, the
density of stop words, the length and the link density tell good blocks from bad ones, and short blocks
without a clear sign stay open. In the second pass an open block takes the label of its nearest decided
neighbours, the nearer one if they differ. Furniture is nobody's neighbour, and where no neighbour is decided, open
blocks are good. Where a page marks its article, only blocks of the article are text and each other's neighbours;
the mark counts as a sign, so that short blocks with stop words, headings and all longer blocks are good at once
and an open block is bad between two bad ones only, but links and notices are bad inside it too. Without a marked article all blocks of the page are judged, and a
heading follows what comes after it. On a page without a marked article and without a block in a language of the
four lists of stop words, length and link density alone decide.

Defined results: null, empty and textless pages give an empty text; character references are decoded as in
HTML 5; white space inside a block becomes one space; blocks are joined in page order by two line ends; an
unfinished tag at the end is not text; repeated rows give equal rows; an empty table gives an empty result;
columns other than those asked for are ignored. Nothing is dropped for its length, and nothing is capped.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

GOOD, BAD, OPEN = "good", "bad", "open"
#: Thresholds of the first pass.
SHORT, LONG = 70, 200
STOP_HIGH, STOP_LOW = 0.32, 0.20
LINKS = 0.33
LINK_LIST = 0.8
HEADING_REACH = 200

_BLOCK = set("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
_VOID = set("area base br col embed hr img input link meta source track wbr".split())
_HEADING = {"h1", "h2", "h3", "h4", "h5", "h6"}
_FURNITURE = {"nav", "footer", "aside", "form", "menu", "dialog", "fieldset", "button", "header"}
_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "alert", "alertdialog", "dialog", "menu", "menubar", "toolbar"}
_NAMES = set(
    "ad ads adv advert adverts advertisement advertising banner sponsor sponsored sponsors promo promos promotion cookie cookies consent gdpr notice notices alert alerts popup popups modal overlay "
    "newsletter subscribe subscription signup sidebar sidebars menu menus nav navbar navigation breadcrumb breadcrumbs footer header masthead comment comments disqus reply replies respond share sharing "
    "social related recommended recommendations widget widgets login search toolbar pagination pager copyright".split()
)
_STOP = set(
    # English, German, French, Spanish.
    "a about after all an and any are as at be because been but by can could did do for from had has have he her his how i if in into is it its more no not of on one or our out she so some than that the their them then there they this to up was we were what when which who will with would you "
    "aber alle als am an auch auf aus bei bin bis das dass dem den der des die doch ein eine einem einen einer er es für hat ich ihr im in ist ja kann man mehr mit nach nicht noch nur ob oder sein sich sie sind so über um und uns unter vom von vor war was wenn werden wie wir wird zu zum zur "
    "au aux avec ce ces cette comme dans de des du elle en est et eux il ils je la le les leur lui mais même ne nous on ou où par pas plus pour que qui sa se ses son sont sur te tout très tu un une vous "
    "al algo como con contra cuando de del desde donde el ella ellos en entre era es esta este ha hay la las le lo los más me mi muy no nos o para pero por porque que se ser si sin sobre son su sus también te tiene todo un una uno y ya yo".split()
)
_RAW = "script|style|noscript|template|title|textarea|select|iframe|svg|math|object|canvas|audio|video"
_TOKEN = re.compile(
    rf"<!--.*?(?:--!?>|\Z)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    rf"|<(?P<raw>{_RAW})\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*+>(?:.*?</(?P=raw)\b[^>]*(?:>|\Z)|.*)"
    r"|<(?P<end>/?)(?P<tag>[a-z][^\s/>]*)(?P<more>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(?P<loose>/?[a-z][^\s/>]*)[^>]*>|</?[a-z][^>]*\Z",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"([^\s=/\"'<>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_WORD = re.compile(r"[^\W\d_]+")
#: How a line about rights begins.
_RIGHTS = re.compile(r"(?:©|\(c\)\s|copyright\b)", re.I)


@dataclass
class Block:
    text: str
    linked: int
    links: int
    heading: bool
    furniture: bool
    article: bool
    label: str = OPEN
    stops: float = field(default=0.0)


def _is_furniture(tag: str, more: str, in_article: bool) -> bool:
    if tag in _FURNITURE:
        return not (tag == "header" and in_article)
    if not more or tag in ("html", "body", "article", "main"):
        return False
    for name, a, b, c in _ATTRIBUTE.findall(more):
        name, value = name.lower(), a or b or c
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            return True
        if name == "role" and value.lower() in _ROLES:
            return True
        if name in ("class", "id") and any(x.lower() in _NAMES - ({"header"} if in_article else set()) for x in _NAME.findall(value)):
            return True
    return False


def blocks(page: str) -> list[Block]:
    """A page's blocks of text in page order."""
    out: list[Block] = []
    stack: list[tuple[str, bool, bool]] = []  # tag, furniture, article; with all that stands around
    parts: list[str] = []
    linked: list[str] = []
    anchors, links, breaks = 0, 0, 0
    heading = False

    def close() -> None:
        nonlocal parts, linked, links, breaks
        text = " ".join(html.unescape("".join(parts)).split())
        if text:
            own = len(" ".join(html.unescape("".join(linked)).split()))
            _, furniture, article = stack[-1] if stack else ("", False, False)
            out.append(Block(text, own, links, heading, furniture, article))
        parts, linked, links, breaks = [], [], 0, 0

    def leave(k: int) -> None:
        nonlocal heading
        close()
        heading = heading and not any(t in _HEADING for t, _, _ in stack[k:])
        del stack[k:]

    def add(text: str) -> None:
        nonlocal breaks
        if text:
            parts.append(text)
            if anchors:
                linked.append(text)
            if breaks and not text.isspace():
                breaks = 0

    at = 0
    for m in _TOKEN.finditer(page):
        add(page[at : m.start()])
        at = m.end()
        if m["cdata"] is not None:
            add(m["cdata"])
            continue
        tag = (m["tag"] or m["loose"] or "").lower()
        ends = bool(m["end"]) or tag.startswith("/")
        tag = tag.lstrip("/")
        if not tag:
            continue
        if tag == "br":
            breaks += 1
            if breaks > 1:
                close()
            else:
                parts.append(" ")
        elif tag == "a":
            anchors = 0 if ends else 1
            links += not ends
        elif tag in _BLOCK or tag == "button":
            if ends:
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] == tag:
                        leave(k)
                        break
                else:
                    close()
                continue
            close()
            # A paragraph ends where another block begins; so do items and cells at their like.
            if stack and (stack[-1][0] == "p" or stack[-1][0] == tag and tag in ("li", "dd", "dt", "td", "th", "tr")):
                leave(len(stack) - 1)
            if tag in _VOID:
                continue
            _, furniture, article = stack[-1] if stack else ("", False, False)
            more = m["more"] or ""
            stack.append((tag, furniture or _is_furniture(tag, more, article), article or tag in ("article", "main")))
            heading = heading or tag in _HEADING
        elif tag in ("td", "th"):
            close()
        else:
            more = m["more"] or ""
            if not ends and more and tag not in _VOID and _is_furniture(tag, more, bool(stack and stack[-1][2])):
                close()
                _, _, article = stack[-1] if stack else ("", False, False)
                stack.append((tag, True, article))
            elif ends and stack and stack[-1][0] == tag:
                leave(len(stack) - 1)
    add(page[at:])
    close()
    return out


def _is_notice(block: Block, words: list[str]) -> bool:
    """A short line about rights, or one that only names furniture, such as a call to share."""
    if len(block.text) >= SHORT or block.heading:
        return False
    return bool(_RIGHTS.match(block.text)) or any(w in _NAMES for w in words) and all(w in _NAMES or w in _STOP for w in words)


def first_pass(block: Block, marked: bool, known: bool = True) -> str:
    """The label of a block by itself. marked: the page marks its article; known: its language has stop words here."""
    if block.furniture or marked and not block.article:
        return BAD
    n, share = len(block.text), block.linked / len(block.text)
    words = _WORD.findall(block.text.lower())
    block.stops = sum(w in _STOP for w in words) / max(1, len(words))
    if _is_notice(block, words):
        return BAD
    if marked:
        if share > LINK_LIST and not block.heading or share > LINKS and block.links > 2 and block.stops < STOP_LOW:
            return BAD
        return GOOD if n >= SHORT or block.stops >= STOP_LOW or block.heading else OPEN
    if share > LINKS:
        return BAD
    if n < SHORT:
        return BAD if block.linked else OPEN
    if not known:  # length and links alone
        return GOOD if n > LONG else BAD if block.linked else OPEN
    if block.stops >= STOP_HIGH:
        return GOOD if n > LONG or not block.linked else OPEN
    return OPEN if block.stops >= STOP_LOW or n > LONG and not block.linked else BAD


def _known(own: list[Block]) -> bool:
    """Whether any block that could be text has the stop words of a text; a page without one is in a language that the lists do not cover."""
    for b in own:
        if not b.furniture and len(b.text) >= SHORT and b.linked <= LINKS * len(b.text):
            words = _WORD.findall(b.text.lower())
            if sum(w in _STOP for w in words) >= STOP_LOW * max(1, len(words)):
                return True
    return False


def classify(own: list[Block]) -> list[Block]:
    """Labels all blocks good or bad."""
    marked = any(b.article and not b.furniture for b in own)
    known = marked or _known(own)
    for b in own:
        b.label = first_pass(b, marked, known)
    # Furniture, and what stands outside a marked article, are nobody's neighbours.
    near = [k for k, b in enumerate(own) if not b.furniture and (b.article or not marked)]
    first = [own[k].label for k in near]
    before: list[tuple[str, int]] = []
    label, reach = "", 0
    for k, x in zip(near, first, strict=True):
        before.append((label, reach))
        label, reach = (x, 0) if x != OPEN else (label, reach + len(own[k].text))
    label, reach = "", 0
    for i in range(len(near) - 1, -1, -1):
        b = own[near[i]]
        after = (label, reach)
        if first[i] == OPEN:
            sides = [s for s in (before[i], after) if s[0]]
            if not sides:
                b.label = GOOD
            elif marked:  # the mark stands against one bad neighbour, not against two
                b.label = BAD if [s[0] for s in sides] == [BAD, BAD] else GOOD
            elif len({s[0] for s in sides}) == 1:
                b.label = sides[0][0]
            elif b.heading:
                b.label = GOOD if after[0] == GOOD and after[1] <= HEADING_REACH else BAD
            else:
                # The nearer side; at the same distance a block with some stop words is good.
                (x, p), (y, q) = before[i], after
                b.label = x if p < q else y if q < p else GOOD if b.stops >= STOP_LOW else BAD
        label, reach = (first[i], 0) if first[i] != OPEN else (label, reach + len(b.text))
    return own


def extract(page: str | None) -> str:
    return "\n\n".join(b.text for b in classify(blocks(page)) if b.label == GOOD) if page else ""


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        pages = batch.column(0)
        for at in range(0, len(pages), 512):
            texts = [extract(x.as_py()) for x in pages.slice(at, 512)]
            yield pa.RecordBatch.from_arrays([batch.column(1).slice(at, 512), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=["row", "text", "n_chars"])


def main_text(pages: DataFrame, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The columns in keep, text and n_chars; one scan, no shuffle."""
    rows = pages.select(F.col(html_col).alias("html"), F.struct(*keep).alias("row"))
    return rows.mapInArrow(_extracted, f"row {rows.schema['row'].dataType.simpleString()}, text string, n_chars long").select("row.*", "text", "n_chars")
