"""Leaf blocks of an HTML page: text between block-level tags, with the path of open elements."""

from __future__ import annotations

import html
import re
from dataclasses import dataclass

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?"
    r"|<(?P<end>/?)(?P<tag>[A-Za-z][A-Za-z0-9:-]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>?",
    re.S,
)
NAMED = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
PART = re.compile(r"[A-Za-z]+")

INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea iframe".split())
# Formulas are part of the sentence that they stand in.
MATH = frozenset(
    "math maction annotation merror mfenced menclose mfrac mi mmultiscripts mn mo mover mpadded mphantom mprescripts mroot mrow ms mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover semantics".split()
)
# Elements that may stand inside a sentence, with blocks of their own.
ISLAND = frozenset("noscript template object svg select".split())
# A start tag closes an open element of these kinds, up to the nearest other container.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}


@dataclass
class Leaf:
    path: tuple[str, ...]  # tags as ``t:`` and name parts of class, id and role as ``c:``
    text: str
    linked: int  # characters inside links


def leaves(page: str) -> list[Leaf]:
    """Blocks with text, in page order; character references decoded, white space single.

    Scripts, styles, text areas, frames and comments hold no text; without an end tag, a text area or
    frame is left out itself, and a script or style up to the next tag. Missing and stray end tags are
    tolerated. Blocks inside an object, svg, select, template or noscript come before the block
    that it interrupts.
    """
    found: list[Leaf] = []
    tags: list[str] = []
    labels: list[tuple[str, ...]] = []
    path: tuple[str, ...] = ()
    pieces: list[str] = []
    linked, in_link = 0, False
    held: list[tuple[int, tuple[str, ...], list[str], int, bool]] = []  # blocks interrupted by open islands

    def close_block() -> None:
        nonlocal pieces, linked
        if pieces:
            text = " ".join(html.unescape("".join(pieces)).split())
            if text:
                found.append(Leaf(path, text, linked))
        pieces, linked = [], 0

    def pop_to(depth: int) -> None:
        nonlocal path, pieces, linked, in_link
        while held and held[-1][0] >= depth:
            own, path, pieces, linked, in_link = held.pop()
            if own > depth:
                close_block()
        del tags[depth:], labels[depth:]
        path = tuple(x for label in labels for x in label)

    at, size = 0, len(page)
    while at < size:
        match = TOKEN.search(page, at)
        stop = match.start() if match else size
        if stop > at:
            pieces.append(page[at:stop])
            linked += (stop - at) if in_link else 0
        if not match:
            break
        at = match.end()
        tag = match["tag"]
        if tag is None:
            continue
        tag = tag.lower()
        if match["end"]:
            if tag == "a":
                in_link = False
            elif tag not in INLINE and tag not in MATH and tag in tags:
                close_block()
                in_link = False
                pop_to(len(tags) - 1 - tags[::-1].index(tag))
            continue
        if tag in RAW:
            close = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
            if close:
                at = close.end()
            elif tag in ("script", "style"):
                # Cut off: its own text goes, later tags are read.
                later = TOKEN.search(page, at)
                at = later.start() if later else size
            continue
        if tag in INLINE:
            if tag == "a":
                in_link = True
            elif tag == "br":
                pieces.append(" ")
            continue
        if tag in MATH or (tag == "svg" or "svg" in tags) and match["attrs"].rstrip().endswith("/"):
            continue
        if tag in ISLAND:
            held.append((len(tags), path, pieces, linked, in_link))
            pieces, linked = [], 0
        else:
            close_block()
            in_link = False
        if tag in VOID:
            continue
        if "p" in tags[-1:] and tag not in ISLAND:
            pop_to(len(tags) - 1)
        while tags and tags[-1] in CLOSES.get(tag, ()):
            pop_to(len(tags) - 1)
        names = [next(g for g in m if g) for m in NAMED.findall(match["attrs"]) if any(m)] if match["attrs"] else []
        label = (f"t:{tag}", *(f"c:{p.lower()}" for name in names for p in PART.findall(name)))
        tags.append(tag)
        labels.append(label)
        path = path + label
    close_block()
    pop_to(0)
    close_block()
    return found
