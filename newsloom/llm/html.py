"""HTML pages as blocks of visible text, each with its place in the page."""

from __future__ import annotations

import html as entities
import re
from typing import NamedTuple

# Element names of HTML, by how they shape text.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd mark q ruby rt rp s samp small span strike strong sub sup time tt u var wbr label input button select option".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html "
    "legend li link main menu meta nav noscript object ol optgroup p pre section source summary svg table tbody td template textarea tfoot th thead title tr ul video audio iframe picture".split()
)
RAW = frozenset(("script", "style", "template", "svg", "textarea", "iframe", "object"))
VOID = frozenset("br hr img input link meta source wbr area base col embed param track".split())
FURNITURE = frozenset("header footer nav aside figure figcaption form ul ol li dl menu select button h1 h2 h3 h4 h5 h6 noscript head title caption th label dialog".split())
_CLOSES = {"p": frozenset(("p",)), "li": frozenset(("li", "p")), "td": frozenset(("td", "th", "p")), "th": frozenset(("td", "th", "p")), "tr": frozenset(("tr", "td", "th", "p")), "dt": frozenset(("dt", "dd")), "dd": frozenset(("dt", "dd"))}
_KNOWN = INLINE | BLOCK | RAW | VOID
_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[|<![a-zA-Z][^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9]*)((?:\s+[^<>\s=]+(?:\s*=\s*(?:\"[^\"]*\"|'[^']*'|[^\s>]*))?|\s*/)*\s*)>", re.S)
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden|(?:^|\s)hidden(?:\s|=|$)|aria-hidden\s*=\s*[\"']?true", re.I)
_SPACE = re.compile(r"\s+")


class Block(NamedTuple):
    text: str  # as shown: tags dropped, references resolved, space collapsed
    tag: str  # of the nearest block element
    inside: frozenset  # furniture elements around it
    hidden: bool
    linked: float  # share of its characters inside links
    parents: tuple  # numbers of the elements around it, outermost first
    element: int  # number of its own element
    cls: str  # class of its own element


def _class(attributes: str) -> str:
    m = re.search(r"class\s*=\s*[\"']?([^\"'>]*)", attributes)
    return m.group(1).strip() if m else ""


def blocks(page: str) -> list[Block]:
    """The text blocks of a page in order. Broken markup gives the blocks that can be read."""
    return tree(page)[0]


def tree(page: str) -> tuple[list[Block], list[str]]:
    """The text blocks of a page in order, and the name and class of each element by its number."""
    found: list[Block] = []
    elements = [""]
    stack: list[tuple] = [("", 0, frozenset(), False, "")]  # name, number, furniture, hidden, class
    parts: list[str] = []
    numbers, link, in_link, breaks, at = 0, 0, 0, 0, 0

    def flush() -> None:
        nonlocal parts, link
        if parts:
            text = _SPACE.sub(" ", entities.unescape("".join(parts))).strip()
            if text:
                name, number, inside, hidden, cls = stack[-1]
                found.append(Block(text, name, inside, hidden, min(1.0, link / len(text)), tuple(s[1] for s in stack[:-1]), number, cls))
        parts, link = [], 0

    def said(text: str) -> None:
        nonlocal link, breaks
        if text:
            parts.append(text)
            if not text.isspace():
                breaks = 0
            if in_link:
                link += len(text)

    raw = ""
    for m in _TOKEN.finditer(page):
        name = (m.group(2) or "").lower()
        if raw:
            if m.group(1) and name == raw:
                raw, at = "", m.end()
            continue
        if name and name not in _KNOWN:
            continue  # not a tag: it stays as text
        said(page[at : m.start()])
        at = m.end()
        if not name:
            continue
        if name == "br":
            breaks += 1
            if breaks >= 2:
                flush()
            else:
                parts.append(" ")
        elif name in INLINE:
            if name == "a":
                in_link = max(0, in_link + (-1 if m.group(1) else 1))
        elif m.group(1):
            if any(s[0] == name for s in stack):
                flush()
                while stack[-1][0] != name:
                    stack.pop()
                stack.pop()
            in_link = 0
        elif name in RAW:
            raw = name
        elif name not in VOID:
            flush()
            in_link, breaks = 0, 0
            ends = _CLOSES.get(name)
            while ends and stack[-1][0] in ends:
                stack.pop()
            if stack[-1][0] == "p":
                stack.pop()
            numbers += 1
            _, _, inside, hidden, _ = stack[-1]
            attributes = m.group(3)
            cls = _class(attributes) if attributes else ""
            elements.append(f"{name}.{cls}")
            stack.append((name, numbers, inside | {name} if name in FURNITURE else inside, hidden or bool(attributes and _HIDDEN.search(attributes)), cls))
        else:
            flush()
    if not raw:
        said(page[at:])
    flush()
    return found, elements


def container(found: list[Block], widen: bool = True) -> set[int] | None:
    """Numbers of the blocks (by position) inside the element that holds the page's main heading; None without one.

    widen: where that element has no running text, the one around it is taken, then all that follows.
    """
    heads = [i for i, b in enumerate(found) if b.tag == "h1" and not b.hidden]
    if not heads:
        return None
    best: set[int] = set()
    for i in heads:
        around = found[i].parents
        for depth in (len(around) - 1, len(around) - 2)[: 2 if widen else 1]:
            if depth < 1:
                break
            home = around[depth]
            held = {k for k, b in enumerate(found) if k > i and (home in b.parents or b.element == home)}
            if not widen or any(prose(found[k]) for k in held):
                best |= held
                break
    if not best and widen:  # the heading stands alone: what follows it
        best = {k for k in range(heads[0] + 1, len(found))}
    return best


_ENDED = re.compile(r"[.!?।۔؟…][\"'”’»)\]]*$")


def prose(b: Block) -> bool:
    """Whether a block is shown, is no furniture by its element, and reads as ended sentences."""
    return not b.hidden and not b.inside and b.linked < 0.6 and b.text.count(" ") >= 2 and bool(_ENDED.search(b.text))


def article(found: list[Block], widen: bool = True) -> list[int]:
    """Positions of the blocks that stand where the article stands, prose or not."""
    held = container(found, widen)
    if held is None:
        teasers = {b.parents[-1] for b in found if b.tag in ("h2", "h3", "h4", "h5", "h6") and b.parents}
        inner = {b.element for b in found if b.tag == "body"} | {1, 2, 0}
        held = {k for k, b in enumerate(found) if not (b.parents and b.parents[-1] in teasers - inner)}
    return sorted(k for k in held if not found[k].hidden and not (found[k].inside - {"h1"}))
