"""DOM leaf blocks of a web page: the runs of text between block-level boundaries, with their ancestors."""

from __future__ import annotations

import html
import re
from collections import Counter
from dataclasses import dataclass
from functools import lru_cache

#: Elements whose content isn't text of the page.
SILENT = frozenset("script style template noscript iframe object svg math canvas audio video head title textarea select datalist".split())
#: Elements that don't have an end tag.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that don't end the text around them.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rb rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
#: An open element of the key is ended by the start of one of the values.
ENDED_BY = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "tbody", "tfoot"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"},
    "option": {"option", "optgroup"}, "thead": {"tbody", "tfoot"}, "tbody": {"tbody", "tfoot"},
}
#: Where the search for an element to end stops.
SCOPES = {"li": {"ul", "ol"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "thead": {"table"}, "tbody": {"table"}, "option": {"select"}}

_TOKEN = re.compile(r"""<!--(?s:.*?)(?:-->|\Z)|<[!?][^>]*+>?|<(/?)([A-Za-z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+(?:>|[^>]*+>?))""")
_ATTRIBUTE = re.compile(r"""(?<![\w-])(class|id|role|hidden|style|aria-hidden)\b(?:\s*=\s*(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]++)))?""", re.I)
_NAMES = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_CLOSE: dict[str, re.Pattern] = {t: re.compile(rf"</{t}(?=[\s/>])", re.I) for t in ("script", "style", "textarea", "title", "iframe", "noscript", "template", "svg")}


class Node:
    """An open element. Nodes know their parent, so a path of any depth costs one node."""

    __slots__ = ("tag", "attributes", "parent", "new", "value")

    def __init__(self, tag: str, attributes: str, parent: Node | None, new: list[str]):
        self.tag, self.attributes, self.parent, self.new = tag, attributes, parent, new  # new: features that no ancestor has
        self.value: tuple | None = None

    def up(self):
        """The node and its ancestors."""
        node: Node | None = self
        while node:
            yield node
            node = node.parent


@dataclass
class Block:
    text: str
    node: Node | None  # the element around it
    linked: int  # characters of the raw text inside links
    raw: int  # characters of the raw text


@lru_cache(20_000)
def names(attributes: str) -> tuple[str, ...]:
    """Lower-case words of class, id and role, and `hidden` for an element that isn't shown."""
    out = []
    for m in _ATTRIBUTE.finditer(attributes):
        key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if key in ("class", "id", "role"):
            out += [w.lower() for w in _NAMES.findall(value)]
        elif key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            out.append("hidden")
    return tuple(out)


def blocks(page: str) -> list[Block]:
    """The leaf blocks in page order, without empty ones. Linear in the page, however deep elements nest."""
    out: list[Block] = []
    stack: list[Node] = []
    open_: Counter = Counter()  # tags of the stack
    above: Counter = Counter()  # features of the stack
    parts: list[str] = []
    linked = raw = in_link = silent = at = 0

    def flush() -> None:
        nonlocal parts, linked, raw
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text and not silent:
                out.append(Block(text, stack[-1] if stack else None, linked, raw))
            parts, linked, raw = [], 0, 0

    def push(tag: str, attributes: str) -> None:
        nonlocal silent
        own = {f"in:{tag}", *(f"word:{w}" for w in names(attributes))} if tag not in ("html", "body") else {f"word:{w}" for w in names(attributes) if tag == "body"}
        new = [f for f in sorted(own) if not above[f]]
        above.update(new)
        open_[tag] += 1
        silent += tag in SILENT
        stack.append(Node(tag, attributes, stack[-1] if stack else None, new))

    def pop_to(depth: int) -> None:
        nonlocal silent
        for node in stack[depth:]:
            silent -= node.tag in SILENT
            open_[node.tag] -= 1
            above.subtract(node.new)
        del stack[depth:]

    def last(tag: str, within: set[str] = frozenset()) -> int | None:
        """The place of the innermost open element of a name, unless one of `within` is nearer."""
        if open_[tag]:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i].tag in within:
                    return None
                if stack[i].tag == tag:
                    return i
        return None

    while at < len(page):
        m = _TOKEN.search(page, at)
        text = page[at : m.start()] if m else page[at:]
        if text:
            parts.append(text)
            raw += len(text)
            linked += len(text) * (in_link > 0)
        if not m:
            break
        at = m.end()
        if not m[2]:
            continue
        tag, closing = m[2].lower(), m[1]
        if tag == "br":
            parts.append(" ")
        elif tag in INLINE:
            if tag == "a":
                in_link = 0 if closing else 1
        elif closing:
            flush()
            if (depth := last(tag)) is not None:
                pop_to(depth)
            in_link = 0
        else:
            flush()
            if stack and stack[-1].tag == "p":
                pop_to(len(stack) - 1)
            for name, by in ENDED_BY.items():
                if tag in by and (depth := last(name, SCOPES[name])) is not None:
                    pop_to(depth)
            if tag == "body" and open_["head"]:
                pop_to(next(i for i, n in enumerate(stack) if n.tag == "head"))
            if tag in VOID or m[3].endswith("/>") and tag in ("svg", "path"):
                continue
            if tag in _CLOSE:
                end = _CLOSE[tag].search(page, at)
                at = end.start() if end else len(page)
                if not end:
                    break
            push(tag, m[3])
    flush()
    return out
