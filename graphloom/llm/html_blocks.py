"""HTML as a sequence of leaf blocks: text, tag path and share of link text."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|</?[a-zA-Z][^>]*\Z", re.DOTALL)
_NAMED = re.compile(r"(class|id|role|data-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.IGNORECASE)
#: Content of these is never text of the page.
RAW = frozenset("script style title noscript template textarea iframe svg".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body br button caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html label legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead tr ul".split()
)
#: An opening tag ends an open element of these names first.
ENDS = {"li": ("li",), "option": ("option",), "td": ("td", "th"), "th": ("td", "th"), "tr": ("tr", "td", "th"), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "body": ("head",)}


class Path:
    """The open block elements around a text, as a chain to the outermost; equal paths of a page are one object."""

    __slots__ = ("parent", "step", "number")

    def __init__(self, parent: Path | None, step: str, number: int) -> None:
        self.parent, self.step, self.number = parent, step, number

    def __iter__(self) -> Iterator[str]:
        """The steps from the outermost."""
        steps, at = [], self
        while at.parent is not None:
            steps.append(at.step)
            at = at.parent
        return reversed(steps)


@dataclass(slots=True)
class Block:
    text: str
    path: Path
    link_chars: int
    label: int | None


@dataclass(slots=True)
class _Open:
    """An open element, with the label and path that hold inside it."""

    tag: str
    label: int | None
    path: Path


def blocks_of(page: str) -> list[Block]:
    """The non-empty leaf blocks of a page in order.  Broken or cut markup is read as far as it goes.

    Time and memory are linear in the page, however deep its elements nest: for each name the places of its open elements
    are kept, and a path is one object more than its parent's.
    """
    found: list[Block] = []
    paths: dict[tuple[int, str], Path] = {}
    root = Path(None, "", 0)
    stack: list[_Open] = []
    open_at: dict[str, list[int]] = {}  # places in the stack by name
    held: list[str] = []
    links = at = 0

    def close_block() -> None:
        nonlocal links
        text = " ".join(html.unescape("".join(held)).split())
        if text:
            found.append(Block(text, stack[-1].path if stack else root, links, stack[-1].label if stack else None))
        held.clear()
        links = 0

    def pop(name: str, barrier: tuple[str, ...] = ()) -> None:
        """Close the innermost element of a name, with all inside it, unless a barrier stands between."""
        places = open_at.get(name)
        if not places or any(open_at.get(b) and open_at[b][-1] > places[-1] for b in barrier):
            return
        depth = places[-1]
        while len(stack) > depth:
            open_at[stack.pop().tag].pop()

    def take(text: str) -> None:
        nonlocal links
        if text:
            held.append(text)
            if open_at.get("a"):
                links += len(text)

    while at < len(page):
        m = _TAG.search(page, at)
        if m is None:
            take(page[at:])
            break
        take(page[at : m.start()])
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            continue
        closing, attributes = bool(m[1] or m[4]), m[3] or m[6] or ""
        if name in BLOCK:
            close_block()
        if closing:
            pop(name)
            continue
        if name in RAW:
            if not attributes.endswith("/"):
                end = re.compile(rf"</{name}[^>]*(?:>|\Z)", re.IGNORECASE).search(page, at)
                at = end.end() if end else len(page)
            continue
        if name in VOID:
            continue
        if name in BLOCK:
            pop("p", ("table", "td", "th", "button")) if name not in ("option", "label", "button") else None
            for other in ENDS.get(name, ()):
                pop(other, ("ul", "ol", "table", "dl", "select"))
        step, label = [name], stack[-1].label if stack else None
        if "=" in attributes:
            for key, *values in _NAMED.findall(attributes):
                value = next(filter(None, values), "")
                if key.lower() == "data-label":
                    label = int(value == "1")
                else:
                    step += [f"{'#' if key.lower() == 'id' else '.'}{word}" for word in value.lower().split()]
        path = stack[-1].path if stack else root
        if name in BLOCK:
            key = (path.number, " ".join(step))
            if key not in paths:
                paths[key] = Path(path, key[1], len(paths) + 1)
            path = paths[key]
        open_at.setdefault(name, []).append(len(stack))
        stack.append(_Open(name, label, path))
    close_block()
    return found
