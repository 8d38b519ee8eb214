"""Web pages as leaf blocks: one forward pass over the characters, in time and memory linear in the page.

A leaf block is the text between two borders of block elements. Its ancestry is a node that it shares with its
neighbours: nodes form a tree, and each holds only the features (tags of blocks, words of class, id and role) that its element
adds to those of the elements around it. So a page of a million nested elements has a million small nodes, not their
square.

Tags are found by `str.find`. A quote opens only after "=", a quote without a partner is an ordinary character, a tag
without ">" before the end of the page drops the rest, as in browsers. Where ">" stands only inside quotes, quotes count as ordinary
from there on. Every character is read a bounded number of times.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict
from dataclasses import dataclass

# HTML elements by their role in cutting a page.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section select summary "
    "table tbody td tfoot th thead tr ul".split()
)
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT_TAGS = frozenset("script style template noscript head title textarea svg annotation annotation-xml iframe object".split())
HEAD_TAGS = frozenset("title base basefont bgsound link meta script style template noscript noframes".split())
FOREIGN_TAGS = frozenset(["svg", "math"])
RAW_TAGS = frozenset("script style textarea title iframe".split())
CLOSES = {
    "p": frozenset("address article aside blockquote center details dialog div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()),
    "li": frozenset(["li"]),
    "dt": frozenset(["dt", "dd"]),
    "dd": frozenset(["dt", "dd"]),
    "tr": frozenset(["tr", "tbody", "tfoot"]),
    "td": frozenset(["td", "th", "tr", "tbody"]),
    "th": frozenset(["td", "th", "tr", "tbody"]),
    "option": frozenset(["option", "optgroup"]),
}
# Elements that hold the article, those that never do, and class words of the latter.
MAIN_TAGS = frozenset(["article", "main"])
SIDE_TAGS = frozenset(["nav", "header", "footer", "aside", "form", "menu", "dialog"])
SIDE_WORDS = frozenset("ad ads advert comment comments menu sidebar footer cookie notice banner promo related share".split())

_TAG_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_STOP = re.compile("[>\"']")
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]*)))?""")
_SELF_CLOSED = re.compile(r"(?<!=)(?:^|[\s\"'])/\Z|(?:^|\s)[^\s=\"'/]+/\Z")
_NAME_WORDS = re.compile(r"[a-z]+")
_LONG_REFERENCE = re.compile(r"&#0*([1-9][0-9]{7,});?")
_SPACE = " \t\r\n\f"


class Node:
    """The ancestry of a block: the features that the innermost element adds, and what its ancestors have."""

    __slots__ = ("parent", "added", "leaf", "inside", "sided", "worded")

    def __init__(self, parent: Node | None = None, added: tuple[str, ...] = (), leaf: str = "none", inside: bool = False, sided: bool = False, worded: bool = False) -> None:
        self.parent, self.added, self.leaf = parent, added, leaf
        #: Whether the innermost of the main and side elements around is a main one; whether a side element, a side word is around.
        self.inside, self.sided, self.worded = inside, sided, worded

    def under(self, tag: str, words: tuple[str, ...], added: tuple[str, ...]) -> Node:
        inside = tag in MAIN_TAGS or (self.inside and tag not in SIDE_TAGS)
        return Node(self, added, tag if tag in BLOCK_TAGS else self.leaf, inside, self.sided or tag in SIDE_TAGS, self.worded or not SIDE_WORDS.isdisjoint(words))

    def features(self, most: int) -> list[str]:
        """The features of the element and those around it, innermost first, `most` at most."""
        out: list[str] = []
        node: Node | None = self
        while node is not None and len(out) < most:
            out += node.added
            node = node.parent
        return out[:most]


@dataclass(slots=True)
class Block:
    text: str
    node: Node
    linked: int = 0


def chain(tags: list[str], words: list[str]) -> Node:
    """The ancestry of a block inside `tags`, where the innermost bears `words`."""
    node, tags = Node(), list(dict.fromkeys(tags))
    for tag in tags:
        last = tuple(words) if tag == tags[-1] else ()
        node = node.under(tag, last, (f"in:{tag}", *(f"name:{w}" for w in dict.fromkeys(last))))
    return node


def decoded(text: str) -> str:
    """Character references decoded; numbers beyond all characters give U+FFFD, however many digits they have."""
    return html.unescape(_LONG_REFERENCE.sub("�", text)) if "&" in text else text


class _Cutter:
    """Collects the text of leaf blocks while tags open and close; elements are popped from the top only."""

    def __init__(self) -> None:
        self.tags: list[str] = []
        self.nodes: list[Node] = [Node()]
        self.where: dict[str, list[int]] = defaultdict(list)
        self.block_places: list[int] = []
        self.present: set[str] = set()
        self.silent = 0
        self.blocks: list[Block] = []
        self.parts: list[str] = []
        self.linked = 0

    def text(self, raw: str) -> None:
        if self.tags and self.tags[-1] == "head" and raw.strip():
            self.pop(len(self.tags) - 1)
        if raw and not self.silent:
            self.parts.append(raw)
            if self.where["a"]:
                self.linked += len(raw)

    def flush(self) -> None:
        if self.parts:
            text = " ".join(decoded("".join(self.parts)).split())
            if text:
                self.blocks.append(Block(text, self.nodes[-1], min(self.linked, len(text))))
            self.parts, self.linked = [], 0

    def pop(self, to: int) -> None:
        """Close the elements from place `to` on."""
        while len(self.tags) > to:
            tag, node = self.tags.pop(), self.nodes.pop()
            self.where[tag].pop()
            if tag in BLOCK_TAGS:
                self.block_places.pop()
            if tag in SILENT_TAGS:
                self.silent -= 1
            if node is not self.nodes[-1]:
                self.present.difference_update(node.added)

    def foreign(self) -> bool:
        return bool(self.where["svg"] or self.where["math"])

    def open(self, tag: str, attributes: str) -> bool:
        """Whether the element is open now."""
        if self.tags and self.tags[-1] == "head" and tag not in HEAD_TAGS:
            self.pop(len(self.tags) - 1)
        if tag == "br":
            self.text(" ")
        if tag in BLOCK_TAGS:
            self.flush()
            if self.foreign() and not self.where["foreignobject"] and not self.where["annotation-xml"]:
                self.pop(min(self.where[t][0] for t in FOREIGN_TAGS if self.where[t]))  # HTML ends an open drawing or formula there
            if self.block_places and tag in CLOSES.get(self.tags[self.block_places[-1]], ()):
                self.pop(self.block_places[-1])
        if tag in VOID_TAGS or ((tag in FOREIGN_TAGS or self.foreign()) and _SELF_CLOSED.search(attributes)):
            return False
        words = ()
        if "=" in attributes:
            found = [m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(attributes) if m[1].lower() in ("class", "id", "role")]
            words = tuple(w for value in found for w in _NAME_WORDS.findall(value.lower()))
        wanted = ([f"in:{tag}"] if tag in BLOCK_TAGS else []) + [f"name:{w}" for w in dict.fromkeys(words)]
        added = tuple(f for f in wanted if f not in self.present)
        node = self.nodes[-1]
        if tag in BLOCK_TAGS or added:  # other elements share the ancestry of what they stand in
            node = node.under(tag, words, added)
            self.present.update(added)
        place = len(self.tags)
        self.tags.append(tag)
        self.nodes.append(node)
        self.where[tag].append(place)
        if tag in BLOCK_TAGS:
            self.block_places.append(place)
        if tag in SILENT_TAGS:
            self.silent += 1
        return True

    def close(self, tag: str) -> None:
        if tag in BLOCK_TAGS:
            self.flush()
        places = self.where.get(tag)
        if not places:
            return
        # The end tag of a formatting element does not reach beyond the block that it stands in.
        if tag in BLOCK_TAGS or tag in SILENT_TAGS or not self.block_places or places[-1] > self.block_places[-1]:
            self.pop(places[-1])


class _TagEnds:
    """Where tags end."""

    def __init__(self, page: str) -> None:
        self.page, self.quotes_count = page, True

    def after(self, at: int) -> int:
        """The place of the > that ends the tag whose attributes start at `at`, or -1."""
        page, i = self.page, at
        while self.quotes_count and (m := _STOP.search(page, i)):
            j = m.start()
            if page[j] == ">":
                return j
            k = j - 1
            while k >= at and page[k] in _SPACE:
                k -= 1
            partner = page.find(page[j], j + 1) if k >= at and page[k] == "=" else j
            i = max(partner, j) + 1
        stop = page.find(">", at)
        self.quotes_count = self.quotes_count and stop < 0
        return stop


def leaf_blocks(page: str) -> list[Block]:
    """The page's leaf blocks in order."""
    cutter, ends, at, size = _Cutter(), _TagEnds(page), 0, len(page)
    while (lt := page.find("<", at)) >= 0:
        name = _TAG_NAME.match(page, lt + 1 + page.startswith("/", lt + 1))
        if name is None and page[lt + 1 : lt + 2] not in ("!", "?", "/"):
            cutter.text(page[at : lt + 1])
            at = lt + 1
            continue
        cutter.text(page[at:lt])
        if name is None:
            mark = "-->" if page.startswith("<!--", lt) else ">"
            stop = page.find(mark, lt + 2)
            at = size if stop < 0 else stop + len(mark)
            continue
        stop = ends.after(name.end())
        if stop < 0:
            at = size
            break
        tag, at = name[0].lower(), stop + 1
        if page[lt + 1] == "/":
            cutter.close(tag)
        elif cutter.open(tag, page[name.end() : stop]) and tag in RAW_TAGS:
            end = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(page, at)
            at = end.start() if end else size
    cutter.text(page[at:])
    cutter.flush()
    return cutter.blocks
