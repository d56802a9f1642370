"""Small page parser behind the extraction UDFs.

Builds the tree a lenient parser without implied end tags builds: an end tag
closes up to the nearest open tag of its name and is ignored if there is none,
void elements take no children, comments and the doctype are kept as text that
is not shown.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from html import unescape
from html.parser import HTMLParser

# --- fixed values -----------------------------------------------------------
VOID_TAGS = frozenset(
    "area base br col embed hr img input keygen link menuitem meta param source track wbr "
    "basefont bgsound command frame image isindex nextid spacer".split()
)
# Text inside these is not part of the shown text of an enclosing element.
HIDDEN_TEXT_TAGS = frozenset("script style template rt rp".split())
PRESERVING_TAGS = frozenset("pre textarea".split())
CLEANED_TAGS = frozenset("script style nav footer header noscript".split())
SKIPPED_TAGS = frozenset("script style nav footer header meta link noscript svg img".split())
INLINE_TAGS = frozenset("span a code em strong b i pre".split())
HEADING_TAGS = frozenset("h1 h2 h3 h4 h5 h6".split())
# Extracted text that is nothing but one of these is noise.
NOISE_TEXT = frozenset(["#", ",", ".", "(", ")", "[", "]", ";", ":", "*", "&", "–", "-", ""])
# ----------------------------------------------------------------------------


class Text:
    __slots__ = ("data", "shown")

    def __init__(self, data: str, shown: bool):
        self.data = data
        self.shown = shown


class Element:
    __slots__ = ("name", "attrs", "parent", "children")

    def __init__(self, name: str, attrs: dict[str, str], parent: Element | None):
        self.name = name
        self.attrs = attrs
        self.parent = parent
        self.children: list[Element | Text] = []

    def has_class(self, token: str) -> bool:
        return token in self.attrs.get("class", "").split()

    def ancestor(self, *names: str) -> Element | None:
        node = self.parent
        while node is not None and node.name not in names:
            node = node.parent
        return node

    def _descendants(self) -> Iterator[Element | Text]:
        stack = [iter(self.children)]
        while stack:
            node = next(stack[-1], None)
            if node is None:
                stack.pop()
                continue
            yield node
            if isinstance(node, Element):
                stack.append(iter(node.children))

    def elements(self) -> Iterator[Element]:
        return (n for n in self._descendants() if isinstance(n, Element))

    def first(self, test: Callable[[Element], bool]) -> Element | None:
        return next((e for e in self.elements() if test(e)), None)

    def text(self) -> str:
        return "".join(n.data for n in self._descendants() if isinstance(n, Text) and n.shown)

    def stripped_text(self, separator: str) -> str:
        pieces = (n.data.strip() for n in self._descendants() if isinstance(n, Text) and n.shown)
        return separator.join(p for p in pieces if p)


#: ("open" | "leaf" | "close" | "text" | "aside" | "section", tag name or text, attributes)
Token = tuple[str, str, dict[str, str]]


class _Tokens(HTMLParser):
    """What a page consists of, in order. References are read as the standard says; unknown ones lose their semicolon."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=False)
        self.found: list[Token] = []

    def _tag(self, kind: str, name: str, attrs: list[tuple[str, str | None]]) -> None:
        self.found.append((kind, name, {key: value or "" for key, value in attrs}))

    def handle_starttag(self, tag, attrs):
        self._tag("leaf" if tag in VOID_TAGS else "open", tag, attrs)

    def handle_startendtag(self, tag, attrs):
        self._tag("leaf", tag, attrs)

    def handle_endtag(self, tag):
        self._tag("close", tag, [])

    def handle_data(self, data):
        self._tag("text", data, [])

    def handle_entityref(self, name):
        known = unescape(f"&{name};")
        self._tag("text", known.removesuffix(";") if known.startswith("&" + name) else known, [])

    def handle_charref(self, name):
        self._tag("text", unescape(f"&#{name};"), [])

    def handle_comment(self, data):
        self._tag("aside", data, [])

    handle_pi = handle_comment

    def handle_decl(self, decl):
        self._tag("aside", decl.partition(" ")[2], [])

    def unknown_decl(self, data):
        marked, _, rest = data.partition("[")
        self._tag(*(("section", rest) if marked.upper() == "CDATA" else ("aside", data)), [])


def _tokens(page: str) -> list[Token]:
    parser = _Tokens()
    parser.feed(page)
    parser.close()
    return parser.found


def _text(data: str, inside: Counter[str]) -> Text:
    """A text node: white space alone counts as one sign, but where it is preserved."""
    blank = not data.strip(" \t\n\r\f\v") and not any(inside[t] for t in PRESERVING_TAGS)
    return Text(("\n" if "\n" in data else " ") if blank else data, not any(inside[t] for t in HIDDEN_TEXT_TAGS))


def _tree(tokens: Iterable[Token]) -> Element:
    """Tokens on a stack of open elements; every token but text ends the text before it."""
    path = [Element("", {}, None)]
    inside: Counter[str] = Counter()
    pending = ""
    for kind, value, attrs in [*tokens, ("aside", "", {})]:
        if kind == "text":
            pending += value
            continue
        if pending:
            path[-1].children.append(_text(pending, inside))
            pending = ""
        if kind in ("open", "leaf"):
            node = Element(value, attrs, path[-1])
            path[-1].children.append(node)
            if kind == "open":
                path.append(node)
                inside[value] += 1
        elif kind == "close":
            while inside[value]:  # nothing to do if no such element is open
                name = path.pop().name
                inside[name] -= 1
                if name == value:
                    break
        else:
            path[-1].children.append(Text(value, kind == "section"))
    return path[0]


def parse(html: str) -> Element:
    return _tree(_tokens(html))


def links(root: Element) -> Iterator[Element]:
    return (e for e in root.elements() if e.name == "a" and "href" in e.attrs)


def clean(root: Element) -> None:
    """Drop page furniture and elements hidden by their style."""

    def dropped(node: Element | Text) -> bool:
        return isinstance(node, Element) and (
            node.name in CLEANED_TAGS or "display:none" in node.attrs.get("style", "").replace(" ", "")
        )

    stack = [root]
    while stack:
        node = stack.pop()
        node.children = [c for c in node.children if not dropped(c)]
        stack.extend(c for c in node.children if isinstance(c, Element))


def main_content(root: Element) -> Element:
    return (
        root.first(lambda e: e.name == "main")
        or root.first(lambda e: e.attrs.get("id") == "main-content")
        or root.first(lambda e: e.has_class("main-content"))
        or root
    )


def find_section(root: Element, wanted: str) -> Element | None:
    """Block around the element with that id, else around the first heading with that text."""
    node = root.first(lambda e: e.attrs.get("id") == wanted)
    if node is not None:
        return node.ancestor("section", "div", "dl") or node
    node = root.first(lambda e: e.name in HEADING_TAGS and wanted.lower() in e.text().lower())
    if node is not None:
        return node.ancestor("section", "div") or node
    return None


def brace_tree(root: Element) -> str:
    """Text of an element with nested blocks in braces.

    Children are finished before their parent, on an explicit stack, so that
    deep nesting does not meet the recursion limit.
    """
    results: dict[int, str] = {}
    stack = [(root, False)]
    while stack:
        node, finished = stack.pop()
        if node.name in SKIPPED_TAGS:
            results[id(node)] = ""
        elif node.name in INLINE_TAGS:
            text = node.stripped_text(" ")
            results[id(node)] = "" if text in NOISE_TEXT else text
        elif not finished:
            stack.append((node, True))
            stack.extend((c, False) for c in node.children if isinstance(c, Element))
        else:
            pieces = [c.data.strip() for c in node.children if isinstance(c, Text)]
            direct = " ".join(p for p in pieces if p)
            if direct in NOISE_TEXT:
                direct = ""
            blocks = [results.pop(id(c)) for c in node.children if isinstance(c, Element)]
            blocks = [b for b in blocks if b.strip() not in NOISE_TEXT]
            if not blocks:
                results[id(node)] = direct
            elif len(blocks) == 1 and not direct:
                results[id(node)] = blocks[0]
            else:
                body = "{\n" + "\n".join(blocks) + "\n}"
                results[id(node)] = f"{direct} {body}" if direct else body
    return results[id(root)]
