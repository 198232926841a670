"""Text and metadata of a web page."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

from engram.functions.chunking import SPACE

# What is removed, what holds the content, and tag classes of HTML.
REMOVED_TAGS = {"script", "style", "noscript", "iframe", "nav", "footer", "header", "aside"}
REMOVED_CLASSES = {"footer", "header", "sidebar"}
REMOVED_IDS = {"footer", "header", "sidebar"}
CONTENT_TAGS = {"article", "main"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
INLINE = set("a b big code em font i nobr s small strike strong tt u".split())
CLOSES_PARAGRAPH = set(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre search section "
    "summary table ul dd dt".split()
)
HEAD_ONLY = {"title", "meta", "link", "base", "style", "script", "noscript"}
SAME_LEVEL = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
SCOPE_ENDS = {"html", "table", "td", "th", "caption", "button"}


class Element:
    __slots__ = ("tag", "attrs", "nodes")

    def __init__(self, tag: str, attrs: dict[str, str] | None = None) -> None:
        self.tag, self.attrs, self.nodes = tag, attrs or {}, []

    @property
    def children(self) -> list["Element"]:
        return [n for n in self.nodes if isinstance(n, Element)]

    def text(self) -> str:
        return "".join(n if isinstance(n, str) else n.text() for n in self.nodes)

    def walk(self) -> Iterator["Element"]:
        for child in self.children:
            yield child
            yield from child.walk()


class _Builder(HTMLParser):
    """Builds a tree as browsers do for the usual slips: end tags left out, inline
    tags left open across paragraphs, missing html, head and body tags."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root, self.head, self.body = Element("html"), Element("head"), Element("body")
        self.root.nodes = [self.head, self.body]
        self.open: list[Element] = []
        self.inline: list[Element] = []
        self.in_body = False

    def _place(self) -> Element:
        if self.open:
            return self.open[-1]
        return self.body if self.in_body else self.head

    def _add(self, element: Element) -> None:
        self._place().nodes.append(element)
        if element.tag not in VOID:
            self.open.append(element)

    def _reopen_inline(self) -> None:
        for position, element in enumerate(self.inline):
            if not any(element is e for e in self.open):
                again = Element(element.tag, element.attrs)
                self.inline[position] = again
                self._add(again)

    def _close_to(self, tags: set[str], ends: set[str]) -> bool:
        for position in range(len(self.open) - 1, -1, -1):
            if self.open[position].tag in tags:
                del self.open[position:]
                return True
            if self.open[position].tag in ends:
                return False
        return False

    def handle_starttag(self, tag: str, attrs) -> None:
        if tag in ("html", "head", "body"):
            if tag == "body":
                self.in_body = True
                self.body.attrs.update({k: v or "" for k, v in attrs})
            return
        if not self.in_body and tag not in HEAD_ONLY:
            self.in_body = True
            self.open.clear()
        if tag in CLOSES_PARAGRAPH:
            self._close_to({"p"}, SCOPE_ENDS)
        if tag in HEADINGS and self.open and self.open[-1].tag in HEADINGS:
            self.open.pop()
        if tag in SAME_LEVEL:
            self._close_to(*SAME_LEVEL[tag])
        element = Element(tag, {k: v or "" for k, v in attrs})
        if tag in INLINE:
            if tag == "a":
                self.handle_endtag("a")
            self._reopen_inline()
            self._add(element)
            self.inline.append(element)
        else:
            if self.in_body and tag not in CLOSES_PARAGRAPH and tag not in HEAD_ONLY:
                self._reopen_inline()
            self._add(element)

    def handle_startendtag(self, tag: str, attrs) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        if tag in ("html", "body"):
            return
        if tag == "head":
            self.in_body = True
            self.open.clear()
            return
        if tag in INLINE:
            last = next((e for e in reversed(self.inline) if e.tag == tag), None)
            if last is None:
                return
            self.inline = [e for e in self.inline if e is not last]
            if any(e is last for e in self.open):
                while self.open.pop() is not last:
                    pass
            return
        if tag == "br":
            self.handle_starttag("br", [])
            return
        names = HEADINGS if tag in HEADINGS else {tag}
        if not self._close_to(names, SCOPE_ENDS - {tag}) and tag == "p":
            self._add(Element("p"))
            self.open.pop()

    def handle_data(self, data: str) -> None:
        if not self.open and not self.in_body:
            if not data.strip(SPACE):
                return
            self.in_body = True
        if self.in_body and data.strip(SPACE):
            self._reopen_inline()
        self._place().nodes.append(data)


def parse(html: str) -> Element:
    builder = _Builder()
    builder.feed(html)
    builder.close()
    return builder.root


def _unwanted(e: Element) -> bool:
    return (
        e.tag in REMOVED_TAGS
        or e.attrs.get("id") in REMOVED_IDS
        or not REMOVED_CLASSES.isdisjoint(e.attrs.get("class", "").split())
    )


def _prune(element: Element) -> None:
    element.nodes = [n for n in element.nodes if isinstance(n, str) or not _unwanted(n)]
    for child in element.children:
        _prune(child)


def _metadata(elements: list[Element]) -> dict[str, str]:
    found: dict[str, str] = {}

    def contents(key: str, value: str) -> list[str]:
        metas = (e.attrs for e in elements if e.tag == "meta" and e.attrs.get(key) == value)
        return [a["content"] if "content" in a else None for a in metas]

    title = "".join(e.text() for e in elements if e.tag == "title").strip(SPACE)
    if title:
        found["title"] = title
    description = contents("name", "description")[:1]
    if description and description[0] is not None:
        found["description"] = description[0].strip(SPACE)
    keywords = contents("name", "keywords")[:1]
    listed = (keywords[0] or "").split(",") if keywords else []
    listed += [t for t in contents("property", "article:tag") if t is not None]
    tags = [t.strip(SPACE) for t in listed if t.strip(SPACE)]
    if tags:
        found["tags"] = ",".join(tags)
    author = contents("name", "author")[:1]
    if not author or author[0] is None:
        author = contents("property", "article:author")[:1]
    if author and author[0] and author[0].strip(SPACE):
        found["author"] = author[0].strip(SPACE)
    return found


def _blocks(parents: list[Element]) -> Iterator[str]:
    """Headings, paragraphs and lists as lines; bare text between them is not content."""
    for child in (c for p in parents for c in p.children):
        text = child.text().strip(SPACE)
        if child.tag in HEADINGS:
            yield f"\n\n{'#' * int(child.tag[1])} {text}\n\n"
        elif child.tag == "p":
            yield f"{text}\n\n" if text else ""
        elif child.tag in ("ul", "ol"):
            items = [c for c in child.children if c.tag == "li"]
            for number, item in enumerate(items, 1):
                line = item.text().strip(SPACE)
                mark = "*" if child.tag == "ul" else f"{number}."
                yield f"{mark} {line}\n" if line else ""
            yield "\n"
        elif child.children:
            yield from _blocks([child])
        elif text:
            yield text + ("\n\n" if child.tag in ("div", "section", "article") else " ")


def page_content(html: str) -> tuple[str, dict[str, str]]:
    """Readable text of a page, and its title, description, tags and author."""
    root = parse(html)
    _prune(root)
    elements = list(root.walk())
    content = [
        e for e in elements if e.tag in CONTENT_TAGS or e.attrs.get("role") == "main"
    ] or [e for e in elements if e.tag == "body"]
    return "".join(_blocks(content)).strip(SPACE), _metadata(elements)
