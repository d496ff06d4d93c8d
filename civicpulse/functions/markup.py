"""A small helper that turns one HTML page into an element tree for extraction."""

from __future__ import annotations

import re
from html import unescape
from xml.etree.ElementTree import Element

# Elements without content, those whose content is not markup, and those
# that a new sibling closes.
VOID = frozenset(
    "area base br col embed hr img input link meta param source track wbr".split())
RAW_TEXT = frozenset(("script", "style"))
CLOSED_BY_SIBLING = {
    "p": ("p",), "li": ("li",), "tr": ("tr", "td", "th"), "td": ("td", "th"),
    "th": ("td", "th"), "option": ("option",), "dt": ("dt", "dd"), "dd": ("dt", "dd"),
}
# An open sibling beyond one of these belongs to an outer list or table.
SCOPES = frozenset(("table", "ul", "ol", "dl", "div", "body", "html", "blockquote", "article"))

# A comment or declaration, a tag with its attributes, text, or a stray "<".
PIECE = re.compile(
    r"<!--.*?(?:-->|$)|<[!?][^>]*>"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)>"
    r"|(?P<text>(?:[^<]++|<(?![a-zA-Z/!?]))+|<)", re.S)
RAW_END = re.compile("</(?:script|style)", re.I)
ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")


def _attributes(source: str) -> dict[str, str]:
    found = {}
    for name, double, single, bare in ATTRIBUTE.findall(source):
        found.setdefault(name.lower(), unescape(double or single or bare))
    return found


def _append_text(parent: Element, text: str) -> None:
    if len(parent):
        parent[-1].tail = (parent[-1].tail or "") + text
    else:
        parent.text = (parent.text or "") + text


def parse(html: str) -> Element:
    """Element tree of a page; unclosed and crossed tags are tolerated."""
    root = Element("document")
    stack = [root]
    position = 0
    while piece := PIECE.match(html, position):
        position = piece.end()
        tag = piece["tag"]
        if tag is None:
            if piece["text"]:
                text = piece["text"]
                _append_text(stack[-1], unescape(text) if "&" in text else text)
            continue
        tag = tag.lower()
        if piece["end"]:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    del stack[i:]
                    break
            continue
        closable = CLOSED_BY_SIBLING.get(tag)
        if closable:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in closable:
                    del stack[i:]
                elif stack[i].tag in SCOPES:
                    break
        element = Element(tag, _attributes(piece["attrs"]) if piece["attrs"] else {})
        stack[-1].append(element)
        if tag in RAW_TEXT:
            end = RAW_END.search(html, position)
            stop = end.start() if end else len(html)
            element.text, position = html[position:stop], stop
        elif tag not in VOID:
            stack.append(element)
    return root


def has_class(element: Element, *names: str) -> bool:
    value = element.get("class")
    return value is not None and set(names) <= set(value.split())


def with_class(root: Element, *names: str) -> list[Element]:
    """All descendants that carry every one of the classes."""
    return [e for e in root.iter() if e is not root and has_class(e, *names)]


def own_texts(element: Element) -> list[str]:
    """The text nodes directly inside an element, without those of its children."""
    nodes = [element.text, *(child.tail for child in element)]
    return [n for n in nodes if n]


def first_text(elements: list[Element]) -> str | None:
    """The first direct text node of the first element that has one."""
    return next((n for e in elements for n in own_texts(e)), None)
