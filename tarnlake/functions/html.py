"""HTML bytes to text (SRC-02, TX-14)."""

from __future__ import annotations

import re
from html.parser import HTMLParser

#: Fixed values.
NOISE = frozenset(("script", "style", "noscript", "template", "iframe", "svg"))
COLLECTED = frozenset(("h1", "h2", "h3", "h4", "p", "li", "blockquote", "pre", "td", "th", "dd", "dt", "figcaption"))
VOID = frozenset(("br", "img", "hr", "meta", "link", "input", "source", "wbr", "area", "base", "col", "embed", "track"))
MOST_BLOCKS = 8000
_CHARSET = re.compile(rb"charset\s*=\s*[\"']?([^\"'>\s]+)", re.I)


def decode(data: bytes) -> str:
    """SRC-02: by mark, by what the first 8192 bytes declare, as UTF-8, or as GB18030 with replacements."""
    if data.startswith(b"\xef\xbb\xbf"):
        return data[3:].decode("utf-8", "replace")
    m = _CHARSET.search(data[:8192])
    for name in ([m[1].decode("ascii", "replace").lower()] if m else []) + ["utf-8"]:
        try:
            return data.decode(name)
        except (LookupError, ValueError):
            continue
    return data.decode("gb18030", "replace")


class _Tree(HTMLParser):
    """Text nodes in order, and elements as ranges of them. An element ends with its own end tag or one of an element around it."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.texts: list[str] = []
        self.elements: list[list] = []  # tag, first text, end of texts, end of elements
        self.open: list[int] = []
        self.noise = 0
        self.held: list[str] = []

    def finish_text(self) -> None:
        if self.held and not self.noise and (text := "".join(self.held).strip()):
            self.texts.append(text)
        self.held.clear()

    def handle_starttag(self, tag: str, attrs) -> None:
        self.finish_text()
        if tag in VOID:
            return
        self.open.append(-1 if self.noise or tag in NOISE else len(self.elements))
        if tag in NOISE:
            self.noise += 1
        if self.open[-1] >= 0:
            self.elements.append([tag, len(self.texts), -1, -1])
        self.names.append(tag)

    def handle_startendtag(self, tag: str, attrs) -> None:
        self.handle_starttag(tag, attrs)
        self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        self.finish_text()
        if tag in self.names:
            while self._leave() != tag:
                pass

    def _leave(self) -> str:
        name, at = self.names.pop(), self.open.pop()
        self.noise -= name in NOISE
        if at >= 0:
            self.elements[at][2:] = len(self.texts), len(self.elements)
        return name

    def handle_data(self, data: str) -> None:
        self.held.append(data)

    def handle_comment(self, data: str) -> None:
        self.finish_text()

    handle_decl = handle_pi = handle_comment

    def unknown_decl(self, data: str) -> None:
        self.finish_text()
        if data.startswith("CDATA["):
            self.held.append(data[6:])
            self.finish_text()

    def read(self, html: str) -> None:
        self.names: list[str] = []
        self.feed(html)
        self.close()
        self.finish_text()
        while self.names:
            self._leave()


def linearise(html: str | None) -> tuple[str, str]:
    """TX-14: (text, title) of a page without noise.

    Of the first main, article or body, else of all, the blocks in order, a line each, headings marked and set apart; the text of
    a block is that of all elements in it, with blanks between them. The plain text stands in if the blocks hold too little of it. A
    page that does not begin with a heading gets its title for one. No block after the ``MOST_BLOCKS``-th is read.
    """
    if not html:
        return "", ""
    t = _Tree()
    t.read(html)
    first = {}
    for k, e in enumerate(t.elements):
        first.setdefault(e[0], k)
    root = next((first[name] for name in ("main", "article", "body") if name in first), None)
    begin, end, after, stop = (0, len(t.texts), 0, len(t.elements)) if root is None else (t.elements[root][1], t.elements[root][2], root + 1, t.elements[root][3])
    title = ""
    if "title" in first:
        _, a, b, last = t.elements[first["title"]]
        title = t.texts[a] if b - a == 1 and last == first["title"] + 1 else ""
    parts = []
    blocks = [e for e in t.elements[after:stop] if e[0] in COLLECTED][:MOST_BLOCKS]
    for tag, a, b, _ in blocks:
        text = " ".join(t.texts[a:b])
        if text:
            parts.append(f"\n{'#' * int(tag[1])} {text}\n" if tag[0] == "h" else text)
    structured, plain = "\n".join(parts).strip(), "\n".join(t.texts[begin:end])
    out = structured if structured and (not plain or len(structured) >= max(120, int(0.22 * len(plain)))) else plain
    return (f"# {title}\n\n{out}" if title and out and not out.lstrip().startswith("#") else out), title
