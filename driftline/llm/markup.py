"""Clean text out of HTML, Markdown, wiki and LaTeX markup, with its structure.

A text's markup is told from its signs, then parsed into one kind of tree:
headings, paragraphs, list items, code blocks, formulas, quotes, tables. The
main content of the tree is found by scoring: a block of text gives points for
its length and its commas to its container and half of them to the next, every
container's points are discounted by the share of its text that stands in
links, and the best container is kept together with those siblings, on every
level above it, whose discounted points show any text of their own. In flat
markup the sections that headings open are containers.
Parsing needs a stack and look-ahead, so it runs in Python, over Arrow batches;
every text is parsed by itself.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterable, Iterator
from html.parser import HTMLParser

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.runtime import col

HEADING, ITEM, CODE, FORMULA = "heading", "list_item", "code_block", "formula"
_INLINE = "a|abbr|b|big|br|cite|code|del|dfn|em|font|i|img|ins|kbd|mark|q|s|samp|small|span|strike|strong|sub|sup|tt|u|var|wbr|nobr|center"
_BLOCK = "address|article|aside|blockquote|body|caption|dd|details|div|dl|dt|fieldset|figure|footer|form|h[1-6]|head|header|hr|html|li|main|nav|ol|p|pre|script|section|style|summary|table|tbody|td|tfoot|th|thead|tr|ul"
TAG = re.compile(rf"</?(?:{_INLINE}|{_BLOCK})(?:\s[^<>]*)?/?>", re.I)
INLINE_TAG = re.compile(rf"</?(?:{_INLINE})(?:\s[^<>]*)?/?>", re.I)
BLOCK_TAG = re.compile(rf"</?(?:{_BLOCK})(?:\s[^<>]*)?/?>", re.I)
COMMENT = re.compile(r"<!--.*?(?:-->|\Z)", re.S)
MATH = re.compile(r"\\\((.+?)\\\)|\\\[(.+?)\\\]|\$\$(.+?)\$\$|(?<![\\$\w])\$(?=[^\s$])((?:[^$\\\n]|\\.)+?)(?<=\S)\$(?![\w$])", re.S)


class Node:
    """kind: root, block (container), p, heading, list, item, code, formula, quote, table, skip."""

    __slots__ = ("kind", "text", "link", "children", "score")

    def __init__(self, kind: str, text: str = "", link: int = 0) -> None:
        self.kind, self.text, self.link, self.children, self.score = kind, text, link, [], 0.0

    def add(self, node: Node) -> Node:
        self.children.append(node)
        return node


def squeeze(text: str) -> str:
    """Runs of white space (no-break blanks too) become one blank, ends trimmed."""
    return " ".join(text.replace("\u200b", "").split())


# ---------------------------------------------------------------- HTML


class _Html(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Node("root")
        self.stack: list[tuple[str, Node]] = [("", self.root)]
        self.a = 0
        self.mute = 0

    def _close(self, tags: tuple[str, ...], within: tuple[str, ...] = ()) -> None:
        """Ends the nearest open element of ``tags``, unless one of ``within`` is nearer."""
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i][0] in tags:
                del self.stack[i:]
                return
            if self.stack[i][0] in within:
                return

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in ("script", "style"):
            self.mute += 1
            return
        if tag == "a":
            self.a += 1
            return
        if tag == "br":
            self.handle_data("\n")
            return
        kind = None
        if re.fullmatch(r"h[1-6]", tag):
            kind = "heading"
        elif tag in ("ul", "ol", "dl"):
            kind = "list"
        elif tag in ("li", "dd", "dt"):
            self._close(("li", "dd", "dt"), ("ul", "ol", "dl"))
            kind = "item" if tag == "li" else "p"
        elif tag == "pre":
            kind = "code"
        elif tag in ("blockquote", "q") and tag == "blockquote":
            kind = "quote"
        elif tag == "table":
            kind = "table"
        elif tag in ("p", "div", "section", "article", "main", "aside", "nav", "header", "footer", "details", "summary", "figure", "form", "body", "html", "tr", "td", "th"):
            kind = "p" if tag == "p" else "block"
        if kind in ("heading", "list", "code", "quote", "table", "block", "p"):
            self._close(("p",), ("li", "td", "blockquote", "div"))
            if kind != "list" or self.stack[-1][0] not in ("li",):
                while re.fullmatch(r"h[1-6]", self.stack[-1][0]):
                    self.stack.pop()
        if kind:
            self.stack.append((tag, self.stack[-1][1].add(Node(kind))))

    def handle_endtag(self, tag: str) -> None:
        if tag in ("script", "style"):
            self.mute = max(0, self.mute - 1)
        elif tag == "a":
            self.a = max(0, self.a - 1)
        elif any(t == tag for t, _ in self.stack):
            self._close((tag,))

    def handle_data(self, data: str) -> None:
        if self.mute:
            return
        at = self.stack[-1][1]
        at.add(Node("text", data, len(data.strip()) if self.a else 0))


def _own_text(node: Node) -> str:
    """Text of a node without nested lists, code, quotes and tables."""
    return "".join(c.text if c.kind == "text" else _own_text(c) if c.kind in ("block", "p") else " " for c in node.children)


def _settle(node: Node) -> None:
    """Turns the text children of an HTML tree into the nodes' own text and formulas."""
    if node.kind in ("heading", "item", "code", "p"):
        node.text = _own_text(node) if node.kind != "code" else "".join(_all_text(node))
        node.link = sum(c.link for c in node.children)
    kept = []
    loose: list[Node] = []

    def flush() -> None:
        if any(c.text.strip() for c in loose):
            kept.append(Node("p", "".join(c.text for c in loose), sum(c.link for c in loose)))
        loose.clear()

    for c in node.children:
        if c.kind == "text":
            if node.kind in ("root", "block", "quote", "table", "list"):
                loose.append(c)
        else:
            flush()
            _settle(c)
            kept.append(c)
    flush()
    node.children = kept
    if node.kind in ("p", "item", "heading"):
        node.children += [Node("formula", next(g for g in m.groups() if g)) for m in re.finditer(r"\\\((.+?)\\\)|\\\[(.+?)\\\]|\$\$(.+?)\$\$", node.text, re.S)]


def _all_text(node: Node) -> Iterator[str]:
    yield node.text if node.kind == "text" else ""
    for c in node.children:
        yield from _all_text(c)


def parse_html(text: str) -> Node:
    parser = _Html()
    parser.feed(COMMENT.sub(" ", text))
    parser.close()
    _settle(parser.root)
    return parser.root


# ---------------------------------------------------------------- inline marks

_KEEP = "\x00"


def _hold(held: list[str], text: str) -> str:
    held.append(text)
    return f"{_KEEP}{len(held) - 1}{_KEEP}"


def _release(held: list[str], text: str) -> str:
    while _KEEP in text:
        text = re.sub(f"{_KEEP}(\\d+){_KEEP}", lambda m: held[int(m[1])], text)
    return text


def clean_markdown(text: str) -> tuple[str, int]:
    """(text without inline marks, characters of link labels)."""
    held: list[str] = []
    links = 0
    text = text.replace(_KEEP, "")
    text = re.sub(r"(?<!`)(`+)(?!`)(.+?)(?<!`)\1(?!`)", lambda m: _hold(held, m[2]), text, flags=re.S)
    text = MATH.sub(lambda m: _hold(held, next(g for g in m.groups() if g)), text)
    text = re.sub(r"\\([!-/:-@\[-`{-~])", lambda m: _hold(held, m[1]), text)
    text = re.sub(r"!\[([^\]]*)\]\([^)\s]*(?:\s+\"[^\"]*\")?\)", r"\1", text)

    def label(m: re.Match) -> str:
        nonlocal links
        links += len(m[1])
        return m[1]

    text = re.sub(r"\[((?:[^\[\]]|\[[^\]]*\])+)\]\(\s*<?[^)\s]*>?(?:\s+(?:\"[^\"]*\"|'[^']*'))?\s*\)", label, text)
    text = re.sub(r"\[\^[^\]]+\]", "", text)
    text = re.sub(r"\[([^\[\]]+)\]\[[^\]]*\]", label, text)
    text = re.sub(r"<((?:https?://|mailto:)[^\s<>]+)>", lambda m: _hold(held, m[1]), text)
    text = re.sub(r"<br\s*/?>", " ", text, flags=re.I)
    text = INLINE_TAG.sub("", text)
    for _ in range(3):
        text = re.sub(r"(?<![\\*])(\*{1,3})(?=[^\s*])(.+?)(?<=[^\s*])\1(?!\*)", r"\2", text, flags=re.S)
        text = re.sub(r"(?<![\w\\])(_{1,3})(?=[^\s_])(.+?)(?<=[^\s_])\1(?!\w)", r"\2", text, flags=re.S)
    text = re.sub(r"~~(?=\S)(.+?)(?<=\S)~~", r"\1", text, flags=re.S)
    return _release(held, html.unescape(text)), links


def clean_wiki(text: str) -> tuple[str, int]:
    held: list[str] = []
    links = 0
    text = text.replace(_KEEP, "")
    text = re.sub(r"<nowiki>(.*?)</nowiki>", lambda m: _hold(held, m[1]), text, flags=re.S | re.I)
    text = re.sub(r"<math[^>]*>(.*?)</math>", lambda m: _hold(held, m[1]), text, flags=re.S | re.I)
    text = re.sub(r"<ref[^>/]*/>|<ref[^>]*>.*?</ref>", "", text, flags=re.S | re.I)
    text = re.sub(r"\{\{[^{}]*\}\}", "", text)

    def label(m: re.Match) -> str:
        nonlocal links
        links += len(m[1])
        return m[1]

    text = re.sub(r"\[\[(?:[^\[\]|]*\|)?([^\[\]|]*)\]\]", label, text)
    text = re.sub(r"\[(?:https?:|ftp:)?//\S+\s+([^\]]*)\]", label, text)
    text = re.sub(r"\[(?:https?:|ftp:)?//\S+\]", "", text)
    text = re.sub(r"<br\s*/?>", " ", text, flags=re.I)
    text = INLINE_TAG.sub("", text)
    text = re.sub(r"'{2,5}", "", text)
    return _release(held, html.unescape(text)), links


_ARG = r"\{((?:[^{}]|\{(?:[^{}]|\{[^{}]*\})*\})*)\}"
_ESCAPED = re.compile(r"\\([_&%#${}])")


def clean_latex(text: str) -> tuple[str, int]:
    held: list[str] = []
    links = 0
    text = text.replace(_KEEP, "")
    text = re.sub(r"\\verb\*?([^\w\s])(.*?)\1", lambda m: _hold(held, m[2]), text)
    text = re.sub(r"\\\\(?:\[[^\]]*\])?", " ", text)
    text = MATH.sub(lambda m: _hold(held, next(g for g in m.groups() if g)), text)
    text = re.sub(rf"\\(?:label|cite[tp]?|ref|eqref|pageref|footnote|index|vspace|hspace)\*?(?:\[[^\]]*\])?{_ARG}", "", text)

    def label(m: re.Match) -> str:
        nonlocal links
        links += len(m[2])
        return m[2]

    for _ in range(6):
        before = text
        text = re.sub(rf"\\href{_ARG}{_ARG}", label, text)
        text = re.sub(rf"\\(?:url|path|nolinkurl){_ARG}", lambda m: _hold(held, _ESCAPED.sub(r"\1", m[1])), text)
        text = re.sub(rf"\\(?:text\w+|emph|underline|mbox|uline|sout|textsc|enquote|code){_ARG}", r"\1", text)
        if text == before:
            break
    text = re.sub(r"\\textbackslash(?:\{\})?\s?", lambda m: _hold(held, "\\"), text)
    text = re.sub(r"\\textasciitilde(?:\{\})?\s?|\\~\{\}", lambda m: _hold(held, "~"), text)
    text = re.sub(r"\\textasciicircum(?:\{\})?\s?|\\\^\{\}", lambda m: _hold(held, "^"), text)
    text = re.sub(r"\\(?:ldots|dots)(?:\{\})?", "…", text)
    text = _ESCAPED.sub(lambda m: _hold(held, m[1]), text)
    text = text.replace("~", " ").replace("\\,", " ").replace("\\ ", " ")
    text = re.sub(r"\\[A-Za-z]+\*?(?:\[[^\]]*\])?", "", text)
    return _release(held, re.sub(r"[{}]", "", text)), links


# ---------------------------------------------------------------- Markdown

_FENCE = re.compile(r"^ {0,3}(`{3,}|~{3,})([^`]*)$")
_ATX = re.compile(r"^ {0,3}#{1,6}(?:[ \t]+(.*?))?(?:[ \t]+#+)?[ \t]*$")
_MD_ITEM = re.compile(r"^(\s*)(?:[-*+]|\d{1,9}[.)])(?:[ \t]+(.*)|)$")
_RULE = re.compile(r"^ {0,3}(?:(?:-[ \t]*){3,}|(?:\*[ \t]*){3,}|(?:_[ \t]*){3,})$")
_SETEXT = re.compile(r"^ {0,3}(?:=+|-+)[ \t]*$")
_HTML_START = re.compile(rf"^ {{0,3}}</?(?:{_BLOCK})(?:\s|/?>|$)", re.I)


def _paragraph(root: Node, text: str, clean, kind: str = "p") -> None:
    shown, links = clean(text)
    node = root.add(Node(kind, shown, links))
    node.children += [Node("formula", next(g for g in m.groups() if g)) for m in MATH.finditer(re.sub(r"(?<!`)(`+)(?!`)(.+?)(?<!`)\1(?!`)", "", text, flags=re.S))]


_DELIMITER = re.compile(r"^\s*\|?\s*:?-{2,}:?\s*(\|\s*:?-+:?\s*)+\|?\s*$")
_MARKERS = re.compile(r"(?:(?:[-*+]|\d{1,9}[.)])[ \t]+)+(?=\S)")
_SPAN = re.compile(r"(?<!`)(`+)(?!`)(.+?)(?<!`)\1(?!`)", re.S)
#: Levels of quotes within quotes that are kept apart; the signs of deeper ones are taken off at once.
LEVELS = 20


def _indent(line: str) -> int:
    """The column of the first sign."""
    return len(line[: len(line) - len(line.lstrip(" \t"))].expandtabs(4))


def _outdent(line: str, columns: int) -> str:
    """Without as many columns of leading blanks."""
    return " " * max(0, _indent(line) - columns) + line.lstrip(" \t")


def _starts_block(line: str) -> bool:
    """Ends an open paragraph, so that it is no further line of a quote or a table."""
    return any(p.match(line) for p in (_MD_ITEM, _ATX, _FENCE, _RULE, _HTML_START)) or line.startswith(("$$", ">"))


def _fenced(lines: list[str], i: int, mark: str, at: int, base: int) -> tuple[list[str], int]:
    """The lines of the fenced code that begins at line i, and the line behind it.

    Within an item (``base`` is its column) code without a closing fence ends with
    the item; code that stands out of the item up to its fence is still whole.
    """
    closes = re.compile(rf"^[ \t]{{0,{base + 3}}}{re.escape(mark[0])}{{{len(mark)},}}\s*$")
    end, out = i, None
    while end < len(lines) and not closes.match(lines[end].rstrip("\r")):
        if base and lines[end].strip() and _indent(lines[end]) < base:
            out = end if out is None else out
            if _starts_block(lines[end]):
                break
        end += 1
    closed = end < len(lines) and closes.match(lines[end].rstrip("\r"))
    if not closed and out is not None:
        end = out
    body = [_outdent(x, min(at, _indent(x))) if at else x for x in lines[i:end]]
    return body, end + 1 if closed else end


def _quoted(lines: list[str], i: int, depth: int) -> tuple[list[str], int]:
    """The lines of the quote that begins at line i, without its signs, and the line behind it.

    A line without a sign belongs to it if it continues a quoted paragraph.
    """
    inner: list[str] = []
    fenced = paragraph = False
    while i < len(lines):
        line = lines[i].rstrip("\r").lstrip(" \t")
        if line.startswith(">"):
            inner.append(re.sub(r"^>[ \t]?" if depth < LEVELS else r"^[ \t>]*>[ \t]?", "", line))
            bare = line.lstrip("> \t")
            fenced ^= bare.startswith(("```", "~~~"))
            paragraph = bool(bare) and not fenced and not any(p.match(bare) for p in (_ATX, _FENCE, _RULE)) and not bare.startswith(("|", "$$"))
        elif line.strip() and paragraph and not _starts_block(line):
            inner.append(line)
        else:
            break
        i += 1
    return inner, i


def _table(rows: list[str]) -> Node:
    table = Node("table")
    for k, row in enumerate(rows):
        if k == 1 and not row.strip("|:- \t"):
            continue
        for cell in re.split(r"(?<!\\)\|", row):
            if cell.strip():
                _paragraph(table, cell.strip().replace("\\|", "|"), clean_markdown)
    return table


def parse_markdown(text: str, depth: int = 0) -> Node:
    """The tree of a text. Quotes and tables hold their parts, of which :func:`elements` takes none."""
    root = Node("root")
    lines = (text if depth else _blank_comments(text)).split("\n")
    i, para, item = 0, [], None  # item: the lines of the open list item
    columns: list[int] = []  # where the text of the open items, each within the one before, begins
    closing = max((k for k, x in enumerate(lines) if "$$" in x), default=-1)

    def flush() -> None:
        nonlocal item
        if item is not None:
            own = re.sub(r"^\[[ xX]\]\s+", "", "\n".join(item).strip())
            if own:
                _paragraph(listed, own, clean_markdown, "item")
            item = None
        if para:
            _paragraph(root, "\n".join(para), clean_markdown)
            para.clear()

    listed = Node("list")
    gap = True
    while i < len(lines):
        whole = lines[i].rstrip("\r")
        if not whole.strip():
            if para or item is not None:
                flush()
            gap = True
            i += 1
            continue
        at, own = _indent(whole), whole.strip()
        around = [c for c in columns if c <= at]
        base = around[-1] if around else 0
        line = _outdent(whole, base)  # as it stands in its item
        indented = at - base >= 4
        in_list = bool(root.children) and root.children[-1] is listed
        m = _MD_ITEM.match(line)
        if f := _FENCE.match(line):
            flush()
            columns = around
            body, i = _fenced(lines, i + 1, f[1], at, base)
            root.add(Node("code", "\n".join(body)))
            gap = True
            continue
        if indented and gap and not para and item is None and not (m and in_list):
            flush()
            columns, body = around, []
            while i < len(lines) and (not lines[i].strip() or _indent(lines[i]) >= base + 4):
                body.append(_outdent(lines[i], base + 4))
                i += 1
            root.add(Node("code", "\n".join(body)))
            gap = True
            continue
        # Without another $$ it is no formula; behind a $$ that a paragraph left open it ends that one.
        if own.startswith("$$") and "$$" not in own[2:] and closing > i and _SPAN.sub("", "\n".join(para or item or ())).count("$$") % 2 == 0:
            flush()
            columns, body = around, [own[2:]]
            i += 1
            while "$$" not in lines[i]:
                body.append(lines[i])
                i += 1
            last, rest = lines[i].split("$$", 1)
            root.add(Node("formula", "\n".join([*body, last])))
            if rest.strip():
                para.append(rest.strip())
            i, gap = i + 1, not rest.strip()
            continue
        if _HTML_START.match(line):
            flush()
            columns, body = around, []
            if f := re.match(r"^ {0,3}<(pre|script|style)\b", line, re.I):
                while i < len(lines):
                    body.append(lines[i])
                    i += 1
                    if re.search(rf"</{f[1]}\s*>", body[-1], re.I):
                        break
            else:
                while i < len(lines) and lines[i].strip():
                    body.append(lines[i])
                    i += 1
            part = root.add(parse_html("\n".join(body)))
            part.kind, gap = "block", True
            continue
        if own.startswith(">"):
            flush()
            columns = around
            inner, i = _quoted(lines, i, depth)
            root.add(Node("quote")).children = parse_markdown("\n".join(inner), depth + 1).children
            gap = True
            continue
        if f := _ATX.match(line):
            flush()
            columns = around
            _paragraph(root, f[1] or "", clean_markdown, "heading")
            i, gap = i + 1, True
            continue
        if para and item is None and _SETEXT.match(line):
            _paragraph(root, "\n".join(para), clean_markdown, "heading")
            para.clear()
            i, gap = i + 1, True
            continue
        if _RULE.match(line):
            flush()
            columns = around
            i, gap = i + 1, True
            continue
        if (own[0] == "|" and own[-1] == "|" and len(own) > 1) or (i + 1 < len(lines) and "|" in line and _DELIMITER.match(lines[i + 1])):
            flush()
            columns, rows = around, [own]
            i += 1
            while i < len(lines) and "|" in lines[i] and not _starts_block(lines[i].strip()):
                rows.append(lines[i].strip())
                i += 1
            root.add(_table(rows))
            gap = True
            continue
        if m and ((m[2] or "").strip() or not para) and not (para and item is None and re.match(r"\s*\d", line) and not re.match(r"\s*1[.)]", line)) and (not indented or in_list or item is not None):
            flush()
            if not (root.children and root.children[-1] is listed):
                listed = root.add(Node("list"))
            mark = re.match(r"\d*.", own)[0]
            text = own[len(mark) :].lstrip(" \t")
            pad = _indent(own[len(mark) :])
            columns = [*around, at + len(mark) + (pad if text and pad <= 4 else 1)]
            if f := _MARKERS.match(text):  # items that begin in one line are one
                text = text[f.end() :]
            if text and (_FENCE.match(text) or text.startswith(">")):
                lines[i] = " " * columns[-1] + text
                gap = True
                continue
            item = [text] if text else []
            i, gap = i + 1, False
            continue
        if item == [] and (not around or around != columns):
            flush()
        if item is not None:
            item.append(own)
        else:
            columns = columns if para else around
            para.append(own)
        gap = False
        i += 1
    flush()
    return root


def _blank_comments(text: str) -> str:
    """Without HTML comments, but for those in fenced code and code spans."""
    out, fence = [], None
    inside = listed = False
    lines = text.split("\n")
    last = max((k for k, x in enumerate(lines) if "-->" in x), default=-1)
    for k, line in enumerate(lines):
        if inside:
            if "-->" not in line:
                continue
            line = line.split("-->", 1)[1]
            inside = False
        listed = listed or bool(_MD_ITEM.match(line))
        m = _FENCE.match(line.strip() if listed else line.rstrip("\r"))
        if fence is None and m:
            fence = m[1]
        elif fence is not None:
            if m and m[1].startswith(fence) and not m[2].strip():
                fence = None
        elif "<!--" in line:
            kept, at = [], 0
            for c in re.finditer(r"(?<!`)(`+)(?!`).+?(?<!`)\1(?!`)|<!--(.*?-->)?", line):
                if c[1]:
                    continue
                if c[2] is None:
                    # One that never ends is a comment only where it begins its line.
                    inside = last > k or not line[: c.start()].strip()
                    if not inside:
                        continue
                kept.append(line[at : c.start()])
                at = len(line) if inside else c.end()
                if inside:
                    break
            line = "".join(kept) + line[at:]
        out.append(line)
    return "\n".join(out)


# ---------------------------------------------------------------- wiki

_W_HEAD = re.compile(r"^(={1,6})[ \t]*(.+?)[ \t]*\1[ \t]*$")


def _cells(cells: Iterable[str], held: list[Node], clean) -> Node:
    """A table of these cells, which may hold marks of held nodes."""
    table = Node("table")
    for cell in cells:
        for k, part in enumerate(re.split(f"{_KEEP}(\\d+){_KEEP}", cell)):
            if k % 2:
                table.add(held[int(part)])
            elif part.strip():
                _paragraph(table, part.strip(), clean)
    return table


def _wiki_cells(source: str) -> list[str]:
    cells: list[str] = []
    for line in source.split("\n")[1:]:
        line = line.strip()
        if line.startswith(("|", "!")):
            sign, line = line[0], "" if line.startswith(("|-", "|}")) else line[1:].removeprefix("+")
            cells += [re.sub(r"^[^|\[\]{}]*=[^|\[\]{}]*\|", "", c) for c in re.split(r"\|\||!!" if sign == "!" else r"\|\|", line)]
        elif cells:
            cells[-1] += "\n" + line
    return cells


def parse_wiki(text: str) -> Node:
    """The tree of a text. Quotes and tables hold their parts, of which :func:`elements` takes none."""
    held: list[Node] = []

    def keep(node: Node) -> str:
        held.append(node)
        return f"\n{_KEEP}{len(held) - 1}{_KEEP}\n"

    def reduced(text: str) -> str:
        text = re.sub(r"<blockquote\b[^>]*>(.*?)(?:</blockquote\s*>|\Z)", lambda m: keep(_wiki_blocks(Node("quote"), reduced(re.sub(r"<blockquote\b[^>]*>", "\n", m[1], flags=re.I)), held)), text, flags=re.S | re.I)
        text = re.sub(r"<table\b[^>]*>(.*?)(?:</table\s*>|\Z)", lambda m: keep(_cells(re.split(r"(?i)</?(?:table|caption|t[rdh]|thead|tbody|tfoot)\b[^>]*>", m[1]), held, clean_wiki)), text, flags=re.S | re.I)
        text = re.sub(r"(?:<ref[^>/]*/>|<ref[^>]*>.*?</ref>)[ \t]*", "", text, flags=re.S | re.I)
        return re.sub(r"^[ \t]*\{\|.*?(?:^[ \t]*\|\}|\Z)", lambda m: keep(_cells(_wiki_cells(m[0]), held, clean_wiki)), text, flags=re.S | re.M)

    text = text.replace(_KEEP, "")
    text = re.sub(r"<(syntaxhighlight|source)\b[^>]*>(.*?)(?:</\1\s*>|\Z)", lambda m: keep(Node("code", m[2])), text, flags=re.S | re.I)
    text = re.sub(r"<pre\b[^>]*>(.*?)(?:</pre\s*>|\Z)", lambda m: keep(Node("code", html.unescape(m[1]))), text, flags=re.S | re.I)
    text = COMMENT.sub("", text)
    return _wiki_blocks(Node("root"), reduced(text), held)


def _wiki_blocks(root: Node, text: str, held: list[Node]) -> Node:
    """``root`` with the blocks of a text; marks in it stand for held nodes."""
    para: list[str] = []
    listed = Node("list")

    def add(source: str, kind: str, to: Node) -> None:
        shown, links = clean_wiki(source)
        node = to.add(Node(kind, shown, links))
        node.children += [Node("formula", html.unescape(m[1])) for m in re.finditer(r"<math[^>]*>(.*?)</math>", source, re.S | re.I)]

    def flush() -> None:
        if para:
            add("\n".join(para), "p", root)
            para.clear()

    for line in [*text.split("\n"), ""]:
        line = line.rstrip("\r")
        if m := re.fullmatch(f"{_KEEP}(\\d+){_KEEP}", line.strip()):
            flush()
            root.add(held[int(m[1])])
        elif not line.strip() or re.match(r"^-{4,}\s*$", line):
            flush()
        elif m := _W_HEAD.match(line):
            flush()
            add(m[2], "heading", root)
        elif m := re.match(r"^([*#]+)[ \t]*([^*#\s].*)$", line):
            flush()
            if not root.children or root.children[-1] is not listed:
                listed = root.add(Node("list"))
            add(m[2], "item", listed)
        elif re.match(r"^[ ]+\S", line) and not para:
            if root.children and root.children[-1].kind == "code" and root.children[-1].link == -1:
                root.children[-1].text += "\n" + line[1:]
            else:
                root.add(Node("code", line[1:], -1))
        else:
            para.append(line)
    flush()
    for n in root.children:
        n.link = max(n.link, 0)
    return root


# ---------------------------------------------------------------- LaTeX


def parse_latex(text: str) -> Node:
    """The tree of a text. Quotes and tables hold their parts, of which :func:`elements` takes none."""
    held: list[Node] = []

    def keep(node: Node) -> str:
        held.append(node)
        return f"\n\n{_KEEP}{len(held) - 1}{_KEEP}\n\n"

    text = text.replace(_KEEP, "").replace("\r\n", "\n")
    text = re.sub(r"\\begin\{(verbatim\*?|lstlisting|minted|Verbatim|alltt)\}(?:\[[^\]]*\])?(?:(?<=minted\})\{[^}]*\})?(.*?)(?:\\end\{\1\}|\Z)", lambda m: keep(Node("code", m[2])), text, flags=re.S)
    text = re.sub(r"(?<!\\)%[^\n]*", "", text)
    return _latex_blocks(Node("root"), _latex_reduced(text, held, keep), held)


def _latex_reduced(text: str, held: list[Node], keep) -> str:
    """The text with marks for its quotes, tables and displayed formulas."""

    def part(m: re.Match) -> str:
        if m[1] in ("comment", "thebibliography"):
            return "\n\n"
        if m[1].startswith("quot"):
            return keep(_latex_blocks(Node("quote"), _latex_reduced(re.sub(r"\\(?:begin|end)\{quot(?:e|ation)\}", "\n\n", m[2]), held, keep), held))
        rows = re.sub(rf"^\[[^\]]*\]|\\begin\{{tabular\*\}}{_ARG}(?:\[[^\]]*\])?{_ARG}|\\begin\{{(?:tabular|longtable)\}}(?:\[[^\]]*\])?(?:{_ARG})?|\\(?:end|cline|cmidrule){_ARG}|\\(?:hline|(?:top|mid|bottom)rule|centering)(?![A-Za-z])", "", m[2] if m[1].startswith("table") else m[0])
        return keep(_cells(re.split(r"(?<!\\)&|\\\\(?:\[[^\]]*\])?", re.sub(rf"\\caption(?:\[[^\]]*\])?{_ARG}", r"\1 & ", rows)), held, clean_latex))

    text = re.sub(r"\\begin\{(quote|quotation|tabular\*?|table\*?|longtable|comment|thebibliography)\}(.*?)(?:\\end\{\1\}|\Z)", part, text, flags=re.S)
    text = re.sub(r"\\begin\{(equation\*?|align\*?|gather\*?|multline\*?|eqnarray\*?|displaymath|math)\}(.*?)(?:\\end\{\1\}|\Z)", lambda m: keep(Node("formula", re.sub(rf"\\label{_ARG}", "", m[2]))), text, flags=re.S)
    text = re.sub(r"\\\[(.+?)\\\]", lambda m: keep(Node("formula", m[1])), text, flags=re.S)
    return re.sub(r"(?<!\\)\$\$(.+?)\$\$", lambda m: keep(Node("formula", m[1])), text, flags=re.S)


def _latex_blocks(root: Node, text: str, held: list[Node]) -> Node:
    """``root`` with the blocks of a text; marks in it stand for held nodes."""
    token = re.compile(rf"\\(?:part|chapter|(?:sub){{0,2}}section|(?:sub)?paragraph)\*?(?:\[[^\]]*\])?{_ARG}|\\begin\{{(?:itemize|enumerate|description)\}}(?:\[[^\]]*\])?|\\end\{{(?:itemize|enumerate|description)\}}|\\item(?:\[[^\]]*\])?(?![A-Za-z])|{_KEEP}(\d+){_KEEP}|\n[ \t]*\n")

    def add(source: str, kind: str, to: Node) -> None:
        if source.strip() or kind == "heading":
            shown, links = clean_latex(source)
            node = to.add(Node(kind, shown, links))
            node.children += [Node("formula", next(g for g in m.groups() if g)) for m in MATH.finditer(source)]

    at, depth, item, listed = 0, 0, False, Node("list")
    for m in [*token.finditer(text), None]:
        chunk = text[at : m.start() if m else len(text)]
        if chunk.strip():
            add(chunk, "item" if item else "p", listed if item else root)
            item = False
        if m is None:
            break
        at = m.end()
        whole = m[0]
        if whole.startswith("\\begin"):
            depth += 1
            if depth == 1:
                listed = root.add(Node("list"))
            item = False
        elif whole.startswith("\\end"):
            depth, item = max(0, depth - 1), False
        elif whole.startswith("\\item"):
            item = depth > 0
        elif m[2] is not None:
            root.add(held[int(m[2])])
        elif whole.startswith("\\"):
            add(m[1], "heading", root)
            item = False
    return root


# ---------------------------------------------------------------- which markup, which part

_LATEX = re.compile(r"\\(?:begin|end|section|subsection|subsubsection|paragraph|chapter|item|href|url|text(?:bf|it|tt|sc|rm)|emph|underline|cite|label|footnote|ref)\b\*?\s*[\[{ ]|\\(?:item)\b")
_WIKI = re.compile(r"(?m)^={1,6}[ \t]*[^=\s].*?[^=\s]?[ \t]*={1,6}[ \t]*\r?$|'''?(?=\S)[^'\n]+'''?|\[\[[^\[\]\n]+\]\]|\[(?:https?:)?//\S+ [^\]\n]+\]|^\{\||\{\{[^{}]+\}\}|<(?:syntaxhighlight|source|math|ref|nowiki)\b|^(?:\*\*+|##+\*?|\*#|#\*)[ \t]*[^*#\s]+ .*\n(?=[*#])")
_MARKDOWN = re.compile(r"(?m)^ {0,3}#{1,6}[ \t]+\S|^ {0,3}(?:`{3,}|~{3,})|\]\((?:https?:|/|#|\.)|^[^\S\n]*(?:[-+*]|\d{1,3}[.)])[ \t]+\S|(?<!\*)\*\*(?=[^\s*])[^*\n]+\*\*|(?<!`)`[^`\n]+`|^>[ \t]?\S|^\S[^\n]*\n(?:={3,}|-{3,})[ \t]*\r?$|^\$\$|(?<![\w$\\])\$\\?[^\s$][^$\n]*\\[^$\n]*\S?\$(?!\w)|(?<![\w*])\*(?=[^\s*])[^*\n]+(?<=[^\s*])\*(?![\w*])|(?<!\w)__?(?=[^\s_])[^\n]*?[^\s_]__?(?!\w)|^<!--|^ {0,3}\|.*\|[ \t]*\r?$|(?<![\w$\\])\$(?=[^\s$])[^$\n]*[\^=\\][^$\n]*(?<=\S)\$(?![\w$])")
_WIKI_LIST = re.compile(r"(?m)^#[ \t]*[^#\s=].*\r?\n#[ \t]*[^#\s]")


def markup_of(text: str) -> str | None:
    """'html', 'latex', 'wiki', 'markdown', or None for plain text."""
    bare = COMMENT.sub("", text)
    wiki_code = re.search(r"<(?:syntaxhighlight|source)\b", bare, re.I)
    bare = re.sub(r"<(pre|syntaxhighlight|source)\b.*?(?:</\1\s*>|\Z)", r"<\1></\1>", bare, flags=re.S | re.I)
    bare = re.sub(r"(?ms)^ {0,3}(`{3,}|~{3,})[^`\n]*\n.*?(?:^ {0,3}\1[`~]*[ \t]*\r?$|\Z)", r"\1\n", bare)
    latex_code = re.search(r"\\begin\{(?:verbatim|lstlisting|minted)", bare)
    bare = re.sub(r"\\begin\{(verbatim|lstlisting|minted)\}.*?(?:\\end\{\1\}|\Z)", "", bare, flags=re.S)
    # <pre> is at home in wiki text too
    blocks, inline = len(BLOCK_TAG.findall(bare)), len(INLINE_TAG.findall(bare))
    own = len(BLOCK_TAG.findall(re.sub(r"</?pre\b[^>]*>", "", bare, flags=re.I)))
    latex = len(_LATEX.findall(bare)) + (2 if latex_code else 0)
    wiki = len(_WIKI.findall(bare)) + (2 if wiki_code else 0) + (1 if _WIKI_LIST.search(bare) else 0)
    fenced = re.search(r"(?m)^ {0,3}(?:`{3,}|~{3,})", bare)
    markdown = len(_MARKDOWN.findall(bare)) + (2 if fenced else 0)
    if latex and latex >= wiki and (latex >= blocks or not blocks) and not fenced:
        return "latex"
    if wiki and not fenced and (wiki >= own or wiki_code) and not re.search(r"(?m)^#{2,6} \S|\]\(https?:", bare):
        return "wiki"
    # Markdown may hold HTML blocks, HTML no Markdown lines.
    if blocks and (blocks + inline >= 2 * markdown or not markdown) and not fenced and not re.search(r"(?m)^#{1,6} \S|\]\(https?:|^[ \t]*(?:[-*+]|\d{1,3}[.)])[ \t]+\S", bare):
        return "html"
    if markdown or fenced:
        return "markdown"
    if blocks or inline:
        return "html"
    if COMMENT.search(text):
        return "markdown"
    if re.search(r"\\\(.+?\\\)|\\\[.+?\\\]|&(?:[a-z]+|#\d+|#x[0-9a-f]+);", bare, re.S | re.I):
        return "html"
    return None


_PARSERS = {"html": parse_html, "latex": parse_latex, "wiki": parse_wiki, "markdown": parse_markdown}


#: Score from which a part is content: one block of text outside links has it. A part of fewer link blocks than that is a reference, no navigation.
WORTH, LINKS = 0.5, 3


def _text_blocks(node: Node) -> Iterator[Node]:
    for c in node.children:
        if c.kind in ("p", "item", "code", "heading", "formula"):
            yield c
        yield from _text_blocks(c) if c.kind not in ("p", "heading", "formula") else ()


def _density(node: Node) -> float:
    """The share of its paragraphs' and items' text that stands in links; a heading that is a link is no navigation."""
    held = [c for c in ([node] if node.kind in ("p", "item") else []) + list(_text_blocks(node)) if c.kind in ("p", "item")]
    size = sum(len(squeeze(c.text)) for c in held)
    return min(1.0, sum(c.link for c in held) / size) if size else 0.0


def _sections(node: Node) -> None:
    """Makes a container of every heading and what follows it, as flat markup has no other."""
    for c in node.children:
        _sections(c)
    if node.kind in ("root", "block") and sum(c.kind == "heading" for c in node.children) and len(node.children) > 1:
        parts: list[Node] = []
        for c in node.children:
            if c.kind == "heading" or not parts:
                parts.append(Node("block"))
            parts[-1].add(c)
        node.children = parts


def main_content(root: Node) -> list[Node]:
    """The subtrees to keep, in their order: the best container and, on each level above it, its siblings of worth.

    Every block of text gives one point, one more for each comma and each 100 characters (three at
    most) to the container it stands in and half of them to the next above. A
    container's points are discounted by its link density, and so are those a sibling has in all.
    """
    _sections(root)
    above: dict[int, Node] = {}
    containers = [root]
    own: dict[int, float] = {}

    def points(c: Node) -> float:
        text = squeeze(c.text)
        return 1 + text.count(",") + text.count("，") + min(len(text) / 100, 3)

    def visit(node: Node) -> float:
        total = 0.0
        for c in node.children:
            above[id(c)] = node
            if c.kind in ("block", "root"):
                containers.append(c)
            if c.kind in ("p", "item", "code", "heading", "formula"):
                given = points(c)
                total += given
                at, share = node, 1.0
                while at is not None and share > 0.2:
                    if at.kind in ("block", "root"):
                        at.score += given * share
                        share /= 2
                    at = above.get(id(at))
            total += visit(c)
        own[id(node)] = total + (points(node) if node.kind in ("p", "item", "code", "heading", "formula") else 0.0)
        return total

    visit(root)
    for c in containers:
        c.score *= 1 - _density(c)
    best = max(containers, key=lambda c: c.score)  # the first, that is the outermost, of equals

    def worthy(s: Node) -> bool:
        if own[id(s)] * (1 - _density(s)) >= WORTH or s.kind in ("quote", "table", "skip"):
            return True
        return sum(1 for c in ([s] if s.kind in ("p", "item") else []) + list(_text_blocks(s)) if c.link) < LINKS

    path = {id(best)}
    node = best
    while (parent := above.get(id(node))) is not None:
        path.add(id(parent))
        node = parent

    def keep(node: Node) -> list[Node]:
        if node is best:
            return [node]
        return [k for c in node.children for k in (keep(c) if id(c) in path else [c] if worthy(c) else [])]

    # Of the best container itself, the parts go that are navigation.
    best.children = [c for c in best.children if worthy(c)]
    return keep(root)


def elements(text: str) -> list[tuple[str, str]]:
    """(kind, clean text) of the headings, list items, code blocks and formulas of a marked-up text."""
    kind = markup_of(text)
    if kind is None:
        return []
    root = _PARSERS[kind](text.replace("\r\n", "\n"))
    out: list[tuple[str, str]] = []
    names = {"heading": HEADING, "item": ITEM, "code": CODE, "formula": FORMULA}

    def emit(node: Node) -> None:
        if node.kind in ("quote", "table", "skip"):
            return
        if node.kind in names:
            shown = squeeze(re.sub(r"\\\((.+?)\\\)|\\\[(.+?)\\\]", lambda m: m[1] or m[2], node.text) if node.kind in ("heading", "item") and kind == "html" else node.text)
            if shown:
                out.append((names[node.kind], shown))
        for c in node.children:
            emit(c)

    for node in main_content(root):
        emit(node)
    return out


def clean_text(text: str) -> str:
    """The whole main text, one line per block; headings, items, code and formulas among it, and what stands in quotes and tables."""
    kind = markup_of(text)
    if kind is None:
        return squeeze(text)
    lines: list[str] = []
    marks = {"heading": "# ", "item": "- "}

    def walk(node: Node) -> None:
        if node.kind == "skip":
            return
        shown = squeeze(node.text)
        if shown:
            lines.append(f"```\n{node.text.strip()}\n```" if node.kind == "code" else marks.get(node.kind, "") + shown)
        for c in node.children:
            if c.kind != "formula" or not shown:
                walk(c)

    for node in main_content(_PARSERS[kind](text.replace("\r\n", "\n"))):
        walk(node)
    return "\n".join(lines)


_TITLE_MD = re.compile(r"^#{1,6}[ \t]+|[ \t]+#+$")


def clean_title(title: str) -> str | None:
    """The clean text of a one-line title that carries markup, None for one that doesn't."""
    shown = title
    if _LATEX.search(shown) or re.search(r"\\[_&%#$]", shown):
        shown = clean_latex(shown)[0]
    elif re.search(r"'''?(?=\S).+?'''?|\[\[[^\[\]]+\]\]|\[(?:https?:)?//\S+ [^\]]+\]|^=+[^=]+=+$", shown):
        shown = clean_wiki(re.sub(r"^(=+)\s*(.*?)\s*\1$", r"\2", shown.strip()))[0]
    elif TAG.search(shown) or re.search(r"&(?:[a-z]{2,8}|#\d+|#x[0-9a-f]+);", shown, re.I):
        shown = html.unescape(TAG.sub("", re.sub(r"<br\s*/?>", " ", shown, flags=re.I)))
        if not TAG.search(title):
            shown = clean_markdown(_TITLE_MD.sub("", shown))[0]
    else:
        shown = clean_markdown(_TITLE_MD.sub("", shown.strip()))[0]
    shown = squeeze(shown)
    return shown if shown and shown != squeeze(title) else None


def _extract(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, fields, kinds, texts = [], [], [], []
        for i, title, body in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
            if title and (shown := clean_title(title)):
                ids.append(i), fields.append("title"), kinds.append("title"), texts.append(shown)
            for kind, shown in elements(body) if body and not body.isspace() else ():
                ids.append(i), fields.append("body"), kinds.append(kind), texts.append(shown)
        yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(fields, pa.string()), pa.array(kinds, pa.string()), pa.array(texts, pa.string())], ["id", "field_name", "element", "element_text"])


def marked_elements(df: DataFrame, record: str, title: str, body: str) -> DataFrame:
    """(record, field_name, element, element_text), distinct rows: the structure of marked-up titles and bodies.

    ``record`` is BIGINT (null stays null). Null, empty, blank and plain texts
    give no row. Repeated rows and elements come out once. Texts are parsed
    whole; an empty input gives an empty result; extra columns are ignored.
    """
    given = df.select(col(record).cast("bigint").alias("id"), col(title).alias("t"), col(body).alias("b")).distinct()
    return given.mapInArrow(_extract, "id bigint, field_name string, element string, element_text string").distinct().withColumnRenamed("id", record)


def clean_documents(df: DataFrame, text: str, out: str = "clean_text") -> DataFrame:
    """``df`` with the main text of ``text`` without markup; null stays null, plain text is only squeezed."""
    @F.pandas_udf("string")
    def clean(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else clean_text(t))

    return df.withColumn(out, clean(col(text)))
