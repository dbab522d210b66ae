"""Markdown as a tree of blocks and spans, and writers that walk it: XHTML, DOCX paragraphs, Rich Text and plain text.

Blocks are headings, paragraphs, fenced code, quotes, lists (nested, bulleted or numbered) and rules; spans have marks
(strong, em, strike, code) and perhaps a link. Other markup stays as text. Quotes and lists nest up to ``DEPTH``
levels; what is deeper is a paragraph. Null is an empty text; a text of no blocks gives nothing.
"""

from __future__ import annotations

import re
from html import escape
from typing import NamedTuple

DEPTH = 12


class Span(NamedTuple):
    text: str
    marks: frozenset = frozenset()
    href: str | None = None


class Block(NamedTuple):
    """kind: heading (number: level), para, code (text), quote (items[0]), bullets or numbers (items; number: the first), rule."""

    kind: str
    number: int = 0
    spans: tuple[Span, ...] = ()
    text: str = ""
    items: tuple[tuple[Block, ...], ...] = ()


_FENCE = re.compile(r" {0,3}(`{3,}|~{3,})")
_HEADING = re.compile(r" {0,3}(#{1,6})\s+(.*?)(?:\s+#+)?\s*$")
_RULE = re.compile(r" {0,3}([-*_])(?:\s*\1){2,}\s*$")
_ITEM = re.compile(r"(\s*)(?:([-*+])|(\d{1,9})[.)])\s+(?=\S)")
# A mark's text ends at the next mark of its kind, so what is never closed costs one look as far as that.
_SPAN = re.compile(
    r"\\(?P<escaped>[!-/:-@\[-`{-~])|(?P<tick>`+)(?!`)(?P<code>.+?)(?<!`)(?P=tick)(?!`)|!\[(?P<alt>[^\[\]]*)\]\([^)\s]+\)|\[(?P<label>[^\[\]]+)\]\((?P<href>[^)\s]+)\)"
    r"|\*\*(?P<strong>(?=\S)(?:[^*]|\*(?!\*)|\*(?=\*\*(?!\*)))+?(?<=\S))\*\*(?!\*)|(?<!\w)__(?P<strong2>(?=\S)(?:[^_]|_(?!_))+?(?<=\S))__(?!\w)|~~(?P<strike>(?=\S)(?:[^~]|~(?!~))+?(?<=\S))~~"
    r"|(?<!\*)\*(?P<em>(?=[^\s*])(?:[^*]|\*\*[^*]+\*\*)+?(?<=\S))\*(?!\*)|(?<!\w)_(?P<em2>(?=[^\s_])[^_]+?(?<=\S))_(?!\w)",
    re.S,
)


def spans(text: str, marks: frozenset = frozenset(), href: str | None = None) -> tuple[Span, ...]:
    out: list[Span] = []

    def add(new: Span) -> None:
        if out and out[-1][1:] == new[1:]:
            out[-1] = Span(out[-1].text + new.text, *new[1:])
        elif new.text:
            out.append(new)

    at = 0
    for m in _SPAN.finditer(text):
        add(Span(text[at : m.start()], marks, href))
        at, g = m.end(), m.groupdict()
        kind = next((k for k in ("strong", "strong2", "em", "em2", "strike") if g[k] is not None), None)
        if kind:
            inner = spans(g[kind], marks | {kind.rstrip("2")}, href)
        elif g["label"] is not None:
            inner = spans(g["label"], marks, g["href"])
        elif g["code"] is not None:
            inner = (Span(g["code"], marks | {"code"}, href),)
        else:
            inner = (Span(g["escaped"] or g["alt"] or "", marks, href),)
        for s in inner:
            add(s)
    add(Span(text[at:], marks, href))
    return tuple(out)


def parse(text: str | None) -> tuple[Block, ...]:
    return _blocks((text or "").replace("\r\n", "\n").replace("\t", "    ").split("\n"), 0)


def _starts(line: str) -> bool:
    """Whether a line ends the paragraph before it."""
    return bool(_FENCE.match(line) or _HEADING.match(line) or _RULE.match(line) or _ITEM.match(line) or line.lstrip().startswith(">"))


def _blocks(lines: list[str], depth: int) -> tuple[Block, ...]:
    out: list[Block] = []
    i = 0
    while i < len(lines):
        line = lines[i]
        fence, heading, item = _FENCE.match(line), _HEADING.match(line), _ITEM.match(line) if depth < DEPTH else None
        if not line.strip():
            i += 1
        elif fence:
            end = next((j for j in range(i + 1, len(lines)) if lines[j].strip().startswith(fence[1]) and not lines[j].strip().strip(fence[1][0])), len(lines))
            out.append(Block("code", text="\n".join(lines[i + 1 : end])))
            i = end + 1
        elif heading:
            out.append(Block("heading", len(heading[1]), spans(heading[2])))
            i += 1
        elif _RULE.match(line):
            out.append(Block("rule"))
            i += 1
        elif line.lstrip().startswith(">") and depth < DEPTH:
            end = next((j for j in range(i, len(lines)) if not lines[j].lstrip().startswith(">")), len(lines))
            out.append(Block("quote", items=(_blocks([re.sub(r"^\s*> ?", "", x) for x in lines[i:end]], depth + 1),)))
            i = end
        elif item:
            block, i = _list(lines, i, depth)
            out.append(block)
        else:
            end = next((j for j in range(i + 1, len(lines)) if not lines[j].strip() or (_starts(lines[j]) and depth < DEPTH)), len(lines))
            out.append(Block("para", spans=spans("\n".join(x.strip() for x in lines[i:end]))))
            i = end
    return tuple(out)


def _list(lines: list[str], i: int, depth: int) -> tuple[Block, int]:
    """The list that begins at line i, and the line after it."""
    first = _ITEM.match(lines[i])
    indent, bullets = len(first[1]), first[2] is not None
    items: list[tuple[Block, ...]] = []
    while i < len(lines) and (m := _ITEM.match(lines[i])) and len(m[1]) < indent + 2 and (m[2] is not None) == bullets and not _RULE.match(lines[i]):
        own, i = [lines[i][m.end() :]], i + 1
        while i < len(lines):
            inside = len(lines[i]) - len(lines[i].lstrip()) >= indent + 2
            if not lines[i].strip():
                # A blank line is inside if what follows is.
                after = next((x for x in lines[i + 1 :] if x.strip()), "")
                if len(after) - len(after.lstrip()) < indent + 2:
                    break
            elif not inside and (_starts(lines[i]) or not own[-1].strip()):
                break
            own.append(lines[i][min(m.end(), len(lines[i]) - len(lines[i].lstrip())) :] if inside else lines[i].strip())
            i += 1
        items.append(_blocks(own, depth + 1))
        after = i
        while after < len(lines) and not lines[after].strip():
            after += 1
        if after < len(lines) and (n := _ITEM.match(lines[after])) and abs(len(n[1]) - indent) < 2:
            i = after
    return Block("bullets" if bullets else "numbers", 0 if bullets else int(first[3]), items=tuple(items)), i


_TAGS = {"code": "code", "em": "em", "strong": "strong", "strike": "del"}


def _xhtml_spans(some: tuple[Span, ...]) -> str:
    out = []
    for s in some:
        x = escape(s.text)
        for mark, tag in _TAGS.items():
            x = f"<{tag}>{x}</{tag}>" if mark in s.marks else x
        out.append(f'<a href="{escape(s.href)}">{x}</a>' if s.href else x)
    return "".join(out)


def xhtml(blocks: tuple[Block, ...], tight: bool = False) -> list[str]:
    """An element for each block; tight: paragraphs without tags, as in items of lists."""
    out = []
    for b in blocks:
        if b.kind == "heading":
            out.append(f"<h{b.number}>{_xhtml_spans(b.spans)}</h{b.number}>")
        elif b.kind == "para":
            out.append(_xhtml_spans(b.spans) if tight else f"<p>{_xhtml_spans(b.spans)}</p>")
        elif b.kind == "code":
            out.append(f"<pre><code>{escape(b.text)}</code></pre>")
        elif b.kind == "quote":
            out.append(f"<blockquote>{''.join(xhtml(b.items[0]))}</blockquote>")
        elif b.kind == "rule":
            out.append("<hr/>")
        else:
            tag, start = ("ul", "") if b.kind == "bullets" else ("ol", f' start="{b.number}"' if b.number != 1 else "")
            items = (xhtml(x, sum(y.kind == "para" for y in x) < 2) for x in b.items)
            out.append(f"<{tag}{start}>{''.join(f'<li>{"".join(x)}</li>' for x in items)}</{tag}>")
    return out


class Line(NamedTuple):
    """A paragraph of a format without nesting: style (Normal, Heading1 to 6, Quote, Code, List), depth of lists and quotes, marker."""

    style: str
    depth: int
    marker: str
    spans: tuple[Span, ...]


def flat(blocks: tuple[Block, ...], depth: int = 0, style: str = "Normal") -> list[Line]:
    """The tree as paragraphs, in order; the first one of an item has its marker."""
    out: list[Line] = []
    for b in blocks:
        if b.kind == "heading":
            out.append(Line(f"Heading{b.number}", depth, "", b.spans))
        elif b.kind == "para":
            out.append(Line(style, depth, "", b.spans))
        elif b.kind == "code":
            out.append(Line("Code", depth, "", (Span(b.text, frozenset({"code"})),)))
        elif b.kind == "rule":
            out.append(Line(style, depth, "", (Span("* * *"),)))
        elif b.kind == "quote":
            out += flat(b.items[0], depth + 1, "Quote")
        else:
            for k, item in enumerate(b.items):
                marker = "•" if b.kind == "bullets" else f"{b.number + k}."
                first, *rest = flat(item, depth + 1, "List") or [Line("List", depth + 1, "", ())]
                # An item that begins with a list has its marker on a line of its own.
                out += [Line("List", depth + 1, marker, ()), first] if first.marker else [first._replace(marker=marker)]
                out += rest
    return out


def docx_paragraphs(blocks: tuple[Block, ...]) -> list[str]:
    """A w:p element for each paragraph, with the marks as properties of runs and links as fields."""
    out = []
    for style, depth, marker, some in flat(blocks):
        indent = f'<w:ind w:left="{360 * depth}"{" w:hanging=" + chr(34) + "360" + chr(34) if marker else ""}/>' if depth else ""
        runs = [f'<w:r><w:t xml:space="preserve">{escape(marker)}</w:t></w:r><w:r><w:tab/></w:r>'] if marker else []
        for s in some:
            props = "".join(x for mark, x in (("code", '<w:rFonts w:ascii="Courier New" w:hAnsi="Courier New"/>'), ("strong", "<w:b/>"), ("em", "<w:i/>"), ("strike", "<w:strike/>")) if mark in s.marks)
            body = "<w:br/>".join(f'<w:t xml:space="preserve">{escape(x)}</w:t>' for x in s.text.split("\n"))
            run = f"<w:r>{f'<w:rPr>{props}</w:rPr>' if props else ''}{body}</w:r>"
            runs.append(f'<w:fldSimple w:instr=" HYPERLINK &quot;{escape(s.href)}&quot; ">{run}</w:fldSimple>' if s.href else run)
        out.append(f'<w:p><w:pPr><w:pStyle w:val="{style}"/>{indent}</w:pPr>{"".join(runs)}</w:p>')
    return out


def rtf_text(text: str) -> str:
    """Text of a Rich Text body: control characters escaped, others than ASCII by their UTF-16 units."""
    out = []
    for c in text:
        if c in "\\{}":
            out.append("\\" + c)
        elif c == "\n":
            out.append("\\line ")
        elif ord(c) < 128:
            out.append(c)
        else:
            raw = c.encode("utf-16-le", "surrogatepass")
            out += [f"\\u{int.from_bytes(raw[k : k + 2], 'little', signed=True)}?" for k in range(0, len(raw), 2)]
    return "".join(out)


def rtf_paragraphs(blocks: tuple[Block, ...]) -> list[str]:
    """A group for each paragraph."""
    out = []
    for style, depth, marker, some in flat(blocks):
        look = f"\\b\\fs{36 - 2 * int(style[7:])}" if style.startswith("Heading") else "\\i" if style == "Quote" else ""
        place = (f"\\li{360 * depth}" if depth else "") + ("\\fi-360" if marker else "")
        body = f"{rtf_text(marker)}\\tab " if marker else ""
        for s in some:
            marks = "".join(x for mark, x in (("strong", "\\b"), ("em", "\\i"), ("strike", "\\strike"), ("code", "\\f1")) if mark in s.marks)
            run = f"{{{marks} {rtf_text(s.text)}}}" if marks else rtf_text(s.text)
            body += f'{{\\field{{\\*\\fldinst HYPERLINK "{rtf_text(s.href)}"}}{{\\fldrslt {run}}}}}' if s.href else run
        out.append(f"{{\\pard{place}{look} {body}\\par}}")
    return out


def plain(blocks: tuple[Block, ...]) -> str:
    """Paragraphs with a blank line between them, list items one below the other, indented."""
    out = ""
    before = ""
    for style, depth, marker, some in flat(blocks):
        own = "  " * max(0, depth - 1) + (marker + " " if marker else "") + "".join(s.text for s in some)
        out += ("\n" if style == before == "List" else "\n\n") + own if out else own
        before = style
    return out
