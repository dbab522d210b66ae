"""Books as EPUB and DOCX files, rendered Markdown, licences, and run logs.

A book is one file, so each is made in one task of a grouped function; books are made in parallel. Files come as
binary columns for any sink.
"""

from __future__ import annotations

import io
import uuid
import zipfile
from collections.abc import Callable
from html import escape

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions import text as T
from . import markdown

#: Licence ids and the names they stand for.
LICENSES = {
    "all-rights-reserved": "All rights reserved",
    "cc-by": "Creative Commons Attribution 4.0 International",
    "cc-by-sa": "Creative Commons Attribution-ShareAlike 4.0 International",
    "cc-by-nc": "Creative Commons Attribution-NonCommercial 4.0 International",
    "cc-by-nc-sa": "Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International",
    "cc0": "CC0: no rights reserved",
    "public-domain": "Dedicated to the public domain",
}


def license_text(kind: str, author: str, year: int) -> str:
    """A notice for the copyright page; an unknown id counts as all rights reserved."""
    name = LICENSES.get(kind, LICENSES["all-rights-reserved"])
    if kind in ("cc0", "public-domain"):
        return f"{name}. The author, {author}, waives all claims as far as the law allows."
    end = "No part may be reproduced without permission." if name == LICENSES["all-rights-reserved"] else f"Licensed under {name}."
    return f"Copyright {year} {author}. {end}"


def render_markdown(text: str | None) -> str:
    """Markdown as XHTML, a line for each block."""
    return "\n".join(markdown.xhtml(markdown.parse(text)))


@F.pandas_udf(StringType())
def _render(text: pd.Series) -> pd.Series:
    return text.map(render_markdown)


def markdown_to_plain(c: Column) -> Column:
    """Markdown as plain text: rendered, then the tags taken out."""
    return T.html_to_plain(_render(c))


def _zip(entries: list[tuple[str, str]], stored: str | None = None) -> bytes:
    """An archive with fixed times, so that equal books are equal files; ``stored`` is not compressed."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, body in entries:
            z.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), body, zipfile.ZIP_STORED if name == stored else zipfile.ZIP_DEFLATED)
    return out.getvalue()


STYLE = "body { line-height: 1.5; margin: 5%; } h1 { page-break-before: always; text-align: center; } blockquote { font-style: italic; margin-left: 2em; } pre { white-space: pre-wrap; } .title, .copyright { text-align: center; }"
#: Names of the paragraph styles that DOCX bodies use, with the size in half points and what else they set.
DOCX_STYLES = {"Normal": (24, ""), "Title": (56, "<w:b/>"), "Quote": (24, "<w:i/>"), "Code": (20, ""), "List": (24, ""), **{f"Heading{k}": (38 - 3 * k, "<w:b/>") for k in range(1, 7)}}


def epub(title: str, author: str, chapters: list[tuple[str, str]], notice: str = "") -> bytes:
    """An EPUB 3 file of (title, Markdown) chapters with a title and a copyright page, a style sheet, a navigation document and an NCX for older readers."""

    def page(t: str, body: str, kind: str = "chapter") -> str:
        return f'<?xml version="1.0" encoding="utf-8"?>\n<html xmlns="http://www.w3.org/1999/xhtml"><head><title>{escape(t)}</title><link rel="stylesheet" type="text/css" href="style.css"/></head><body class="{kind}">{body}</body></html>'

    names = [f"chapter-{i + 1:03d}.xhtml" for i in range(len(chapters))]
    key = uuid.uuid5(uuid.NAMESPACE_URL, f"{title}/{author}")
    nav = "".join(f'<li><a href="{n}">{escape(t)}</a></li>' for n, (t, _) in zip(names, chapters, strict=True))
    points = "".join(f'<navPoint id="p{i}" playOrder="{i}"><navLabel><text>{escape(t)}</text></navLabel><content src="{n}"/></navPoint>' for i, (n, (t, _)) in enumerate(zip(names, chapters, strict=True), 1))
    ncx = f'<?xml version="1.0" encoding="utf-8"?>\n<ncx xmlns="http://www.daisy.org/z3986/2005/ncx/" version="2005-1"><head><meta name="dtb:uid" content="urn:uuid:{key}"/></head><docTitle><text>{escape(title)}</text></docTitle><navMap>{points}</navMap></ncx>'
    pages = ["title.xhtml", "copyright.xhtml", *names]
    items = "".join(f'<item id="c{i}" href="{n}" media-type="application/xhtml+xml"/>' for i, n in enumerate(pages))
    spine = "".join(f'<itemref idref="c{i}"/>' for i in range(len(pages)))
    opf = (
        '<?xml version="1.0" encoding="utf-8"?>\n<package xmlns="http://www.idpf.org/2007/opf" version="3.0" unique-identifier="id"><metadata xmlns:dc="http://purl.org/dc/elements/1.1/">'
        f'<dc:identifier id="id">urn:uuid:{key}</dc:identifier><dc:title>{escape(title)}</dc:title><dc:creator>{escape(author)}</dc:creator><dc:language>en</dc:language><dc:rights>{escape(notice)}</dc:rights></metadata>'
        '<manifest><item id="nav" href="nav.xhtml" media-type="application/xhtml+xml" properties="nav"/><item id="ncx" href="toc.ncx" media-type="application/x-dtbncx+xml"/>'
        f'<item id="style" href="style.css" media-type="text/css"/>{items}</manifest><spine toc="ncx">{spine}</spine></package>'
    )
    container = '<?xml version="1.0"?>\n<container version="1.0" xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="OEBPS/content.opf" media-type="application/oebps-package+xml"/></rootfiles></container>'
    entries = [("mimetype", "application/epub+zip"), ("META-INF/container.xml", container), ("OEBPS/content.opf", opf), ("OEBPS/toc.ncx", ncx), ("OEBPS/style.css", STYLE)]
    entries.append(("OEBPS/nav.xhtml", page(title, f'<nav xmlns:epub="http://www.idpf.org/2007/ops" epub:type="toc"><ol>{nav}</ol></nav>', "contents")))
    entries.append(("OEBPS/title.xhtml", page(title, f"<h1>{escape(title)}</h1><p>{escape(author)}</p>", "title")))
    entries.append(("OEBPS/copyright.xhtml", page(title, f"<p>{escape(notice)}</p>", "copyright")))
    entries += [(f"OEBPS/{n}", page(t, f"<h1>{escape(t)}</h1>{render_markdown(m)}")) for n, (t, m) in zip(names, chapters, strict=True)]
    return _zip(entries, stored="mimetype")


def _book(title: str, author: str, chapters: list[tuple[str, str]], notice: str) -> tuple[markdown.Block, ...]:
    """The chapters as blocks, each under its title, after author and notice."""
    line = lambda kind, s, n=0: markdown.Block(kind, n, (markdown.Span(s),))
    body = [line("para", author), line("para", notice)]
    for t, m in chapters:
        body += [line("heading", t, 1), *markdown.parse(m)]
    return tuple(body)


def docx(title: str, author: str, chapters: list[tuple[str, str]], notice: str = "") -> bytes:
    """A DOCX file: a title, then each chapter's title and its blocks, with the styles that they name."""
    head = f'<w:p><w:pPr><w:pStyle w:val="Title"/></w:pPr><w:r><w:t xml:space="preserve">{escape(title)}</w:t></w:r></w:p>'
    body = "".join([head, *markdown.docx_paragraphs(_book(title, author, chapters, notice))])
    space = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    styles = "".join(f'<w:style w:type="paragraph" w:styleId="{n}"{" w:default=" + chr(34) + "1" + chr(34) if n == "Normal" else ""}><w:name w:val="{n}"/><w:rPr>{x}<w:sz w:val="{size}"/></w:rPr></w:style>' for n, (size, x) in DOCX_STYLES.items())
    types = '<?xml version="1.0" encoding="UTF-8"?>\n<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/word/document.xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"/><Override PartName="/word/styles.xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.styles+xml"/></Types>'
    rels = lambda kind, to: f'<?xml version="1.0" encoding="UTF-8"?>\n<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/{kind}" Target="{to}"/></Relationships>'
    top = '<?xml version="1.0" encoding="UTF-8"?>\n'
    return _zip([
        ("[Content_Types].xml", types), ("_rels/.rels", rels("officeDocument", "word/document.xml")), ("word/_rels/document.xml.rels", rels("styles", "styles.xml")),
        ("word/styles.xml", f"{top}<w:styles {space}>{styles}</w:styles>"), ("word/document.xml", f"{top}<w:document {space}><w:body>{body}</w:body></w:document>"),
    ])


def rtf(title: str, author: str, chapters: list[tuple[str, str]], notice: str = "") -> bytes:
    """A Rich Text file of the same blocks."""
    fonts = "{\\fonttbl{\\f0\\froman Times New Roman;}{\\f1\\fmodern Courier New;}}"
    body = "\n".join([f"{{\\pard\\qc\\b\\fs48 {markdown.rtf_text(title)}\\par}}", *markdown.rtf_paragraphs(_book(title, author, chapters, notice))])
    return f"{{\\rtf1\\ansi\\uc1{fonts}\n{body}\n}}".encode("ascii")


def books_as(make: Callable[..., bytes], chapters: DataFrame, book: str = "book", title: str = "Book", author: str = "Unknown", notice: str = "") -> DataFrame:
    """(book, file binary): each book's chapters (book, ord, title, markdown) as one file of make, ``epub``, ``docx`` or ``rtf``."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("ord")
        return pd.DataFrame({book: [g[book].iloc[0]], "file": [make(f"{title} {g[book].iloc[0]}", author, list(zip(g["title"], g["markdown"], strict=True)), notice)]})

    return chapters.select(book, "ord", "title", "markdown").groupBy(book).applyInPandas(run, f"{book} {chapters.schema[book].dataType.simpleString()}, file binary")


def run_log(mode: Column, model: Column, at: Column, query: Column, retrieved: Column) -> Column:
    """A Markdown log of a run: settings, sizes of the inputs, query and retrieved context in fences."""
    block = lambda t, c: F.concat(F.lit(f"## {t}\n\n```text\n"), T.escape_fence(c), F.lit("\n```\n\n"))
    return F.concat(
        F.lit("# Run log\n\n- Mode: "), mode, F.lit("\n- Model: "), model, F.lit("\n- Time: "), F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit("\n- Query hash: "), T.fnv1a32(query),
        F.lit("\n- Context: "), F.length(T.text(retrieved)).cast("string"), F.lit(" chars\n\n"), block("Query", query), block("Retrieved context", retrieved),
    )
