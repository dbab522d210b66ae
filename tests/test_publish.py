"""Files and rendering."""

import io
import re
import xml.dom.minidom
import zipfile

from pyspark.sql import functions as F

from loomtext.operators import markdown, publish


def test_markdown():
    html = publish.render_markdown("# A & B\nfirst *one*\n\n- x\n- **y**\n\n```\n<c>\n```\n\n> q\n\n[t](u)")
    assert html.split("\n") == ["<h1>A &amp; B</h1>", "<p>first <em>one</em></p>", "<ul><li>x</li><li><strong>y</strong></li></ul>", "<pre><code>&lt;c&gt;</code></pre>", "<blockquote><p>q</p></blockquote>", '<p><a href="u">t</a></p>']
    assert publish.render_markdown(None) == ""


def test_plain(spark):
    df = spark.createDataFrame([("# T\n\na & b\n\n- x\n- y",)], "m string")
    assert df.select(publish.markdown_to_plain(F.col("m")).alias("p")).first()["p"] == "T\na & b\nx\ny"


def test_files(spark):
    c = spark.createDataFrame([(1, 1, "Two", "b"), (1, 0, "One <1>", "a & b"), (2, 0, "Solo", None)], "book int, ord int, title string, markdown string")
    for make in (publish.epub, publish.docx):
        got = {r["book"]: bytes(r["file"]) for r in publish.books_as(make, c, notice=publish.license_text("cc-by", "Ann", 2024)).collect()}
        z = zipfile.ZipFile(io.BytesIO(got[1]))
        assert z.testzip() is None and len(got) == 2
        for name in z.namelist():
            if name != "mimetype" and not name.endswith(".css"):
                xml.dom.minidom.parseString(z.read(name))
        text = b"".join(z.read(n) for n in z.namelist()).decode()
        assert text.index("One &lt;1&gt;") < text.index("Two") and "a &amp; b" in text
        if make is publish.epub:
            assert z.namelist()[0] == "mimetype" and z.infolist()[0].compress_type == zipfile.ZIP_STORED
    assert publish.license_text("nothing", "A", 1) == publish.license_text("all-rights-reserved", "A", 1)


TREE = """Intro with **bold *both***, `a*b`, ~~old~~ and [a *link*](http://x/?a=1&b=2).

- one
  more
  - two
    1. three
    2. four

  second paragraph
- five

3. c
4. d

> quote
> - in it

~~~
code <x>
  kept
~~~
***
\\*plain\\* snake_case_name 2*3
"""


def test_tree_as_xhtml():
    assert publish.render_markdown(TREE).split("\n<") == [
        '<p>Intro with <strong>bold </strong><strong><em>both</em></strong>, <code>a*b</code>, <del>old</del> and <a href="http://x/?a=1&amp;b=2">a </a><a href="http://x/?a=1&amp;b=2"><em>link</em></a>.</p>',
        "ul><li><p>one\nmore</p><ul><li>two<ol><li>three</li><li>four</li></ol></li></ul><p>second paragraph</p></li><li>five</li></ul>",
        'ol start="3"><li>c</li><li>d</li></ol>',
        "blockquote><p>quote</p><ul><li>in it</li></ul></blockquote>",
        "pre><code>code &lt;x&gt;\n  kept</code></pre>",
        "hr/>",
        "p>*plain* snake_case_name 2*3</p>",
    ]


def test_tree_as_plain_and_flat():
    blocks = markdown.parse(TREE)
    lines = markdown.flat(blocks)
    assert [(x.style, x.depth, x.marker) for x in lines] == [
        ("Normal", 0, ""), ("List", 1, "•"), ("List", 2, "•"), ("List", 3, "1."), ("List", 3, "2."), ("List", 1, ""), ("List", 1, "•"), ("List", 1, "3."), ("List", 1, "4."),
        ("Quote", 1, ""), ("List", 2, "•"), ("Code", 0, ""), ("Normal", 0, ""), ("Normal", 0, ""),
    ]
    assert markdown.plain(markdown.parse("# T\n\na\n\n- x\n  - y\n- z")) == "T\n\na\n\n• x\n  • y\n• z"
    assert markdown.parse(None) == () and markdown.parse(" \n\n") == () and markdown.plain(()) == ""
    deep = markdown.parse("\n".join("  " * k + f"- {k}" for k in range(40)) + "\n" + ">" * 500 + " q")
    assert all(str(k) in markdown.plain(deep) for k in range(40))


def test_docx_and_rtf_have_the_marks():
    doc = zipfile.ZipFile(io.BytesIO(publish.docx("T", "A", [("C é", TREE)])))
    for name in doc.namelist():
        xml.dom.minidom.parseString(doc.read(name))
    body, styles = doc.read("word/document.xml").decode(), doc.read("word/styles.xml").decode()
    assert all(f'w:styleId="{s}"' in styles for s in re.findall(r'w:pStyle w:val="(\w+)"', body))
    assert '<w:rPr><w:b/><w:i/></w:rPr><w:t xml:space="preserve">both</w:t>' in body and "HYPERLINK &quot;http://x/?a=1&amp;b=2&quot;" in body
    assert '<w:ind w:left="1080" w:hanging="360"/></w:pPr><w:r><w:t xml:space="preserve">2.</w:t></w:r><w:r><w:tab/></w:r><w:r><w:t xml:space="preserve">four</w:t>' in body
    rich = publish.rtf("T", "A", [("C é 😀", TREE + "\n{b} \\\\ c")]).decode()
    assert "C \\u233? \\u-10179?\\u-8704?" in rich and "{\\b\\i both}" in rich and "{\\f1 a*b}" in rich and "\\li1080\\fi-360 2.\\tab four" in rich and "\\{b\\} \\\\ c" in rich
    plain = re.sub(r"\\[\\{}]", "", rich)
    assert plain.count("{") == plain.count("}")


def test_epub_parts():
    z = zipfile.ZipFile(io.BytesIO(publish.epub("B", "A", [("One", "x"), ("Two & 3", TREE)], "All mine")))
    opf = z.read("OEBPS/content.opf").decode()
    assert sorted(re.findall(r'href="([^"]+)"', opf)) == sorted(n[6:] for n in z.namelist() if n.startswith("OEBPS/") and n != "OEBPS/content.opf")
    assert re.findall(r"<text>([^<]*)</text>", z.read("OEBPS/toc.ncx").decode()) == ["B", "One", "Two &amp; 3"] and b"All mine" in z.read("OEBPS/copyright.xhtml")
    assert '<spine toc="ncx">' in opf and b'href="style.css"' in z.read("OEBPS/chapter-002.xhtml")


def test_marks_that_are_never_closed_are_text():
    for mark in ("**a ", "*a ", "__a ", "~~a ", "[", "_a ", "- x\n", "> ", "```\n", "***"):
        text = mark * 20_000
        assert markdown.plain(markdown.parse("x " + text)).startswith("x")
    assert publish.render_markdown("**a **b and *c") == "<p>**a **b and *c</p>"
    assert publish.render_markdown("***a* b** ~~c *d*~~") == "<p><strong><em>a</em></strong><strong> b</strong> <del>c </del><del><em>d</em></del></p>"
