"""Word documents made in memory."""

import io
import zipfile

import pytest

from lorekeep.sources import docx

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def para(text, style=None, num=None, extra="", level=0):
    props = (f'<w:pStyle w:val="{style}"/>' if style else "") + (f'<w:numPr><w:ilvl w:val="{level}"/><w:numId w:val="{num}"/></w:numPr>' if num else "")
    return f"<w:p><w:pPr>{props}</w:pPr><w:r><w:t>{text}</w:t></w:r>{extra}</w:p>"


def archive(body):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {W}><w:body>{body}</w:body></w:document>")
        z.writestr("word/styles.xml", f'<w:styles {W}>' + "".join(f'<w:style w:styleId="H{i}"><w:name w:val="heading {i}"/></w:style>' for i in range(1, 5)) + "</w:styles>")
        z.writestr("word/numbering.xml", f'<w:numbering {W}><w:abstractNum w:abstractNumId="9"><w:lvl w:ilvl="0"><w:numFmt w:val="bullet"/></w:lvl></w:abstractNum><w:num w:numId="1"><w:abstractNumId w:val="9"/></w:num></w:numbering>')
        z.writestr("word/comments.xml", f'<w:comments {W}><w:comment w:id="7"><w:p><w:r><w:t>note</w:t></w:r></w:p></w:comment></w:comments>')
    return out.getvalue()


def shape(node):
    return node.text + ("(" + ", ".join(shape(k) for k in node.kids) + ")" if node.kids else "")


def headings(*levels, nesting="reference"):
    return shape(docx.parse(archive("".join(para(f"h{n}", f"H{n}") for n in levels)), nesting))


def test_heading_nesting():
    assert headings(1, 2, 3) == "(h1, h2, h3)"
    assert headings(1, 3) == "(h1(h3))"
    assert headings(1, 3, 2) == "(h1(h3), h2)"
    assert headings(1, 4, 2, 4) == "(h1(h4), h2(h4))"
    assert headings(1, 2, 3, nesting="strict") == "(h1(h2(h3)))"


def test_paragraphs_and_lists():
    body = para("1) Foo") + para("a") + para("i1", num=1) + para("i2", num=1) + para("1. Bar") + "<w:tbl><w:tr><w:tc>" + para("cell") + "</w:tc></w:tr></w:tbl>"
    assert shape(docx.parse(archive(body))) == "(Foo(a(((i1), (i2))), 1. Bar, [table](((cell)))))"
    assert docx.stable_id("", "Intro") == "79a393145a7a"


def test_golden_vectors():
    """Paths, keys and shapes of the survey."""
    def walk(*levels):
        sections = docx.Sections()
        sections.add_all([docx.Item("heading", f"h{n}", n) for n in levels])
        return sections.path

    assert walk(1, 2, 3) == [1, 1, 1] and walk(1, 3, 2) == [1, 2] and walk(1, 3) == [1, 1] and walk(3) == [1]
    assert docx.Sections().root.key == "583c3703b4e2"
    P, L = (lambda t: docx.Item("paragraph", t)), (lambda *parts: docx.Item("list", parts=[list(p) for p in parts]))
    name = lambda n: (n.text or {"list": "LIST", "list_item": "LI", "apart": "TMP"}.get(n.kind, n.kind)) + ("(" + ",".join(map(name, n.kids)) + ")" if n.kids else "")
    shown = lambda items, **k: ",".join(map(name, docx.fold(items, **k).kids))
    h1 = docx.Item("heading", "H1", 1)
    assert shown([h1, P("a"), L([P("i1"), P("1) PROMO"), P("i2")]), P("after")]) == "H1(a,TMP(i1),LIST(LI(i2))),after"
    assert shown([h1, P("a"), L([P("i1"), P("1) PROMO"), P("i2")]), P("after")], nesting="strict") == "H1(a(LIST(LI(i1,PROMO(i2)))),after)"
    assert shown([P("a"), L([P("x")]), L([P("y")])]) == "a(LIST(LI(x)),LIST(LI(y)))"
    assert shown([docx.Item("quote", parts=[[P("q"), P("r")]])]) == "quote(q,r)"
    keys = docx.fold([P("x" * 70), h1, P("y"), docx.Item("code", "c" * 60), docx.Item("rule")])
    assert [k.key for k in keys.kids] == [docx.stable_id("", "x" * 64), docx.stable_id("", "H1")]
    assert [k.key for k in keys.kids[1].kids] == [docx.stable_id("1", "y"), docx.stable_id("1", "c" * 48), docx.stable_id("1", "hr")]
    assert [n.level for n in docx.fold([P("2.3 Deep")], levels="groups").kids] == [2] and [n.level for n in docx.fold([P("2.3 Deep")]).kids] == [1]
    assert docx.fold([P("2.3 Deep")], promote=False).kids[0].kind == "paragraph"


def test_flow_of_a_file():
    run = lambda t: f"<w:r>{t}</w:r>"
    body = (
        para("My title", "Title") + para("Ann", "Author") + para("Bob", "Author") + "<w:p>" + run("<w:t>a</w:t><w:br/><w:t>b</w:t><w:tab/><w:t>c</w:t>") + "</w:p>"
        + "<w:sdt><w:sdtContent>" + para("inside") + "</w:sdtContent></w:sdt>" + '<w:p><w:pPr><w:outlineLvl w:val="1"/></w:pPr><w:r><w:t>by outline</w:t></w:r></w:p>'
        + para("said", "Quote") + para("x = 1", "Source Code") + para("Late title", "Title")
    )
    root = docx.parse(archive(body))
    assert [k.text for k in root.kids] == ["a b c", "inside", "by outline"] and root.kids[2].level == 2
    assert [(k.kind, k.text) for k in root.kids[2].kids] == [("quote", ""), ("code", "x = 1"), ("paragraph", "Late title")]


def test_paragraphs_meta_and_enrichment(spark, tmp_path):
    tracked = '<w:ins><w:r><w:t> new</w:t></w:r></w:ins><w:del><w:r><w:delText> old</w:delText></w:r></w:del>'
    (tmp_path / "a.docx").write_bytes(archive(para("T", "Title") + para("H", "H1") + para("p1", extra=tracked) + para("p2", num=1)))
    (tmp_path / "b.docx").write_bytes(b"no zip")
    files = spark.read.format("binaryFile").load(str(tmp_path))
    info = docx.read_paragraphs(files)
    got = info.where("error IS NULL").orderBy("uid").collect()
    assert [(r.uid, r.kind, r.text, r.style, r.inserted, r.deleted) for r in got][2] == (2, "paragraph", "p1", None, " new", " old")
    assert got[1].style == "heading 1" and got[3].kind == "list_item" and info.where("error IS NOT NULL").count() == 1
    meta = {r.doc_id[-6:]: r for r in docx.decorate(docx.document_meta(files)).collect()}
    assert meta["a.docx"].title == "T" and meta["a.docx"].format == "docx" and meta["b.docx"].title is None
    auto = docx.read_documents(files, mode="auto")
    assert auto.where("error LIKE 'fold: %; xml: %'").count() == 1
    flat = docx.read_documents(files, mode="xml").where("error IS NULL").orderBy("uid").collect()
    assert [r.text for r in flat] == ["T", "H", "p1", "p2"] and all(r.depth == 1 for r in flat)
    blocks = spark.createDataFrame([("d", 1, "000001", "heading"), ("d", 2, "000001.000001", "paragraph"), ("d", 3, "000001.000002", "paragraph")], "doc_id string, uid int, path string, kind string")
    told = spark.createDataFrame([("d", i, "paragraph", "t", s, s, i, 0, "f", "l", None) for i, s in enumerate(["H1", "p1", "p2"])], "doc_id string, uid int, kind string, text string, style_id string, style string, num_id int, list_level int, num_format string, level_text string, error string")
    styles = lambda **k: [r.style for r in docx.enrich(blocks, told, by="place", **k).orderBy("uid").collect()]
    assert styles() == ["H1", "p1", "p2"] and styles(order="after") == ["p2", "H1", "p1"]
    assert "level_text" in docx.enrich(blocks, told, "full", "place").columns and "style" not in docx.enrich(blocks, told, "none", "place").columns
    rows = docx.child_rows(docx.read_documents(files)).orderBy("key").collect()
    assert [r.kind for r in rows] == ["heading", "paragraph", "list", "list_item", "paragraph"] and rows[0].parent is None and rows[1].parent == rows[0].key and '"stable_id"' in rows[0].attrs
    assert docx.images(docx.read_documents(files)).count() == 0


def test_lists_by_level():
    """Three levels, a number of its own, a jump, and lists parted by other paragraphs."""
    item = lambda t, level=0, num=1: para(t, num=num, level=level)
    name = lambda n: (n.text or {"list": "L", "list_item": "I"}.get(n.kind, n.kind)) + ("(" + ",".join(map(name, n.kids)) + ")" if n.kids else "")
    shown = lambda body: ",".join(map(name, docx.parse(archive(body), promote=False).kids))
    # a list within an item hangs under the item's paragraph, as one after a paragraph does
    assert shown(item("a") + item("b", 1) + item("c", 2) + item("d", 1) + item("e")) == "L(I(a(L(I(b(L(I(c)))),I(d)))),I(e))"
    assert shown(item("a") + item("b", 2) + item("c", 1)) == "L(I(a(L(I(b)),L(I(c)))))"
    assert shown(item("a", 1) + item("b")) == "L(I(a)),L(I(b))"
    assert shown(item("a") + item("b", 0, 2) + item("c", 1, 2)) == "L(I(a)),L(I(b(L(I(c)))))"
    assert shown(item("a") + para("p") + item("b")) == "L(I(a)),p(L(I(b)))" and shown(item("a") + para("") + item("b")) == "L(I(a),I(b))"


def test_enrichment_by_source(spark, tmp_path):
    """Titles, code and cells do not shift the styles of what follows them."""
    table = lambda *cells: "<w:tbl><w:tr>" + "".join(f"<w:tc>{para(c, 'CS')}</w:tc>" for c in cells) + "</w:tr></w:tbl>"
    (tmp_path / "a.docx").write_bytes(archive(para("T", "Title") + para("h", "H1") + para("p1", "S1") + table("c1", "c2") + para("") + para("p2", "S2") + para("i", "S3", num=1)))
    (tmp_path / "b.docx").write_bytes(archive(para("h", "H1") + para("code", "Source Code") + para("p1", "S1") + para("p2", "S2")))
    files = spark.read.format("binaryFile").load(str(tmp_path))
    rich = docx.enrich(docx.read_documents(files), docx.read_paragraphs(files), "full")
    got = {(r.doc_id[-6:], r.text): r.style_id for r in rich.collect() if r.text}
    assert got == {
        ("a.docx", "h"): "H1", ("a.docx", "p1"): "S1", ("a.docx", "[table]"): None, ("a.docx", "c1"): "CS", ("a.docx", "c2"): "CS", ("a.docx", "p2"): "S2", ("a.docx", "i"): "S3",
        ("b.docx", "h"): "H1", ("b.docx", "code"): "Source Code", ("b.docx", "p1"): "S1", ("b.docx", "p2"): "S2",
    }
    assert [r.num_id for r in rich.where("kind = 'list_item'").collect()] == [1]
    with pytest.raises(ValueError):
        docx.enrich(rich, rich, by="luck")


def test_text_of_runs():
    link = '<w:hyperlink><w:r><w:t> link</w:t></w:r></w:hyperlink><w:ins><w:r><w:t> new</w:t></w:r></w:ins><w:del><w:r><w:delText> old</w:delText></w:r></w:del><w:r><w:commentReference w:id="7"/></w:r>'
    root = docx.parse(archive(para("t", extra=link)))
    assert root.kids[0].text == "t link new" and root.kids[0].attrs["comment"] == "note"


def test_read_documents(spark, tmp_path):
    (tmp_path / "a.docx").write_bytes(archive(para("T", "H1") + para("b") + para("i", num=1)))
    (tmp_path / "b.docx").write_bytes(b"no zip")
    (tmp_path / "c.docx").write_bytes(archive(""))
    rows = docx.read_documents(spark.read.format("binaryFile").load(str(tmp_path)))
    good = rows.where("error IS NULL").orderBy("uid").collect()
    assert [(r.uid, r.parent_uid, r.depth, r.kind, r.text) for r in good] == [(1, None, 1, "heading", "T"), (2, 1, 2, "paragraph", "b"), (3, 2, 3, "list", ""), (4, 3, 4, "list_item", ""), (5, 4, 5, "paragraph", "i")]
    assert good[3].num_format == "bullet"
    assert rows.where("error IS NOT NULL").count() == 1
    lines = [r.line for r in docx.pretty(rows).orderBy("uid").collect()]
    assert lines[0] == "• Heading: T" and lines[4] == "        • Paragraph: i"


def test_merge_attributes(spark):
    schema = "uid int, style string, classes array<string>, attrs map<string,string>"
    own = spark.createDataFrame([(1, None, [], {"a": "1"}), (2, "s", ["x"], {})], schema)
    other = spark.createDataFrame([(1, "o", ["y"], {"a": "2", "b": "3"})], schema)
    rows = {r.uid: r for r in docx.merge_attributes(own, other, ["uid"]).orderBy("uid").collect()}
    assert rows[1].style == "o" and rows[1].classes == ["y"] and rows[1].attrs == {"a": "1", "b": "3"}
    assert rows[2].style == "s" and rows[2].classes == ["x"] and rows[2].attrs == {}
