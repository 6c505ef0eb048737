"""Web pages to blocks, on odd markup."""

import re
from html import unescape

import pytest

from lorekeep.sources import html


def shape(items):
    def one(i):
        name = {"list": "OL" if i.attrs.get("ordered") else "UL", "quote": "Q", "rule": "HR"}.get(i.kind, f"{i.kind[0]}:{i.text}")
        inner = ["|".join(map(one, part)) for part in i.parts]
        cells = [";".join(",".join("/".join(c) for c in row) for row in i.attrs["cells"])] if i.kind == "table" else []
        return name + (f"({','.join(inner + cells)})" if inner or cells else "")

    return " ".join(map(one, items))


@pytest.mark.parametrize(("markup", "expected"), [
    ("<h1>A</h1><p>one<p>two<br>lines <b>bold</b></p>loose", "h:A p:one p:two lines bold p:loose"),
    ("<ul><li>a<li>b<ol><li>c</ol><li>d</ul>x", "UL(p:a,p:b|OL(p:c),p:d) p:x"),
    ("<li>lost</li></ul></p></td>after", "UL(p:lost) p:after"),
    ("<ul>bare<li>a</li></ul>", "UL(p:bare,p:a)"),
    ("<blockquote>said<p>more</p></blockquote><hr/><pre>  x\n y</pre>", "Q(p:said|p:more) HR c:  x\n y"),
    ("<table><tr><th>h<td>1<tr><td><p>a<p>b</td><td><ul><li>i</ul></table>end", "t:[table](h,1;a/b,i) p:end"),
    ("<head><title>t</title><style>p{}</style></head><script>var t='</p>'</script><p>&amp; &lt;b&gt;</p>", "p:& <b>"),
    ("<p>let <math><mi>x</mi><mo/></math> be", "p:let <math><mi>x</mi><mo/></math> be"),
    ("<div><div>in</div>out</div><img src='i.png'>", "p:in p:out i:i.png"), ("", ""), ("<", "p:<"), ("<p", "p:<p"), ("</", "p:</"),
])
def test_items(markup, expected):
    assert shape(html.page_items(markup)) == expected


def test_read_pages(spark):
    pages = spark.createDataFrame([(1, "<h1>T</h1><p>a</p><h2>U</h2><ul><li>i</li></ul>"), (2, None), (3, "<div class='x'>z</div>"), (4, "<div><math></math></div>")], "page_id long, html string")
    rows = html.read_pages(pages).orderBy("doc_id", "uid").collect()
    assert [(r.doc_id, r.depth, r.kind, r.text) for r in rows] == [("1", 1, "heading", "T"), ("1", 2, "paragraph", "a"), ("1", 2, "heading", "U"), ("1", 3, "list", ""), ("1", 4, "list_item", ""), ("1", 5, "paragraph", "i"), ("3", 1, "paragraph", "z"), ("4", 1, "paragraph", "<math></math>")]
    whole = {r.doc_id: (r.kind, r.text) for r in html.read_pages(pages.where("page_id > 2"), complex_as_code=True).collect()}
    assert whole == {"3": ("code", "<div class='x'>z</div>"), "4": ("paragraph", "<math></math>")}


def test_no_text_is_lost(spark):
    """All that a page shows is in its blocks, in order."""
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    for r in pages.collect():
        shown = re.sub(r"<(script|style|title)\b.*?</\1>|<!--.*?-->", " ", r.html, flags=re.S)
        shown = unescape(re.sub(r"<[^>]*>", " ", shown))
        texts = [t for t in html._texts(html.page_items(r.html)) if t != "[table]"]
        assert " ".join(texts).split() == shown.split()


def test_pages_are_read_one_at_a_time(spark):
    """Blocks are handed on before all pages of a batch are read."""
    import pyarrow as pa

    class Pages:
        def select(self, *_):
            return self

        def mapInArrow(self, run, _):  # noqa: N802
            return run

    n = 200
    pages = pa.record_batch({"doc_id": [str(i) for i in range(n)], "html": [None if i == 7 else "<h2>a</h2><p>b</p>" * 40 for i in range(n)], "whole": [False] * n})
    found = list(html.read_pages(Pages())(iter([pages])))
    assert max(b.num_rows for b in found) <= html._ROWS and sum(b.num_rows for b in found) == 80 * (n - 1)
    assert found[0]["doc_id"][0].as_py() == "0" and found[-1]["kind"][-1].as_py() == "paragraph"
