"""The text and headers of derived records, against a plain reading of the same pages."""

import html
import re

import pytest
from pyspark.sql import functions as F

from cairn.llm import warc

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize(
    "page, text",
    [
        ('a<script>if("</style>")secret()</script>b', "a b"),
        ('a<style>x{content:"</script>"}</style >b', "a b"),
        ('a<!-- <script> -->b<SCRIPT src="x">c</ScRiPt>d', "a b d"),
        ('a<script>"<!--"</script>b<!-- c', "a b"),
        ("a<script>never closed", "a"),
        ("a<scripture>b</scripture>c", "abc"),
        ("&#233;&eacute;&#xE9;&#xe9; &copy;&middot;&#128512;&#x1F600;", "éééé ©·😀😀"),
        ("&amp;lt; &lt;b&gt; &unknown; &#0; &#xD800; &#9999999; & &; &#;", "&lt; <b> &unknown; &#0; &#xD800; &#9999999; & &; &#;"),
        ("a&nbsp;&nbsp;b \t\r\n\n c<br/>d<p class='x'>e</p>\n\n<pre>f", "a b\nc\nd\ne\nf"),
        ("1 < 2 <b>x</b> <3 >4", "1 < 2 x <3 >4"),
        ("", ""),
        ("<p></p>", ""),
    ],
)
def test_visible_text(spark, page, text):
    assert spark.createDataFrame([(page,)], "h string").select(warc.visible_text(F.col("h")).alias("t")).first().t == text


def brute(page):
    """A scan from left to right instead of patterns over the whole."""
    low, out, i = page.lower(), [], 0
    while i < len(page):
        if low.startswith("<!--", i):
            end = low.find("-->", i)
            i = len(page) if end < 0 else end + 3
            out.append(" ")
            continue
        m = re.match(r"<(script|style|noscript|template)(?:[\s/][^>]*)?>", low[i:])
        if m:
            end = re.compile(rf"</{m[1]}\s*>").search(low, i + m.end())
            i = len(page) if end is None else end.end()
            out.append(" ")
            continue
        out.append(page[i])
        i += 1
    flat = re.sub(rf"(?i)</?(?:{'|'.join(warc.BLOCKS)})(?:[\s/][^>]*)?>", "\n", "".join(out))
    flat = html.unescape(re.sub("(?i)<[!/a-z][^>]*>", "", flat))
    return "\n".join(x for line in flat.split("\n") if (x := " ".join(re.split("[\t\r\xa0 ]+", line)).strip()))


def test_given_pages(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    got = {r.page_id: r.block for r in warc.derive(pages).filter("warc_type = 'conversion'").collect()}
    assert got == {r.page_id: brute(r.html or "") for r in pages.collect()}


def test_source_headers(spark):
    rows = [(1, "http://a/", "<title> T &eacute;\n</title>x", "<urn:uuid:own>", "2020-02-02T00:00:00Z", "HTTP/1.1 200 OK\r\nServer: s\r\n"), (2, None, None, None, None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, rid string, at string, head string")
    got = {(r.page_id, r.warc_type): r for r in warc.derive(pages, "rid", "at", "head").collect()}
    one, two = got[1, "metadata"], got[2, "metadata"]
    for kind in ("metadata", "conversion"):
        h = dict(line.split(": ", 1) for line in got[1, kind].headers.split("\r\n")[1:-1])
        assert h["WARC-Refers-To"] == "<urn:uuid:own>" and h["WARC-Refers-To-Date"] == h["WARC-Date"] == "2020-02-02T00:00:00Z"
        assert h["WARC-Refers-To-Target-URI"] == h["WARC-Target-URI"] == "http://a/" and h["WARC-Source-Digest"] == got[1, kind].source_digest
        assert int(h["Content-Length"]) == len(got[1, kind].block.encode()) and h["WARC-Type"] == kind
    assert one.block.startswith("title: T é\r\nsource-length: ") and one.block.endswith("source-header: HTTP/1.1 200 OK\r\nsource-header: Server: s\r\n")
    assert got[1, "conversion"].record_id in one.block and "Target-URI" not in two.headers and warc.DATE in two.headers and "source-header" not in two.block
    assert not spark.catalog.listTables()
