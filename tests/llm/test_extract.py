"""op11: pages of known content, votes of hosts, odd markup, and the whole query against a plain version over the driver's pages."""

import html
import re
from pathlib import Path

import pytest

pytest.importorskip("sievework.llm")

from pyspark.sql import functions as F  # noqa: E402

from sievework.llm import extract, queries  # noqa: E402

PAGES = "page_id long, url string, html string"
FOLDER = Path("/root/testdata/sf0.001")


def best(source):
    page = extract.Page(source)
    return page.text([page.best()])


LONG = "Some words of an article that goes on for a while. " * 6
SITE = """<html><head><title>T &amp; t</title><style>p{{x}}</style><script>var a = "<p>no</p>";</script></head><body class="has-sidebar">
<header><h2>Site name</h2><nav><ul><li><a href="/">Home</a><li><a href=/x>More</a></ul></nav></header>
<div class="cookie-notice">We use cookies.</div><div id="sidebar"><p>About us and our friends.</p></div>
<div class="page wrap-7"><main><article class="post-{n}"><header><h1>Title {n}</h1></header>
<p>{text}</p><div class="adSlot"><p>Buy now!</p></div><p>A <b>bold</b> &eacute;nd &lt;tag&gt;<br>next&nbsp;line
of it<ul><li>one<li>two</ul><form><input><label>Mail</label></form><aside>Read also</aside>
<div class="share social"><a href="#">Share</a></div></article>
<section id="comments"><h3>Comments</h3><article class="comment"><p>I disagree with all of this. {text}</p></article></section></main></div>
<footer>&copy; us</footer></body></html>"""


def wanted(n, text=LONG):
    return f"Title {n}\n{text.strip()}\nA bold énd <tag> next line of it\none\ntwo"


def test_article_alone():
    assert best(SITE.format(n=3, text=LONG)) == wanted(3)
    assert extract.vote(SITE.format(n=3, text=LONG))[0] == "body/div.page.wrap-0/main/article.post-0"


@pytest.mark.parametrize(
    "source,text",
    [
        ("", ""),
        ("no markup  at all\n", "no markup at all"),
        ("a < b && c > d", "a < b && c > d"),
        ("<p>one<p>two<br>three", "one\ntwo three"),
        ("<div>a<div>b</div>c", "a\nb\nc"),
        ("<p>x<!-- <p>y</p> --></p><!-- z", "x"),
        ("<p>x</p><script>if (a < b) document.write('<p>y</p>')</script><p>z", "x\nz"),
        ("<p>x</p><script>never ended <p>y</p>", "x"),
        ("<table><tr><td>a<td>b<tr><td>c</table>", "a\nb\nc"),
        ('<p title="a > b">x</p><p title=it\'s>y</p><p title="open>z', "x\ny\nz"),
        ("<p>x</span></div></p></p>y", "x\ny"),
        ("<p>&#233;&#xe9;&eacute &amp;amp; &bogus; &am", "ééé &amp; &bogus; &am"),
        ("<P>Upper<BR/>case</P><IMG SRC=x><HR>", "Upper case"),
        ('<p>x</p><p hidden>y</p><div style="display: none"><p>z</p></div>', "x"),
        ("<form><h1>Title</h1><p>" + LONG + "</p></form>", "Title\n" + LONG.strip()),
        ("<nav><p>only a menu</p></nav>", ""),
    ],
)
def test_markup(source, text):
    assert best(source) == text


def test_deep_and_long_pages():
    assert best("<div>" * 20_000 + "x") == "x"
    assert best("<b>" * 20_000 + "<i>x</i>" * 2000) == "x" * 2000
    assert best("<p>word" * 50_000).count("\n") == 49_999
    assert best("<p>" + "long " * 300_000) == ("long " * 300_000).strip()


def host(name, k, source):
    return (k, f"https://user@{name}:8080/{k}", source)


def test_hosts_agree_on_a_path(spark):
    """A page whose comments are longer than its article keeps the article, as its host's other pages say."""
    page = lambda n, text, other: f'<div class="b{n}"><h1>T</h1><p>{text}</p></div><div class="r"><p>{other}</p></div>'
    rows = [host("A.example", k, page(k, LONG, "short")) for k in range(5)] + [host("a.example", 9, page(9, "Brief.", LONG * 3))]
    rows += [host("b.example", 20, page(1, "Brief.", LONG * 3)), (30, None, page(1, "Brief.", LONG)), (31, "not a url", page(1, LONG, "x")), (32, "", None), host("a.example", 33, "<p>Other kind of page.</p>"), host("a.example", 34, "")]
    df = spark.createDataFrame(rows, PAGES).repartition(3)
    found = {r["page_id"]: r["text"] for r in extract.extract_texts(df).collect()}
    assert found[9] == "T\nBrief."
    assert found[0] == f"T\n{LONG.strip()}"
    assert found[20] == (LONG * 3).strip()
    assert found[30] == LONG.strip()
    assert found[31] == f"T\n{LONG.strip()}"
    assert (found[32], found[33], found[34]) == ("", "Other kind of page.", "")
    paths = {r["host"]: (r["path"], r["votes"], r["pages"]) for r in extract.host_paths(df).collect()}
    assert paths["a.example"] == ("body/div.b0", 5, 7)
    assert paths["b.example"] == ("body/div.r", 1, 1)


def test_ties_go_to_the_smaller_path(spark):
    rows = [host("c.example", k, f'<div class="{c}"><p>{LONG}</p></div>') for k, c in enumerate("ba")]
    assert extract.host_paths(spark.createDataFrame(rows, PAGES)).first()["path"] == "body/div.a"


def test_repeats_empty_tables_and_clashing_columns(spark):
    rows = [host("a.example", 1, SITE.format(n=1, text=LONG))] * 3
    df = spark.createDataFrame(rows, PAGES).withColumns({c: F.lit("mine") for c in ("host", "path", "row", "text", "n_chars", "votes", "odd `name`")})
    found = extract.extract_texts(df).collect()
    assert len(found) == 3 and {r["text"] for r in found} == {wanted(1)} and {r["n_chars"] for r in found} == {len(wanted(1))}
    assert {r["host"] for r in found} == {"mine"} == {r["odd `name`"] for r in found}
    none = extract.extract_texts(spark.createDataFrame([], PAGES))
    assert none.collect() == [] and none.columns == ["page_id", "url", "text", "n_chars"]


@pytest.mark.skipif(not FOLDER.exists(), reason="the driver tables are not here")
def test_query_like_a_plain_version(spark):
    """The driver's pages hold their article in an article element, as h1 and p elements."""
    want = {}
    for r in spark.read.parquet(f"{FOLDER}/pages.parquet").collect():
        inner = r["html"][r["html"].index("<article>") + 9 : r["html"].index("</article>")]
        blocks = (" ".join(html.unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in re.split(r"</?(?:p|h1)>", inner))
        text = "\n".join(b for b in blocks if b)
        want[r["page_id"]] = (r["url"], text, len(text))
    got = {r["page_id"]: (r["url"], r["text"], r["n_chars"]) for r in queries.op11_host_paths(spark, str(FOLDER)).collect()}
    assert got == want
