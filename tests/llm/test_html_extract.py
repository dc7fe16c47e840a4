import html
import re
import time

import pytest

from valora.llm.html_extract import extract, extract_query, main_text, parse

CASES = [
    ("<article><h1>T &amp; T</h1><p>a <b>b</b>c<br>d</p></article>", "T & T a bc d"),
    ("<html><head><title>t</title></head><body><nav>n</nav><p>one<p>two</body>", "one two"),
    ("<body><header>h</header><main><header><h1>H</h1></header><p>x</p><footer>f</footer></main></body>", "H x"),
    ("<article><p>a</p><div class='ad'>buy</div><aside>s</aside><form>f</form><section class=comments>c</section></article>", "a"),
    ("<article><p>a</article><article class=\"comment\"><p>reply</p></article>", "a"),
    ("<script>var t='</p><article>'</script><style>p{}</style><p>x<!-- <article>no</article> --> y</p>", "x y"),
    ("<p>a\n\t b&nbsp;&#8211; &#x41;&lt;i&gt;</p>", "a b – A<i>"),
    ("<p title='a > b'>q</p><p title=\"unclosed>r</p>", "q r"),
    ("", ""), ("plain < text > & more", "plain < text > & more"), ("<ul><li>a<li>b</ul><table><tr><td>c<td>d</table>", "a b c d"),
    ("<div class='cookie-notice'>c</div><div hidden>h</div><div role=\"navigation\">n</div><div>ok</div>", "ok"),
    ("<p>x<!-- open", "x"), ("<svg><text>s</text></svg><noscript>n</noscript><p>x</p>", "x"), ("<![CDATA[c]]>", "c"),
    ("<body class='has-sidebar nav'><div id=sidebar>s</div><div itemprop=articleBody>m</div></body>", "m"),
    ("<article>" + "<div>" * 3000 + "deep", "deep"), ("x " * 50_000, ("x " * 50_000).strip()),
]


@pytest.mark.parametrize(("page", "want"), CASES)
def test_pages(page, want):
    assert main_text(parse(page), set()) == want


def test_template_by_host(spark):
    def page(k):
        return f"<div class=top>Site name</div><div><p>Text {k}</p><p>Same words</p></div><div class=x><i>All rights</i></div>"

    rows = [(k, f"https://Shop.example.com:443/{k}", page(k)) for k in range(40)]
    rows += [(100 + k, f"https://other.example.com/{k}", page(k)) for k in range(3)]
    rows += [(200 + k, f"http://art.example.com/{k}", "<div>Site</div><article><p>Copied</p></article>") for k in range(9)]
    rows += [(300, None, "<p>n</p>"), (301, "https://shop.example.com/", None), (None, "rel/x", ""), (0, *rows[0][1:])]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'clash' AS text", "1 AS host")
    out = extract(df.repartition(4)).collect()
    assert len(out) == len(rows)
    got = {(r.page_id, r.url): r.text for r in out}
    assert got[(7, rows[7][1])] == "Text 7"
    assert got[(101, rows[41][1])] == "Site name Text 1 Same words All rights"
    assert got[(200, rows[43][1])] == "Copied"
    assert got[(300, None)] == "n" and got[(301, "https://shop.example.com/")] == "" and got[(None, "rel/x")] == ""
    assert extract(df.limit(0)).count() == 0


WRAPPED = [
    ("<div class='layout with-sidebar'><article>a</article></div><p>x</p>", "a"), ("<div class='content no-comments'><p>a</p></div>", "a"),
    ("<article class='post comments-open'><p>a</p></article>", "a"), ("<div class='layout sidebar'><main><p>a</p></main></div>", "a"),
    ("<div class=search><p>long text of a page</p></div><p>x</p>", "long text of a page x"), ("<article><div class=widget>a</div></article>", "a"),
    ("<article>a</article><section class='related-posts'><article>teaser text</article></section>", "a"),
    ("<p>long text of a page</p><div class=ad-slot-2>x</div><div id=site-footer>y</div>", "long text of a page"),
]


@pytest.mark.parametrize(("page", "want"), WRAPPED)
def test_names_of_wrappers(page, want):
    """Class and id names do not drop what holds the main text."""
    assert main_text(parse(page), set()) == want


MARKS = ["<!-- <article> -->", "<script>'<main>'</script>", "<aside><article>a</article></aside>", "<i role='maintenance'></i>",
         '<script type="application/ld+json">{"articleBody": "b"}</script>']


@pytest.mark.parametrize("mark", MARKS)
def test_marks_without_main(spark, mark):
    """What only looks like marked main text does not spare a page its host's template."""
    rows = [(k, f"https://a.example.com/{k}", f"{mark}<div>Site name</div><p>Text {k}</p>") for k in range(9)]
    out = extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert sorted((r.page_id, r.text) for r in out) == [(k, f"Text {k}") for k in range(9)]


def test_sections_of_a_large_host(spark):
    """Each section's menu goes, though a small part of the host's pages has it; copies of a
    page are one page."""
    rows = [(k, f"https://a.example.com/{k}", f"<div>Section {k % 20}</div><p>Text {k}</p>") for k in range(200)]
    rows += [(1000 + k, f"https://b.example.com/{k}", "<div>Site</div><p>Copy</p>") for k in range(9)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in extract(df).collect()}
    assert got == {k: f"Text {k}" if k < 1000 else "Site Copy" for k, *_ in rows}


def test_template_inside_main(spark):
    """Unmarked boilerplate goes from inside articles; near copies, copies and articles that
    are nothing else stay."""
    def words(k, n=40):
        return " ".join(f"w{k * 1000 + j}" for j in range(n))

    plug = "<div><p>Read our daily letter, it is free.</p></div>"
    rows = [(k, f"https://a.example.com/{k}", f"<article><p>{words(k)}</p>{plug}<p>{words(k + 500)}</p></article>") for k in range(30)]
    rows += [(100 + k, f"https://a.example.com/{k}", f"<article><p>{words(1)}</p><p>{words(2)}</p><p>{words(3)} {k}</p></article>") for k in range(30)]
    rows += [(200, "https://a.example.com/x", f"<article>{plug}</article>"), (201, "https://b.example.com/x", f"<article>{plug}a</article>")]
    got = {r.page_id: r.text for r in extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    want = {k: f"{words(k)} {words(k + 500)}" for k in range(30)}
    want |= {100 + k: f"{words(1)} {words(2)} {words(3)} {k}" for k in range(30)}
    plain = "Read our daily letter, it is free."
    assert got == want | {200: plain, 201: plain + " a"}


def test_query(spark, sf_dir):
    """The given pages have one article each: its text by a plain reading."""
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    for r in extract_query(spark, sf_dir).collect():
        inner = re.search(r"<article>(.*?)</article>", pages[r.page_id], re.DOTALL)[1]
        inner = re.sub(r"</?(?:p|h1|br)>", " ", inner)
        want = " ".join(html.unescape(re.sub(r"<[^>]*>", "", inner)).split())
        assert r.text == want and r.n_chars == len(want)


def article_of(page):
    inner = re.search(r"<article>(.*?)</article>", page, re.DOTALL)[1]
    inner = re.sub(r"</?(?:p|h1|br)>", " ", inner)
    return " ".join(html.unescape(re.sub(r"<[^>]*>", "", inner)).split())


@pytest.mark.parametrize("scale", ["sf0.01", "sf0.1"])
def test_larger_tables(spark, scale):
    """No text of a larger table, where paragraphs recur, loses any."""
    sf_dir = f"/root/testdata/{scale}"
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    assert [r.page_id for r in extract_query(spark, sf_dir).collect() if r.text != article_of(pages[r.page_id])] == []


def test_recurring_prose_stays(spark):
    """A license paragraph on 30 pages of a host is article text; a named block and a list of
    links are not."""
    def page(k):
        words = " ".join(f"w{k * 100 + j}" for j in range(40))
        return words, (
            f"<article><p>{words}</p><p>Released under the MIT License.</p><ul><li>Step one</li></ul>"
            f"<p class=promo-box-7>Read more of us</p><ul><li><a href=/a>One</a></li><li><a href=/b>Two</a></li></ul></article>"
        )

    rows = [(k, f"https://a.example.com/{k}", page(k)[1]) for k in range(30)]
    got = {r.page_id: r.text for r in extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {k: f"{page(k)[0]} Released under the MIT License. Step one" for k in range(30)}


ODD = {
    "unclosed": "<a ", "sections": "<![CDATA[", "ends": "<span></b>", "spans": "<span>", "quotes": "<a \">\" ", "apostrophes": "<a '\">",
    "paragraphs": "<td><span><p>x</p>", "comments": "<!-- x", "names": "<a<", "items": "<i><li>", "blocks": "<div><p>t</p>", "closes": "</p>",
    "declarations": "<!x ", "entities": "&am", "scripts": "<script>x</script", "tables": "<table><tr><td>", "mixed": "<b a='1\" c=\"2'",
}


@pytest.mark.parametrize("kind", ODD)
def test_linear_time(kind):
    """2 MB of each odd page; the time of a test run is mostly that of a plain page."""
    page = ODD[kind] * (2_000_000 // len(ODD[kind]))
    start = time.process_time()
    parse(page)
    assert time.process_time() - start < 5


def test_odd_tags():
    assert main_text(parse("<a \">\" x <b>y</b>"), set()) == "y"
    assert main_text(parse("<a \">\" x"), set()) == "\" x"
    assert main_text(parse("<p>x</b></p>y<li>z"), set()) == "x y z"
    assert main_text(parse("a <![CDATA[b > c"), set()) == "a c"
    assert main_text(parse("a <b c"), set()) == "a <b c"
