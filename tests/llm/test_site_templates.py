from partwatch.llm import site_templates as st
from partwatch.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def text(html):
    return st.extract(html, set())


def test_markup():
    cases = {
        "<p>a &amp; b&nbsp;&#233;\n c</p><p> </p><div>x<br>y<b>z</b></div>": "a & b é c\nx yz",
        "<body><nav>n</nav><article><header><h1>T</h1></header><p>one<p>two<aside>s</aside></article><footer>f</footer>": "T\none\ntwo",
        "<header>h</header><main><p>m</p><form>q</form></main><div>rest</div>": "m",
        "<div class='cookie-notice'>c</div><div id=sideBar>s</div><div class='has-ads'><article>a</article></div>": "a",
        "<script>var a='</p><p>no';</script><style>p{}</style><!-- <p>c</p> --><p>yes": "yes",
        "a < b <3 <p title='x>y'>t</p>": "a < b <3\nt",
        "<article>one</article><div class=comments><article>reader</article></div>": "one",
        "<ul><li>a<li>b<ul><li>c</ul></ul><table><tr><td>1<td>2<tr><td>3</table>": "a\nb\nc\n1\n2\n3",
        "<p><b>open<br><p>next</p><section hidden>h</section>": "open\nnext",
        "": "",
        "<<<>>>": "<<<>>>",
    }
    for html, expected in cases.items():
        assert text(html) == expected, html
    assert text(None) == ""
    assert text("<div>" * 20_000 + "deep" + "</div>" * 20_000) == "deep"
    assert text("<a \"" * 50_000) == "" and text("<!--" * 50_000) == ""


def test_templates(spark):
    def page(i, host):
        return (i, f"http://{host}/p{i}", f"<article><h1>One title</h1><p>own text {i}</p><div>Read our plain terms</div></article><p>plain foot</p>", "old")

    rows = [page(i, "A.example:80") for i in range(8)] + [page(i, "b.example") for i in range(8, 10)]
    rows += [(20 + i, "http://c.example/same", "<article><p>one article</p></article>", "old") for i in range(9)]
    rows += [(40, None, None, "old"), (41, "no url", "<p>x</p>", "old"), (42, "http://a.example/", "", None)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string, text string").repartition(4)
    got = {r.page_id: (r.text, r.n_chars) for r in st.extract_text(frame).collect()}
    assert all(got[i][0] == f"One title\nown text {i}" for i in range(8))
    assert all(got[i][0] == f"One title\nown text {i}\nRead our plain terms" for i in range(8, 10))
    assert all(got[20 + i][0] == "one article" for i in range(9))
    assert got[40] == got[42] == ("", 0) and got[41] == ("x", 1)
    assert st.extract_text(frame.where("false")).count() == 0


def test_query_keeps_articles(spark):
    import re
    from html import unescape

    pages = {r.page_id: r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    rows = QUERIES["op1_html_extraction"](spark, SF).collect()
    assert len(rows) == len(pages)
    for r in rows:
        article = re.search(r"<article>(.*?)(?:</article>|<footer|$)", pages[r.page_id], re.DOTALL)[1]
        parts = [" ".join(unescape(re.sub(r"<[^>]*>", "", x)).split()) for x in re.split(r"</?(?:p|h1)>", article)]
        assert r.text == "\n".join(x for x in parts if x) and r.n_chars == len(r.text)


def test_named_articles():
    cases = {
        "<article class='post comments-open'>a</article><p>x</p>": "a",
        "<article class='post related notice'>a<div class=comments><article>reader</article></div></article>": "a",
        "<div class='site comments-open'><article><h1>T</h1>a</article></div><p>x</p>": "T\na",
        "<main><div class='post related'><article>a</article></div></main>": "a",
        "<aside><article>t</article></aside><div id=comments-off><article>a</article><div class=replies>r</div></div>": "a",
        "<div class='a reply'><main>m</main></div>": "m",
        "<article>one</article><div class=related><article>two</article></div>": "one",
        "<article>one<article class=comment>two</article></article><div class=comments>three</div>": "one",
        "<div>own text</div><div class=comments><article>reader</article></div>": "own text\nreader",
    }
    for html, expected in cases.items():
        assert text(html) == expected, html


def test_blocks_of_a_large_host(spark, monkeypatch):
    """Blocks on a share of the pages that is small but on many of them are templates, on a small host they are not."""
    def page(i, host):
        notice = f"<p>Rotating notice {i % 12} of this site</p>"
        box = f"<div>Section box {i % 15}</div>" if i % 2 else ""
        rare = f"<p>Quoted on {i % 500}</p>"
        return (i, f"http://{host}/p{i}", f"<div><h1>Title {i}</h1><p>own text {i}</p>{box}{rare}</div>{notice}")

    rows = [page(i, "large.example") for i in range(3_000)] + [page(3_000 + i, "small.example") for i in range(60)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(8)
    for limit in (st.BROADCAST_HASHES, 0):
        monkeypatch.setattr(st, "BROADCAST_HASHES", limit)
        got = {r.page_id: r.text for r in st.extract_text(frame).collect()}
        assert len(got) == len(rows)
        for i in range(3_000):
            assert got[i] == f"Title {i}\nown text {i}\nQuoted on {i % 500}"
        for i in range(3_000, 3_060):
            assert f"Rotating notice {i % 12} of this site" in got[i] and f"Quoted on {i % 500}" in got[i]


def test_class_words_and_forms_keep_articles():
    cases = {
        "<div class='layout with-sidebar'><h1>T</h1><p>Body</p></div>": "T\nBody",
        "<div class='container no-sidebar'><h1>T</h1><p>Body</p></div><div class=sidebar>s</div>": "T\nBody",
        "<main><div class='post share-enabled'><h1>T</h1>Body</div></main>": "T\nBody",
        "<form id=aspnetForm action=x><nav>n</nav><h1>T</h1><p>Body</p><input name=q><select><option>o</select></form>": "T\nBody",
        "<form><p>Body of a page without headings</p><label>x</label></form><p>y</p>": "Body of a page without headings\nx\ny",
        "<h1>T</h1><p>Body</p><form><p>Your name and your e-mail address</p></form>": "T\nBody",
        "<article><h1>T</h1><section class=related-work>R</section><p class=ad-hoc>A</p><blockquote class=social-history>S</blockquote></article>": "T\nR\nA\nS",
        "<article><h1>T</h1><div class='related-items'>R</div><p class='ad-top'>A</p><div class=social-links>S</div><div id=adSlot2>x</div></article>": "T",
        "<div class='main-content'><h1>T</h1>B</div><div class='left-sidebar'>s</div><div class=sideBar>s</div><div class='cookie-notice'>c</div><ul class=share-buttons><li>x</ul>": "T\nB",
        "<h1>T</h1><p>short</p><div class=comments><h2>3 comments</h2><p>A reader says very much more than the text</p></div>": "T\nshort",
        "<div>short</div><div class=comments><p>A reader says very much more than the text</p></div>": "short",
        "<div class=newsletter-box><h1>T</h1><p>An article about letters</p></div>": "T\nAn article about letters",
        "<div role=form><h1>T</h1>Body</div>": "T\nBody",
    }
    for html, expected in cases.items():
        assert text(html) == expected, html
