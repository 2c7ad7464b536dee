import random
import time

import pytest

from tidemark.llm import htmltext

CASES = [
    ("<html><body><nav>Menu</nav><article><h1>Big &amp; bold&quo</h1><p><b>One  two.<br><p>Three\n four</p></article><footer>F</footer>", "Big & bold&quo One two. Three four"),
    ("<body><header>Site</header><main><h2>T</h2><aside>x</aside><p>Text<form><input>no</form></main><p>out</p>", "T Text"),
    ("<article><header><h1>Head</h1></header>in<em>li</em>ne<div class='cookie-notice'>no</div><section id=comments><article>no</article></section><p>end</article>", "Head inline end"),
    ("<script>var t='</p>';</script><style>p{}</style><p>a<ul><li>b<li>c</ul><table><tr><td>d<td>e<tr><td>f</table>", "a b c d e f"),
    ("plain &lt;b&gt; text &#8364;&nbsp; x <!-- hidden --> y", "plain <b> text € x y"),
    ("<article>cut <a href='x", "cut <a href='x"),
    ("<p class=\"lead\" title=\"a > b\">ok</p></div></p>", "ok"),
    ("", ""),
    ("<p>a</p><script>var x = 1; if (a < b", "a"),
    ("<p>a</p><!-- never closed", "a"),
    ("<p>a</p><!-- x > y", "a"),
    ("<p>a < b</p> 1 > 0", "a < b 1 > 0"),
    ("<article><p class='share-price'>1</p><div class='search-results'>2</div><p id='comment-on-policy'>3</p><div class='share-buttons'>no</div><div id='ad_box'>no</div></article>", "1 2 3"),
    ("<p>a<td>b</p>c</td></p>d<tr>e", "a bc d e"),
]


@pytest.mark.parametrize("html,text", CASES)
def test_pages(html, text):
    assert htmltext.parse(html)[0] == text


def test_templates_of_hosts(spark):
    rows = [(i, f"http://a.com/{i}", f"<body><div><b>Join us</b> today</div><p>Story {i}</p><div>Shared words</div></body>") for i in range(30)]
    rows += [(100 + i, f"http://b.com/{i}", f"<body><div>Shared words</div><p>Tale {i}</p></body>") for i in range(2)]
    rows += [(200, "http://a.com/x", "<article><div>Shared words</div></article>"), (201, None, "<p>No host</p>"), (202, "http://a.com/", None), (203, "junk", "")]
    pages = spark.createDataFrame([(*r, "z") for r in rows], "page_id long, url string, html string, text string").repartition(4)
    got = {r.page_id: (r.text, r.n_chars) for r in htmltext.op9_html_text(pages).collect()}
    assert len(got) == len(rows)
    assert all(got[i] == (f"Story {i}", len(f"Story {i}")) for i in range(30))
    assert got[100][0] == "Shared words Tale 0" and got[200][0] == "Shared words"
    assert got[201][0] == "No host" and got[202] == ("", 0) and got[203] == ("", 0)
    assert htmltext.op9_html_text(pages.limit(0)).count() == 0


def test_long_and_deep():
    assert len(htmltext.parse("<a" * 100_000)[0]) == 200_000
    assert htmltext.parse("<a" * 100_000 + ">x")[0] == "x"
    assert htmltext.parse("<div>" * 3000 + "deep" + "</div>" * 10)[0] == "deep"
    assert len(htmltext.parse("<article><p>" + "word " * 200_000)[0]) == 999_999


def texts_of(spark, rows):
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    return {r.page_id: r.text for r in htmltext.op9_html_text(pages).collect()}


def test_main_text_is_no_template(spark):
    page = "<body><div><article><p>Wrapped {}</p></article></div></body>"
    rows = [(i, f"http://copies.com/{i}", page.format(0 if i < 5 else i)) for i in range(8)]
    rows += [(100 + i, f"http://passage.com/{i}", f"<body>{'<p>Quoted passage</p>' if i < 5 else ''}<p>Story {i}</p><div>Foot</div></body>") for i in range(12)]
    rows += [(200 + i, f"http://same.com/{i}", "<body><p>The only text</p></body>") for i in range(4)]
    rows += [(300 + i, f"http://often.com/{i}", "<body><p>Copied text</p><div>Foot</div></body>" if i < 20 else f"<body><p>Own {i}</p><div>Foot</div></body>") for i in range(25)]
    rows += [(400, "http://often.com/foot", "<body><div>Foot</div></body>")]
    got = texts_of(spark, rows)
    assert [got[i] for i in range(8)] == [f"Wrapped {0 if i < 5 else i}" for i in range(8)]
    assert [got[100 + i] for i in range(12)] == [f"Quoted passage Story {i}" if i < 5 else f"Story {i}" for i in range(12)]
    assert {got[200 + i] for i in range(4)} == {"The only text"}
    assert [got[300 + i] for i in range(25)] == ["Copied text" if i < 20 else f"Own {i}" for i in range(25)]
    assert got[400] == "Foot"


def test_templates_inside_articles(spark):
    box, rare, passage = "<div class='tell'><p>Tell friends</p></div>", "<div class='note'>Rare note</div>", "<p class='q'>Quoted</p><div>Plain</div><ul><li class='x'>Item</li></ul>"
    rows = [(i, f"http://a.com/{i}", f"<body><article><p>Story {i}</p>{box}{rare if i < 5 else ''}{passage}</article></body>") for i in range(10)]
    rows += [(100 + i, f"http://b.com/{i}", f"<body><article><p>Tale {i}</p>{box if i < 3 else ''}</article></body>") for i in range(10)]
    rows += [(200, "http://a.com/box", f"<article>{box}</article>")]
    got = texts_of(spark, rows)
    assert [got[i] for i in range(10)] == [f"Story {i}{' Rare note' if i < 5 else ''} Quoted Plain Item" for i in range(10)]
    assert [got[100 + i] for i in range(10)] == [f"Tale {i}{' Tell friends' if i < 3 else ''}" for i in range(10)]
    assert got[200] == "Tell friends"


def test_time_is_in_proportion():
    blocks = "".join(f"<div><p>b{i}</p></div>" for i in range(50_000))
    for html in (blocks, "<p>" + "<b>" * 50_000 + "<p>x" * 50_000, "<article>" + blocks + "</article>" * 50_000):
        t = time.time()
        _, trees = htmltext.parse(html)
        assert htmltext.parse(html, set(list(trees)[::2]))[0]
        assert time.time() - t < 20


def brute(rows, least=3, share=0.5):
    """Templates by plain loops over whole pages."""
    different, on = {}, {}
    for _, url, html in rows:
        host = url.split("/")[2].lower()
        text, trees = htmltext.parse(html)
        different.setdefault(host, set()).add(text)
        for t in trees:
            on.setdefault((host, t), set()).add(text)
    many = {k for k, texts in on.items() if len(texts) >= least and len(texts) > share * len(different[k[0]])}
    return {i: htmltext.parse(html, {t for h, t in many if h == url.split("/")[2].lower()})[0] for i, url, html in rows}


@pytest.mark.parametrize("most", [htmltext.BROADCAST_HASHES, 0])
def test_as_brute_force_and_without_templates(spark, monkeypatch, most):
    monkeypatch.setattr(htmltext, "BROADCAST_HASHES", most)
    r = random.Random(3)
    boxes = [f"<div class='k{i}'><p>Box {i}</p></div>" for i in range(6)]
    rows = []
    for i in range(150):
        host = r.choice(["a.com", "b.com", "c.com"])
        inside = "".join(b for j, b in enumerate(boxes) if r.random() < j / 6)
        outside = r.choice(boxes) + "<div>Site line</div>"
        body = f"<p>Text {r.randrange(100)}</p>{inside}"
        rows.append((i, f"http://{host}/{i}", f"<body>{outside}{f'<article>{body}</article>' if r.random() < 0.6 else body}</body>"))
    got, want = texts_of(spark, rows), brute(rows)
    assert got == want
    assert sum(htmltext.parse(html)[0] != want[i] for i, _, html in rows) > 100  # what the templates change
