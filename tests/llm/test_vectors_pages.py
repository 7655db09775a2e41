"""Vectors and pages: edge rows, brute force, empty tables."""
import numpy as np
import pytest

from trailrank.llm import cross_polytope, html_extract, queries


def _brute(rows, cosine=0.95):
    sound = [(i, np.array(v, float)) for i, v in rows if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links, root = {i: 0 for i, _ in rows}, {i: i for i, _ in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for n, (i, a) in enumerate(sound):
        for j, b in sound[:n]:
            if len(a) == len(b) and a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= cosine:
                links[i] += 1
                links[j] += 1
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i: (links[i], find(i), find(i) == i) for i in links}


@pytest.mark.parametrize("block", [1024, 16])
def test_vectors(spark, block):
    draw = np.random.default_rng(1)
    base = draw.normal(size=(60, 64))
    rows = [(int(i), (base[i] if i < 60 else base[i % 7] + draw.normal(size=64) * 0.12 * (1 + i % 3)).tolist()) for i in range(200)]
    rows += [(300, rows[3][1]), (301, rows[3][1]), (302, (np.array(rows[3][1]) * 5).tolist()), (303, None), (304, []), (305, [0.0] * 64), (306, [float("nan")] * 64),
             (307, [None] + [1.0] * 63), (308, [1.0, 2.0]), (309, [2.0, 4.0]), (310, [float("inf")] + [1.0] * 63)]
    table = spark.createDataFrame([(v, 1, i, "x") for i, v in rows], "embedding array<double>, label int, vec_id long, node string")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in cross_polytope.near_duplicates(table, block=block).collect()}
    assert got == _brute(rows)


def test_query_vectors(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").collect()]
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in queries.op9_cross_polytope(spark, "/root/testdata/sf0.001").collect()}
    assert got == _brute(rows)


def test_agreement_by_width():
    """The shares that set the number of tables are not above those of the real hashes, at any width."""
    draw = np.random.default_rng(8)
    for width in (64, 256, 1024):
        x, z = draw.normal(size=(2, 1000, width))
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        z -= (z * x).sum(axis=1, keepdims=True) * x
        y = 0.95 * x + np.sqrt(1 - 0.95 ** 2) * z / np.linalg.norm(z, axis=1, keepdims=True)
        (a, pa), (b, pb) = cross_polytope.codes(x, 1, 4), cross_polytope.codes(y, 1, 4)
        same, near = a == b, (a == b) | (a == pb[:, :, 0]) | (pa[:, :, 0] == b)
        first, second = cross_polytope.agreement(width)
        assert first <= same.mean() + 0.012 and second <= near.mean() + 0.012
    assert cross_polytope.tables(3, width=64) == cross_polytope.tables(3) < cross_polytope.tables(3, width=256) < cross_polytope.tables(3, width=1024)


def test_no_vectors(spark):
    assert cross_polytope.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []
    got = cross_polytope.near_duplicates(spark.createDataFrame([(1, None)], "vec_id long, embedding array<float>")).collect()
    assert [(r.vec_id, r.n_links, r.component_id, r.kept) for r in got] == [(1, 0, 1, True)]


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><header class="site"><h1>Site name</h1></header>
<nav><ul><li><a href="/a">Menu</a></li></ul></nav><div class="cookie-notice">We, use, cookies, on, this, page, and, others.</div>
<div id="content" class="has-sidebar"><div class="post"><h2>Title &amp; more</h2><p>One, two, three, and so on, for a fairly long text.<p>Second
 para<br>line with a <a href=x>link</a>, and more&nbsp;text here.</p><div class="share"><a>Tweet</a></div><ul><li>item one</li><li>item two</li></ul>
<div class="ad">Buy, now, cheap, things, today.</div><section><p>Third, text, again and again and again.</p></section></div></div>
<aside>Side, text, long, longer, longest</aside><div id="comments"><article class="comment"><p>Nice, article, I, like, it, so, much, yes.</p></article></div>
<form><label>Mail</label></form><footer>&copy; foot, and, so, on</footer></body></html>"""


def test_main_text():
    assert html_extract.main_text(PAGE).split("\n") == ["Title & more", "One, two, three, and so on, for a fairly long text.", "Second para line with a link, and more text here.",
                                                        "item one", "item two", "Third, text, again and again and again."]
    assert html_extract.main_text(PAGE[:PAGE.index("Third")]).split("\n")[:2] == ["Title & more", "One, two, three, and so on, for a fairly long text."]


@pytest.mark.parametrize("page,text", [("", ""), ("<p>only text", "only text"), ("a < b & c &am", "a < b & c &am"), ("<article><h1>T</h1></article>", "T"), ("<nav>menu</nav>", ""),
                                       ("<script>x", ""), ("<article><p>text one, two<!-- no", "text one, two"), ("<p>a</p><p class=", "a"), ("<article><p>&#x41;&lt;b&gt;</p></article>", "A<b>")])
def test_odd_pages(page, text):
    assert html_extract.main_text(page) == text


def test_labels_that_name_a_subject():
    """Headings, sections and spans whose ids are about sharing, adverts or comments stay; short adverts and threads of comments go."""
    long = "Long text, with commas, and much to say about it. " * 12
    parts = [("<h2 id='discussion'>Discussion one</h2>", "Discussion one"), (f"<section id='discussion'><h3>D</h3><p>{long}</p></section>", "D\n" + long.strip()),
             ("<h2><span id='Social_structure'>Social structure</span> of ants</h2>", "Social structure of ants"),
             ("<section id='data-sharing'><h3>Data</h3><p>Data, short.</p></section>", "Data\nData, short."),
             ("<div id='advertising-in-the-1920s'><p>Adverts, then.</p></div>", "Adverts, then."), ("<h2 id='comments'>Comments in code</h2>", "Comments in code"),
             ("<pre>x = 1 <span class='token comment'># why</span></pre>", "x = 1 # why"), (f"<div class='notice-of-motion'><p>{long}</p></div>", long.strip())]
    junk = "<div class='ad'>Buy, now</div><div class='comments'><div class='comment'><p>" + long + "</p></div><div class='comment'><p>" + long + "</p></div></div>"
    body = "".join(h for h, _ in parts)
    want = "\n".join([long.strip(), *(x for _, x in parts)])
    for page in (f"<article><p>{long}</p>{body}{junk}</article>", f"<body><div><p>{long}</p>{body}{junk}</div></body>"):
        assert html_extract.main_text(page) == want


def test_short_parts_beside_a_long_one():
    """Headings, paragraphs and sections beside the best container stay, however long it is; so do references; menus do not."""
    long = [f"Paragraph {i}, with commas, and some more words to it, up to a hundred characters or about as many." for i in range(60)]
    menu = "<ul><li><a href=a>Home</a></li><li><a href=b>About us</a></li><li><a href=c>Contact</a></li></ul>"
    body = "<div>" + "".join(f"<p>{x}</p>" for x in long) + "</div>"
    page = f"<body>{menu}<h1>Title</h1>{body}<div><p>Last part, short.</p></div><p>A closing line.</p><section><p>Section, short.</p></section>Loose words.</body>"
    want = ["Title", *long, "Last part, short.", "A closing line.", "Section, short.", "Loose words."]
    assert html_extract.main_text(page).split("\n") == want
    inner = page.replace("<div><p>Para", "<div><div><p>Para").replace("</div><div><p>Last", "</div></div><div><p>Last")
    assert html_extract.main_text(inner).split("\n") == want
    cited = [f"A long title of a cited paper, number {i}" for i in range(5)]
    refs = "<ul>" + "".join(f"<li><a href=x>{c}</a></li>" for c in cited) + "</ul>"
    for page in (f"<article>{body}{refs}</article>", f"<div>{body}<div>{refs}</div>{menu}</div>"):
        got = html_extract.main_text(page).split("\n")
        assert got[:60] == long and (got[60:] == cited or not page.startswith("<article>"))
    assert html_extract.main_text(f"<body><div>{''.join(f'<p>{x}</p>' for x in long)}{refs}{menu}</div></body>").split("\n") == [*long, *cited]


def test_long_page():
    page = "<html><body><article>" + "".join(f"<p>Paragraph {i}, with, commas.</p>" for i in range(20000)) + "</article></body></html>"
    assert html_extract.main_text(page).count("\n") == 19999


def test_query_pages(spark):
    """Every page of the table keeps its article, found by plain string search."""
    import html
    import re
    pages = {r.page_id: r.html for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()}
    got = {r.page_id: r for r in queries.op6_html_extract(spark, "/root/testdata/sf0.001").collect()}
    assert set(got) == set(pages)
    for i, page in pages.items():
        article = page[page.index("<article>") + 9:].split("</article>")[0]
        want = [" ".join(html.unescape(re.sub(r"<[^>]*>", " ", x)).split()) for x in re.split(r"</?(?:p|h\d)>", re.sub(r"<[^>]*\Z", "", article))]
        assert got[i].text == "\n".join(x for x in want if x) and got[i].n_chars == len(got[i].text)


def test_page_edges(spark):
    pages = spark.createDataFrame([(1, None, None), (1, None, None), (None, "u", "<p>x, y</p>")], "page_id long, url string, html string")
    assert sorted((r.page_id or 0, r.url, r.text, r.n_chars) for r in html_extract.extract(pages).collect()) == [(0, "u", "x, y", 4), (1, None, "", 0), (1, None, "", 0)]
    assert html_extract.extract(pages.filter("false")).collect() == []
