"""Wrappers of synthetic templates: exact round trips of the text put into them."""

import html
import random

import pytest

from quarterline.llm import wrappers as w


def sentence(rng, words=12):
    return " ".join(rng.choice(["alpha", "béta", "a & b", "<gamma>", "d\"e", "zeta"]) for _ in range(words))


TEMPLATES = {
    "article": ("<!DOCTYPE html><html><head><title>{t}</title><style>p{{}}</style></head><body><nav><ul><li>{n}</li></ul></nav>"
                "<div class='ad'>{n}</div><article>", "</article><aside>{n}</aside><footer>{n}</footer></body></html>"),
    "named": ('<html><body><div id="top" class="site-header">{n}</div><div class="sidebar left">{n}<p>{n}</p></div>'
              '<div class="content">', '</div><div class="comments"><p>{n}</p><p>{n}</p></div></body></html>'),
    "main": ("<html><body><header><h1>{n}</h1></header><main><form><input>{n}</form>", "</main><script>var a='</p>';</script></body></html>"),
}


def page(kind, rng, cut=False):
    start, end = TEMPLATES[kind]
    blocks = [sentence(rng) for _ in range(rng.randint(1, 9))]
    body = f"<h1>{html.escape(blocks[0])}</h1>"
    for text in blocks[1:]:
        words = html.escape(text, quote=False).replace(" ", rng.choice([" ", "\n  ", "&nbsp;"]))
        body += rng.choice([f"<p>{words}</p>", f"<p>{words}", f"<ul><li>{words}</li></ul>", f"<p><b>{words}</b></p>"])
        if rng.random() < 0.2:
            body += "<!-- x --><div class='advert'>buy <b>now</b></div>"
    names = {"t": "title", "n": "menu words"}
    return start.format(**names) + body + ("" if cut else end.format(**names)), "\n".join(blocks)


@pytest.mark.parametrize("kind", TEMPLATES)
def test_text_comes_back(spark, kind):
    rng = random.Random(kind)
    pages = [page(kind, rng, cut=i % 9 == 8) for i in range(40)]
    rows = [(i, f"https://{kind}.example.org/{i}", source) for i, (source, _) in enumerate(pages)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r for r in w.main_texts(df, w.host_wrappers(df)).collect()}
    assert len(got) == 40
    for i, (_, text) in enumerate(pages):
        assert got[i]["text"] == text and got[i]["n_chars"] == len(text), pages[i][0]


def test_given_pages_match_their_wrappers(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    rows = w.main_texts(df, w.host_wrappers(df)).collect()
    assert sum(r["by_wrapper"] for r in rows) > 0.7 * len(rows)
    for row in rows:
        assert "var t=" not in row["text"] and not any(line != " ".join(line.split()) for line in row["text"].split("\n"))


def test_a_repeated_group_and_an_optional_one():
    pages = [f"<body><article><h1>t</h1>{'<p>x</p>' * n}{'<ol><li>y</li></ol>' * (n % 2)}</article></body>" for n in (3, 4, 5, 6)]
    found = w.infer(pages)
    assert "(?:" in found["expression"] and "?+" in found["expression"] and "|" not in found["expression"]


def test_edge_pages(spark):
    rows = [
        (1, None, None), (2, "no url", ""), (3, "http://a.b/c", "plain < text & <b>bold"), (3, "http://a.b/c", "plain < text & <b>bold"),
        (4, "http://a.b/c", "<article>&lt;p&gt; &amp;amp; x<br>y</article>" + "<p>z" * 20000), (None, "http://a.b", '<p title="a>b">q</p'),
        (5, "http://a.b", "<article><p>open <script>never closed"),
    ]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS host", "2 AS text")
    got = [(r["page_id"], r["text"]) for r in w.main_texts(df, w.host_wrappers(df)).collect()]
    assert sorted(got, key=str) == sorted([
        (1, ""), (2, ""), (3, "plain < text & bold"), (3, "plain < text & bold"), (4, "<p> &amp; x\ny"), (None, "q"), (5, "open")], key=str)
    none = df.filter("false")
    assert w.main_texts(none, w.host_wrappers(none)).collect() == []


@pytest.mark.parametrize("source, text", [
    ('<body><div class="page no-sidebar"><article><p>one</article></div>', "one"),
    ('<body><p>less</p><div class="has-header-image sidebar-right"><article>all of it</article></div>', "all of it"),
    ('<body><nav>menu</nav><div class="page social"><article>short</article></div><footer>a long legal line</footer>', "short"),
    ('<body><div id="form">the text without any article in the page</div><p>end</p>', "the text without any article in the page\nend"),
    ('<body><article><p class="notice">beside<p>first and more</p><ul><li class="share">x<li>second</ul><p>third</article>',
     "first and more\nsecond\nthird"),
    ('<article><div><span class="ad">buy</div><p>the text</article>', "the text"),
    ('<article><p>the whole text of it</p><div class="cookie-banner">no</div><div class="site-footer">no</div></article>', "the whole text of it"),
    ('<head><meta name="x"><p>no body tag</p>', "no body tag"),
    ('<body><p>the text itself is here</p><div class="related"><article>teaser</article></div>', "the text itself is here"),
    ('<article><table><tr><td class="ad">x<td>kept cell<tr><td>kept row</table></article>', "kept cell\nkept row"),
    ('<article><b>bold<p>one</b> two</p>three</article>', "bold\none two\nthree"),
])
def test_names_and_omitted_end_tags(source, text):
    assert w.extract(source, None) == (text, False)


def test_text_that_all_articles_share_stays(spark):
    rng = random.Random(5)
    rows, texts = [], []
    for i in range(40):
        kind = ("post", "story")[i % 2]
        text = [f"{sentence(rng, 20)} {i} {k}".replace("<gamma>", "g").replace("a & b", "c") for k in range(1 + i % 5)]
        body = "".join(f"<p>{line}</p>" for line in text)
        rows.append((i, "http://one.example/x", f"<body><div class='wrap {kind}'><p>menu</p><article><h1>Title {i}</h1>{body}"
                     "<h2>Conclusion</h2><p>The same end</p></article><p>imprint</p></div></body>"))
        texts.append("\n".join([f"Title {i}", *text, "Conclusion", "The same end"]))
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    wrappers = w.host_wrappers(df)
    assert wrappers.count() == 2
    got = {r["page_id"]: r for r in w.main_texts(df, wrappers).collect()}
    assert [got[i]["text"] for i in range(40)] == texts and all(r["by_wrapper"] for r in got.values())


def nameless(i, rng):
    """A page whose tags and class words say nothing, and its article."""
    text = [f"{sentence(rng, 20)} {i} {k}".replace("<gamma>", "g").replace("a & b", "c") for k in range(2 + i % 4)]
    body = "".join(f"<p>{line}</p>" for line in text)
    teasers = "".join(f"<li><a href='/{k}'>{sentence(rng, 9).replace('<gamma>', 'g')}</a></li>" for k in range(i % 3 + 1))
    talk = "".join(f"<div class='qg'><p>I say {i} {k}</p></div>" for k in range(i % 4))
    page = (f"<body><div class='qa'><ul><li><a href='/'>Start</a><li><a href='/b'>Shop</a></ul><p>Welcome to this place</p></div>"
            f"<div class='qb'><h1>Title {i}</h1><div class='qc'>{body}<p>Conclusion</p></div><div class='qd'><ul>{teasers}</ul></div>"
            f"<div class='qe'>{talk}</div></div><div class='qf'><p>All rights reserved by all of us</p></div></body>")
    return page, "\n".join([f"Title {i}", *text, "Conclusion"])


def test_slots_find_the_article_where_names_say_nothing(spark):
    rng = random.Random(6)
    pages = [nameless(i, rng) for i in range(60)]
    df = spark.createDataFrame([(i, "http://n.example/x", page) for i, (page, _) in enumerate(pages)], "page_id long, url string, html string")
    got = {r["page_id"]: r for r in w.main_texts(df, w.host_wrappers(df)).collect()}
    matched = [i for i in got if got[i]["by_wrapper"]]
    assert len(matched) >= 54
    assert [got[i]["text"] for i in matched] == [pages[i][1] for i in matched]
    assert all(w.extract(page, None)[0] != text for page, text in pages)


def test_slots_overrule_a_name_that_points_elsewhere():
    rng = random.Random(7)
    pages = [(f"<body><div class='content'><p>Our shop</p></div><div class='b'><p>{(one := sentence(rng).replace('<gamma>', 'g').replace('a & b', 'c'))} {k}</p>"
              f"<p>{k}</p></div></body>", f"{one} {k}\n{k}") for k in range(6)]
    wrapper = w.json.dumps(w.infer([page for page, _ in pages]))
    for page, text in pages:
        assert w.extract(page, wrapper) == (text, True) and w.extract(page, None) == ("Our shop", False)


def test_constants_around_the_slots_of_a_bare_body_go():
    pages = [f"<body><p>Our site</p><h1>Title {k}</h1><p>text {k} of a page</p><h2>Conclusion</h2><p>end {k}</p><p>Imprint</p></body>" for k in range(5)]
    wrapper = w.json.dumps(w.infer(pages))
    assert w.extract(pages[3], wrapper) == ("Title 3\ntext 3 of a page\nConclusion\nend 3", True)
    assert w.infer(pages[:2])["edges"] is False


def test_wrappers_beyond_the_broadcast_size_are_joined(spark, monkeypatch):
    rows = [(i, f"http://h{i % 3}.example/", f"<body><article><p>text {i}</p></article><p>menu</p></body>") for i in range(30)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    want = sorted(map(tuple, w.main_texts(df, w.host_wrappers(df)).collect()))
    monkeypatch.setattr(w, "BROADCAST_CHARS", 0)
    assert sorted(map(tuple, w.main_texts(df, w.host_wrappers(df)).collect())) == want and want[0][2] == "text 0"


def test_copies_keep_their_text():
    pages = [f"<body><article><p>The same long text on all of the pages</p><p>{k}</p></article></body>" for k in range(6)]
    wrapper = w.json.dumps(w.infer(pages))
    assert w.extract(pages[2], wrapper) == ("The same long text on all of the pages\n2", True)


def test_long_pages_and_long_repeats_are_aligned_whole():
    unit = "".join(f"<p><i class='{chr(97 + k)}'>x</i></p>" for k in range(20))
    pages = [f"<body><article>{'<p>a</p><h2>b</h2>' * n}{'<b>y</b><p>z' * n}</article>{unit * (2 + n % 3)}</body>" for n in (1500, 2000, 2500)]
    wrapper = w.infer(pages)
    assert wrapper and all(w.extract(page, w.json.dumps(wrapper))[1] for page in pages)
    assert w.extract(f"<body><article>{'<p>a</p><h2>b</h2>' * 2}{'<b>y</b><p>z' * 3}</article>{unit * 9}</body>", w.json.dumps(wrapper))[1]


def test_a_page_that_ends_inside_the_article_does_not_hinder_inference():
    whole = [f"<body><div class='content'><h1>{k}</h1><div>t{k}</div></div></body>" for k in range(4)]
    wrapper = w.infer([*whole, "<body><div class='content'><h1>cut</h1><div>off"])
    assert wrapper and all(w.extract(page, w.json.dumps(wrapper))[1] for page in whole)


def test_alignment_is_a_longest_common_subsequence(monkeypatch):
    rng = random.Random(3)
    for held in (1 << 30, 4):
        monkeypatch.setattr(w, "_CELLS_HELD", held)
        for _ in range(200):
            a, b = ("".join(rng.choice("abc") for _ in range(rng.randint(0, 14))) for _ in "xy")
            table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
            for i, x in enumerate(a):
                for j, y in enumerate(b):
                    table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
            pairs = w.aligned(a, b)
            assert len(pairs) == table[-1][-1] and all(a[i] == b[j] for i, j in pairs)
            assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:]))


def test_all_pages_of_a_template_decide(spark):
    """The article's paragraphs, a notice and a second holder show on few pages, one repeat on a single page."""
    pages = []
    for i in range(300):
        extra = {7: "<i class='odd'>x</i>", 11: "<ol><li>a</li><li>b</li></ol>", 13: "<pre>p</pre><pre>q</pre><hr>"}.get(i, "")
        pages.append(f"<body><div class='k'><p>menu</p></div><div class='z'><p>text {i} of a page</p>{extra}<p>end {i}</p></div><p>imprint</p></body>")
    df = spark.createDataFrame([(i, "http://all.example/", page) for i, page in enumerate(pages)], "page_id long, url string, html string")
    wrappers = w.host_wrappers(df)
    assert all(row["by_wrapper"] for row in w.main_texts(df, wrappers).collect())
    known = w.json.loads(wrappers.head()["wrapper"])
    assert {"i odd", "ol", "li", "pre", "hr"} <= known["alphabet"].keys() and known["by_slots"]
    assert known == w.json.loads(w.json.dumps(w.infer(pages)))


def test_constants_are_counted_over_all_pages(spark):
    """A text on three pages of four is no constant, however many of the pages one looks at first have it."""
    pages = [f"<body><p>Welcome</p><h1>Title {i}</h1><p>text {i} of a page</p><p>{'Common end' if i % 4 else f'Own end {i}'}</p></body>" for i in range(200)]
    df = spark.createDataFrame([(i, "http://c.example/", page) for i, page in enumerate(pages)], "page_id long, url string, html string")
    texts = {r["page_id"]: r["text"] for r in w.main_texts(df, w.host_wrappers(df)).collect()}
    assert texts == {i: f"Title {i}\ntext {i} of a page\n{'Common end' if i % 4 else f'Own end {i}'}" for i in range(200)}


def test_folds_of_many_structures_do_not_depend_on_how_rows_lie(spark, monkeypatch):
    monkeypatch.setattr(w, "FOLDED", 4)
    rng = random.Random(8)
    blocks = ("<p>{}</p>", "<h2>{}</h2>", "<ul><li>{}</li></ul>", "<pre>{}</pre>")
    pages = ["<body><div class='u'><p>menu</p></div><div class='v'>"
             + "".join(rng.choice(blocks).format(f"text {i} {k}") for k in range(rng.randint(1, 12))) + "</div></body>" for i in range(150)]
    rows = [(i, "http://f.example/", page) for i, page in enumerate(pages)]
    schema = "page_id long, url string, html string"
    a, b = (w.host_wrappers(spark.createDataFrame(given, schema).repartition(n)).collect() for given, n in ((rows, 3), (rows[::-1] + rows[:9], 7)))
    assert a == b and len(a) == 1
    got = [w.extract(page, a[0]["wrapper"]) for page in pages]
    assert sum(matched for _, matched in got) > 0.8 * len(pages)


def test_tags_that_hardly_any_page_has_are_read_over(monkeypatch):
    monkeypatch.setattr(w, "RARE", 5)
    pages = [f"<body><div class='z'><p>text {i}</p><div class='x{'abcdefghijkl'[i]}'><p>more {i}</p></div></div><p>imprint</p></body>" for i in range(12)]
    wrapper = w.infer(pages)
    assert not any(" x" in name for name in wrapper["alphabet"])
    assert [w.extract(page, w.json.dumps(wrapper)) for page in pages] == [(f"text {i}\nmore {i}", True) for i in range(12)]
