"""HTML extraction, URL filters and embedding near-dedup, against brute force and on odd rows."""

import numpy as np
import pytest

from gramweave.llm import embedding_dedup, html_text, url_filter


def test_main_text():
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><header><p>Site name of ours</p></header>
    <nav><ul><li><a href="/a">A</a></li></ul></nav><!-- ad <p>no</p> --><div class="ad">Buy now, it is cheap.</div><article><h1>Title &amp; more</h1>
    <p><b>First   para<br>graph &lt;here&gt; &eacute;.</b><p>Second.
    <form><input>Mail <button>Go</button></form><p><a href=x>All a link of some words</a></p><div id="comments"><p>Nice words, thanks for the article!</p></div></article>
    <aside>Side words</aside><footer>&copy; us</footer></body>"""
    assert html_text.main_text(page) == "Title & more\n\nFirst para graph <here> é.\n\nSecond.\n\nAll a link of some words"
    assert html_text.main_text(None) == html_text.main_text("") == html_text.main_text("<p></p>") == ""
    assert html_text.main_text("<article><p>Cut &amp; here</p><p cla") == "Cut & here"
    assert html_text.main_text("<article><p>1 < 2 and 3 > 2 &am") == "1 < 2 and 3 > 2 &am"
    assert html_text.main_text('<article class="has-comments"><div class="entry-header"><h1>T</h1><p class=byline>By A</p></div><p>x</p></article>') == "T\n\nBy A\n\nx"
    long = "word " * 200_000
    assert html_text.main_text(f"<main><p>{long}</p></main>") == long.strip()


def test_unclosed_and_self_closed_elements():
    article = "<article><h1>T</h1><p>One two three.</p>{}<p>Four five six.</p></article>"
    want = "T\n\nOne two three.\n\nFour five six."
    for head in ("<head><title>X</title><body>", "<head><title>X</title>", "<head lang=en><meta charset=u><!-- c --><script>var a='<p>'</script>", "<head>", "<title>X</title>", "<head><title>X</title></head><body>"):
        assert html_text.main_text("<html>" + head + article.format("")) == want, head
    for inner in ('<svg width="1" />', "<svg/>", "<svg><path d='m'/></svg>", "<svg><text>no</text></svg>", "<iframe src=x></iframe>", "<object data=x>", "<template>", "<noscript>no</noscript>"):
        assert html_text.main_text(article.format(inner)) == want, inner
    assert html_text.main_text(article.format("<svg/>") + "<p><svg>x</svg></p>") == want
    for inner in ("<script>", "<style>", "<textarea>", "<!--"):
        assert html_text.main_text(article.format(inner)) == "T\n\nOne two three.", inner


def test_tree_fits_its_table():
    for page, labels in html_text.LABELLED:
        found = html_text.blocks(page)
        shares = [html_text.article_share(html_text.tree(), row) > 0.5 for row in html_text.features(found)]
        wrong = sum(s != (c == "y") for s, c in zip(shares, labels))
        assert wrong <= 1, page


def splits(tree):
    return {html_text.FEATURES[tree[0]]} | splits(tree[2]) | splits(tree[3]) if isinstance(tree, tuple) else set()


def test_neighbours_decide_where_nothing_tells_the_article():
    assert {"words", "link density", "words before", "link density before", "words after", "link density after"} <= splits(html_text.tree())
    prose, menu = "<p>" + "water came over the fields at night " * 6 + "</p>", "<ul>" + "<li><a href=x>One more</a></li>" * 4 + "</ul>"
    line = "<p>It was over.</p>"
    text = html_text.main_text
    # The same line stays between paragraphs and at their end, and goes between menus.
    assert "It was over." in text(f"<div>{prose}{line}{prose}</div>") and "It was over." in text(f"<div>{menu}{prose}{line}</div>")
    assert "It was over." not in text(f"<div>{menu}{line}{menu}{prose}{prose}</div>")
    assert text("<div><h1>The old mill</h1><p>" + "word " * 40 + "</p><p>It was over.</p></div>").split("\n\n") == ["The old mill", ("word " * 40).strip(), "It was over."]
    assert text(f"{menu}<h2>Then</h2>{prose}{menu}").startswith("Then\n\n") and "One more" not in text(f"{menu}<h2>Then</h2>{prose}{menu}")


def test_the_tree_on_pages_that_it_has_not_seen():
    wrong = total = 0
    for page, labels in html_text.labelled_pages(150, seed=77):
        found = html_text.blocks(page)
        said = [html_text.article_share(html_text.tree(), row) >= 0.5 for row in html_text.features(found)]
        wrong, total = wrong + sum(s != (c == "y") for s, c in zip(said, labels, strict=True)), total + len(found)
    assert wrong <= 0.01 * total


def article_by_parser(page):
    """An extractor of its own, for pages with one article: the text in it, cut at block tags, without asides, forms and what is named as no part of it."""
    from html.parser import HTMLParser

    class Reader(HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.out, self.now, self.depth, self.skip, self.raw = [], "", 0, 0, 0

        def cut(self):
            if self.now.split():
                self.out.append(" ".join(self.now.split()))
            self.now = ""

        def handle_starttag(self, tag, attrs):
            self.raw += tag in ("script", "style", "title")
            if tag == "br":
                self.now += " "
            elif tag in html_text.BREAKS:
                self.cut()
            self.depth += tag == "article"
            if self.skip or (self.depth and (tag in ("aside", "form", "nav", "footer") or (tag in ("div", "section") and dict(attrs).get("class") in ("ad", "comments")))):
                self.skip += tag in ("aside", "form", "nav", "footer", "div", "section")

        def handle_endtag(self, tag):
            self.raw -= tag in ("script", "style", "title")
            if tag in html_text.BREAKS:
                self.cut()
            if self.skip:
                self.skip -= tag in ("aside", "form", "nav", "footer", "div", "section")
            self.depth -= tag == "article"

        def handle_data(self, data):
            if self.depth and not self.skip and not self.raw:
                self.now += data

    reader = Reader()
    reader.feed(page)
    reader.close()
    reader.cut()
    return "\n\n".join(reader.out)


def test_given_pages_against_another_extractor():
    import pyarrow.parquet as pq

    pages = pq.read_table("/root/testdata/sf0.01/pages.parquet").to_pylist()
    assert [p["page_id"] for p in pages if html_text.main_text(p["html"]) != article_by_parser(p["html"])] == []


@pytest.mark.parametrize("part", ["<a ", '<p title="x', '<p ">" ', "<div>", "<svg>", "<!-- ", "</a ", "&amp;", "<p class='", "<![CDATA[", "</div>", "<title>", 'class="'])
def test_pages_of_a_megabyte_are_read_in_one_pass(part):
    import time

    began = time.perf_counter()
    html_text.main_text(part * (1_000_000 // len(part)))
    assert time.perf_counter() - began < 5  # the quadratic reading took hours


def test_columns_that_differ_in_capitals(spark):
    pages = spark.createDataFrame([(1, "<p>a</p>", "http://a.org/x", "T", 5, "H", "R")], "page_id long, HTML string, url string, Text string, N_chars int, Host string, RULE string")
    assert html_text.extract_text(pages).columns == ["page_id", "url", "Host", "RULE", "text", "n_chars"]
    rules = spark.createDataFrame(RULES, url_filter.RULES)
    out = url_filter.filter_urls(pages, rules)
    assert out.columns == ["page_id", "HTML", "url", "Text", "N_chars", "host", "path", "rule", "verdict"] and out.first().host == "a.org"


def test_extract_text(spark):
    schema = "page_id long, url string, html string, text string, n_chars int, extra map<string,int>"
    pages = spark.createDataFrame([(1, "u", "<article><p>a b</p></article>", "old", 1, {"a": 1}), (2, None, None, None, None, None), (2, None, None, None, None, None), (None, "v", "", None, None, None)], schema)
    out = html_text.extract_text(pages)
    assert out.columns == ["page_id", "url", "extra", "text", "n_chars"]
    assert sorted((r.page_id or 0, r.text, r.n_chars) for r in out.collect()) == [(0, "", 0), (1, "a b", 3), (2, "", 0), (2, "", 0)]
    assert html_text.extract_text(spark.createDataFrame([], schema)).count() == 0


RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"), ("a+b.net", "/x(y)/", "block"), ("org", "/", "allow"), (None, "/", "block"), ("net", "/q/", "allow"), ("net", "/q/", "block")]
URLS = [None, "", "no scheme", "http://", "http://Example.ORG", "http://example.org/", "https://www.example.org/es/1", "https://example.org/es", "https://xexample.org/es/1", "http://a.example.org/en/12?x#y", "http://example.org/en/2",
        "http://x.com/fr/1", "http://x.com/de/", "http://com/de/", "http://y.com/de", "http://u:p@a+b.net:80/x(y)/", "http://a+b.net/x(y)/z", "http://aab.net/xy/z", "ftp://z.net/q/r", "http://a/b?c://example.org/es/", "x://y\nz.org/\n", "http://example.org/es/1", "http://example.org/es/1"]


def brute(url, rules):
    url = url or ""
    host = path = ""
    if "://" in url:
        rest = url.split("://", 1)[1]
        cut = next((i for i, c in enumerate(rest) if c in "/?#"), len(rest))
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
        path = rest[cut:].split("?")[0].split("#")[0]
    hits = [(-len(h + p), v != "block", h + p, v) for h, p, v in rules if h and (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = min(hits, default=(0, 0, None, "allow"))
    return host, path, best[2], best[3]


@pytest.mark.parametrize("small", [1 << 20, 0])
def test_url_filter(spark, small):
    pages = spark.createDataFrame([(i, u, "e", "r", 1) for i, u in enumerate(URLS)], "page_id long, url string, host string, rule string, token int")
    rules = spark.createDataFrame(RULES, url_filter.RULES)
    out = url_filter.filter_urls(pages, rules, small=small)
    assert {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in out.collect()} == {i: brute(u, RULES) for i, u in enumerate(URLS)}
    assert out.count() == len(URLS) and "token" in out.columns
    assert {r.verdict for r in url_filter.filter_urls(pages, spark.createDataFrame([], url_filter.RULES)).collect()} == {"allow"}
    assert url_filter.filter_urls(pages.limit(0), rules).count() == 0


def test_rule_index_takes_the_rarest_token(spark):
    found = {r.rule: r.token for r in url_filter.rule_index(spark.createDataFrame(RULES, url_filter.RULES)).collect()}
    assert found["example.org/es/"] == "/es" and found["com/fr/"] == "/fr" and found["org/"] == ".org" and found["example.org/en/1"] == "/en"


def vectors(n, seed=1, dims=64):
    r = np.random.default_rng(seed)
    base = r.normal(size=(n, dims))
    out = []
    for i in range(n):
        x = base[i] if i % 3 else base[0] + r.normal(size=dims) * r.choice([0.05, 0.15, 0.27, 0.3])
        out.append((i, [float(v) for v in x.astype("f4")], int(i % 4 == 1)))
    return out


def want(rows, link=0.93):
    able = [(i, np.array(v, dtype="f8") / np.linalg.norm(v), l) for i, v, l in rows]
    links = {i: [j for j, w, m in able if j != i and l == m and float(v @ w) >= link] for i, v, l in able}
    name = {i: i for i in links}
    while True:
        new = {i: min([name[i], *(name[j] for j in links[i])]) for i in name}
        if new == name:
            return {i: (len(links[i]), name[i], name[i] == i) for i in links}
        name = new


@pytest.mark.parametrize("block", [37, 2048])
def test_embedding_links(spark, block):
    rows = vectors(600)
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3)
    found = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_dedup.embedding_links(frame, block=block).collect()}
    assert sum(n for n, _, _ in want(rows).values()) > 1000
    assert found == want(rows)


@pytest.mark.parametrize("common", [0.0, 0.5, 2.0, 3.0, 4.0])
def test_embedding_links_of_vectors_that_share_a_direction(spark, common):
    """At 2 : 1 the common part alone makes a cosine of 0.8, at 4 : 1 of 0.94. A fifth of the vectors is a copy with a cosine around the limit."""
    r, n, dims = np.random.default_rng(4), 900, 64
    axis = r.normal(size=dims)
    own = common * axis / np.linalg.norm(axis) + r.normal(size=(n, dims)) / np.sqrt(dims)
    for i in range(0, n, 5):
        other = own[(i + 1) % n]
        noise = r.normal(size=dims)
        noise -= noise @ other / (other @ other) * other
        c = r.uniform(0.93, 0.95)
        own[i] = other / np.linalg.norm(other) + noise / np.linalg.norm(noise) * np.sqrt(1 / c**2 - 1)
    rows = [(i, [float(x) for x in v.astype("f4")], "ab"[i // 450]) for i, v in enumerate(own)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label string")
    found = {x.vec_id: (x.n_links, x.component_id, x.kept) for x in embedding_dedup.embedding_links(frame, block=300).collect()}
    expected = want(rows)
    links = sum(x[0] for x in expected.values())
    assert links >= 300 and all(found[i][0] <= expected[i][0] for i in found)
    assert sum(x[0] for x in found.values()) >= 0.99 * links
    assert sum(found[i][1] == expected[i][1] for i in found) >= 0.99 * n


def test_embedding_tables_lose_no_more_than_planned():
    r = np.random.default_rng(6)
    sample = embedding_dedup.unit(r.normal(size=(3000, 64)))
    model = embedding_dedup.fit(sample)
    a = sample[:2000]
    noise = r.normal(size=a.shape)
    noise -= np.einsum("ij,ij->i", noise, a)[:, None] * a
    b = 0.93 * a + np.sqrt(1 - 0.93**2) * embedding_dedup.unit(noise)
    for n in (1 << 10, 1 << 16, 1 << 22):
        bits, tables, radius = embedding_dedup.plan(n, round(1.05 * embedding_dedup.differing(0.93, 0.5), 3))
        x, y = (embedding_dedup.keys(embedding_dedup.codes(v, model), bits, tables) for v in (a, b))
        near = np.bitwise_count(embedding_dedup.codes(a, model)[:, 0] ^ embedding_dedup.codes(b, model)[:, 0]) <= radius
        assert ((x == y).any(axis=1) & near).mean() >= 0.995, n
        assert (x != np.roll(x, 1, axis=0)).mean() > 1 - 2 / 2**bits  # and buckets divide what isn't alike


def test_embedding_links_of_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    one = [1.0] + [0.0] * 9
    rows = [(1, None, 0), (2, [], 0), (3, [0.0] * 10, 0), (4, [nan] * 10, 0), (5, [inf] + [0.0] * 9, 0), (6, [None] + [1.0] * 9, 0), (7, one, None), (8, one, 0), (9, one, 0), (9, one, 0), (10, [2.0] + [0.0] * 9, 0), (11, one, 1), (12, [1.0], 0), (13, [1e300] + [-0.0] * 9, 0), (None, one, 0), (None, one, 5)]
    frame = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<double>, label int, node int, v string")
    found = sorted(((r.vec_id or 0, r.n_links, r.component_id, r.kept) for r in embedding_dedup.embedding_links(frame).collect()), key=repr)
    same = [(8, 5, 8, True), (9, 5, 8, False), (9, 5, 8, False), (10, 5, 8, False), (13, 5, 8, False), (0, 5, 8, False)]
    assert found == sorted([(i, 0, i, True) for i in (1, 2, 3, 4, 5, 6, 7, 11, 12)] + same + [(0, 0, None, True)], key=repr)
    assert embedding_dedup.embedding_links(frame.limit(0)).count() == 0
    assert embedding_dedup.embedding_links(frame.where("vec_id = 1")).count() == 1


def test_codes_are_balanced():
    sample = embedding_dedup.unit(np.random.default_rng(1).normal(size=(4000, 64)))
    found = embedding_dedup.codes(sample, embedding_dedup.fit(sample))
    share = np.unpackbits(found.view("u1").reshape(-1, 8), axis=1).mean(axis=0)
    assert (abs(share - 0.5) < 0.1).all()


def test_embedding_links_of_ids_of_any_type_and_of_repeated_ids(spark):
    a, near, b = [1.0, 0.0, 0.0], [1.0, 0.1, 0.0], [0.0, 1.0, 0.0]
    rows = [("x1", a, 0), ("x1", b, 0), ("x5", near, 0), ("x7", b, 0), (None, near, 0)]
    found = embedding_dedup.embedding_links(spark.createDataFrame(rows, "vec_id string, embedding array<double>, label int"))
    got = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in found.collect()), key=repr)
    assert got == sorted([("x1", 2, "x1", True), ("x1", 1, "x1", True), ("x5", 2, "x1", False), ("x7", 1, "x1", False), (None, 2, "x1", False)], key=repr)


PROSE = "".join("<p>" + "water came over the fields at night and was gone by noon " * n + "</p>" for n in (2, 4, 3, 5))


@pytest.mark.parametrize(
    "page",
    [
        "<div id=social-history>{}</div>",
        "<nav><ul><li><a href=x>Home</a></li></ul></nav><div class='share-prices report'>{}</div><footer><p>End</p></footer>",
        "<article><section class='notice share'>{}</section></article>",
        "<article><h1>The flood</h1><section class='notice share'>{}</section></article>",
        "<main><div class='promo-letters'>{}</div></main>",
    ],
)
def test_a_name_on_most_of_the_page_takes_no_article_away(page):
    kept = html_text.main_text(page.format(PROSE)).split("\n\n")
    assert [x for x in kept if x.startswith("water")] == [x.strip() for x in PROSE.replace("<p>", "").split("</p>")[:-1]]


@pytest.mark.parametrize("name", ["cookie-notice", "site-footer", "share", "ad", "comments", "comment-list", "user-comments"])
def test_named_parts_beside_the_article_still_go(name):
    part = f"<div class='{name}'><p>words that are not of the article at all, and some more</p></div>"
    for page in ("<article>{}{}</article>", "<article>{}</article>{}", "<div>{}</div>{}"):
        assert html_text.main_text(page.format(PROSE, part)) == html_text.main_text(page.format(PROSE, "")), page
    many = "<div class='comments'>" + "<p>a reader has an opinion about water and fields and noon</p>" * 30 + "</div>"
    assert "opinion" not in html_text.main_text(f"<article>{PROSE}{many}</article>") and "opinion" not in html_text.main_text(f"<article>{PROSE}</article>{many}")
