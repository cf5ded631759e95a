import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.llm import html_text, top_k

P = "A paragraph of the article that goes on for quite a while, so that it counts as text."


@pytest.mark.parametrize("html, want", [
    ("", ""), ("plain text only, no tags at all", "plain text only, no tags at all"), ("<p></p><div> \n </div>", ""),
    (f"<html><body><nav><a href=x>Home</a></nav><article><h1>T</h1><p>{P}<p>Short.</article><footer>&copy; x</footer></body></html>", f"T\n\n{P}\n\nShort."),
    (f"<article><p>a &amp; b &lt;i&gt; &#233; &nbsp;c</p><script>var x='</p>';</script><p>{P}</p></article>", f"a & b <i> é c\n\n{P}"),
    (f"<body><div class='sidebar'><p>{P} side</p></div><main><p>{P}</p><p>{P}</p></main><div id=comments><p>{P} me too</p></div></body>", f"{P}\n\n{P}"),
    (f"<article><p><b>{P}<br>more<p>next</article>", f"{P} more\n\nnext"),
    (f"<article><p>{P}</p><form><p>Your name</p><input></form><aside>{P}</aside><p>end</p></article>", f"{P}\n\nend"),
    (f"<article><p>{P}</p><div class='ad banner'>Buy</div><ul><li>one</li><li>two</ul></article>", f"{P}\n\none\n\ntwo"),
    ("<article><p>unclosed", "unclosed"), ("<article><p>x</p></article><!-- <p>no</p> -->", "x"), ("<<<>>>&#xFFFFFF;", None),
])
def test_pages(html, want):
    got = html_text.main_text(html)
    assert got == want if want is not None else isinstance(got, str)


def test_long_paragraphs_beat_link_lists():
    links = "".join(f"<div><a href=/{i}>item {i}</a></div>" for i in range(12))
    page = f"<body><div>{links}</div><div><p>{P} {P}</p><p>{P} {P}</p><p>{P}</p></div><div>{links}</div></body>"
    assert html_text.main_text(page) == f"{P} {P}\n\n{P} {P}\n\n{P}"


def test_ratios_decide_in_articles():
    links = "".join(f"<li><a href=/{i}>See also item {i}</a></li>" for i in range(8))
    short = "".join(f"<p>Nice {i}</p>" for i in range(8))
    page = f"<article><h1><a href=/t>Title</a></h1><p>{P} {P}</p><ul><li>one</li><li>two</li></ul><p>{P} {P}</p><p>Short.</p><ul>{links}</ul><div>{short}</div></article>"
    assert html_text.main_text(page) == f"Title\n\n{P} {P}\n\none\n\ntwo\n\n{P} {P}\n\nShort."
    linked = "".join(f"<p><a href=/{i}>See also item {i}</a></p>" for i in range(8))
    assert html_text.main_text(f"<article><p>{P} {P}</p><p>{P}</p>{linked}</article>") == f"{P} {P}\n\n{P}"


def test_text_outside_teaser_articles_is_kept():
    cards = "".join(f"<article><h3><a href=/{i}>Card {i}</a></h3></article>" for i in range(6))
    page = f"<body><div id=story><p>{P} {P}</p><p>{P}</p><p>{P} {P}</p></div><div>{cards}</div></body>"
    assert html_text.main_text(page) == f"{P} {P}\n\n{P}\n\n{P} {P}"


@pytest.mark.parametrize("mark", ["content has-sidebar", "no-sidebar", "with-comments", "post-share-enabled", "search-results", "ad-free", "social-policy", "sidebar"])
def test_class_words_do_not_hide_content(mark):
    assert html_text.main_text(f"<body><div class='{mark}'><p>{P}</p><p>{P} {P}</p></div></body>") == f"{P}\n\n{P} {P}"
    wrapped = f"<body><div class='{mark}'><h2>Head</h2><article><p>{P}</p><p>{P}</p></article><div class=comments><article>{P} me too</article></div></div></body>"
    assert html_text.main_text(wrapped) == f"Head\n\n{P}\n\n{P}"


@pytest.mark.parametrize("mark", ["ad", "x ad-banner", "sidebar_2", "Cookie-Notice"])
def test_furniture_stays_out(mark):
    assert html_text.main_text(f"<body><div class='{mark}'>{P} {P}</div><article><p>Short.</p></article></body>") == "Short."
    assert html_text.main_text(f"<article><p>{P}</p><p>a <span id='{mark}'>Buy</span> b</p></article>") == f"{P}\n\na\n\nb"


def test_smoothing_keeps_constants_and_clusters_part():
    assert np.allclose(html_text.smooth(np.full(7, 3.0)), 3)
    assert 10 < html_text.threshold(np.array([1.0, 2, 1, 90, 100, 95])) < 90
    assert html_text.threshold(np.array([5.0, 6.0])) == 5


def test_page_rows(spark):
    df = spark.createDataFrame([(1, "u", None, 9), (2, None, "", 9), (3, "u", "<p>é😀</p>" + "<b>" * 3000, 9), (3, "u", "<p>é😀</p>", 9)], "page_id long, url string, html string, text int")
    rows = sorted((r.page_id, r.text, r.n_chars) for r in html_text.extract(df).collect())
    assert rows == [(1, "", 0), (2, "", 0), (3, "é😀", 2), (3, "é😀", 2)]
    assert html_text.extract(df.limit(0)).count() == 0 and html_text.extract(df).columns == ["page_id", "url", "text", "n_chars"]


def brute(rows, k):
    vectors = {i: np.floor(64 * np.array(v, np.float64)).astype(np.int64) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)}
    out = []
    for q in vectors:
        if q % 20 == 0:
            found = sorted((-int(vectors[q] @ v), i) for i, v in vectors.items() if i != q and len(v) == len(vectors[q]))[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(found)]
    return sorted(out)


@pytest.mark.parametrize("seed, n, d, shard, block, leaf", [(1, 700, 8, 100, 7, 16), (2, 400, 3, 1000, 1000, 256), (3, 60, 4, 10, 2, 4)])
def test_search_equals_brute_force(spark, monkeypatch, seed, n, d, shard, block, leaf):
    monkeypatch.setattr(top_k, "LEAF", leaf)
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, d))
    rows = [(i, [float(np.float32(x)) for x in (centres[rng.integers(6)] + rng.normal(size=d) * 0.1).round(2)]) for i in range(n)]
    rows += [(n + 20 - n % 20, None), (5001, []), (5020, [None] * d), (5040, [float("nan")] * d), (5060, [float("inf")] * d), (None, [0.0] * d)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("shard", F.lit(1)).withColumn("score", F.lit("x"))
    vectors = top_k.whole_vectors(df)
    got = top_k.search(vectors.filter("vec_id % 20 = 0"), vectors, shard_rows=shard, query_block=block)
    assert sorted(tuple(r) for r in got.collect()) == brute(rows, 20)


def test_search_of_nothing(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    v = top_k.whole_vectors(df)
    assert top_k.search(v, v).count() == 0


def test_bounds_hold_and_leaves_cover_all():
    rng = np.random.default_rng(0)
    vectors = rng.integers(-20, 20, (3000, 6)).astype(float)
    tree = top_k.BallTree(np.arange(3000), vectors)
    queries = rng.integers(-20, 20, (40, 6)).astype(float)
    bound = tree.bounds(queries)
    assert sorted(np.concatenate(tree.ids).tolist()) == list(range(3000))
    for j, v in enumerate(tree.vectors):
        assert ((queries @ v.T).max(axis=1) <= bound[:, j]).all()


FURNITURE_NAMES = ["comments-section", "comment-list", "comments-area", "user-comments", "comment-thread", "cookie-bar", "related-posts", "site-sidebar", "newsletter-box",
                   "ad-slot", "sponsored-content", "relatedPosts", "page_footer"]


@pytest.mark.parametrize("name", FURNITURE_NAMES)
@pytest.mark.parametrize("attribute", ["class", "id"])
def test_named_furniture_stays_out_however_much_it_says(name, attribute):
    body = "".join(f"<p>This is paragraph {i} of the article, and it has a lot of plain words to read in it.</p>" for i in range(6))
    noise = "".join(f"<p>Reader {i} says that this is a long remark with very many plain words and no link at all in it.</p>" for i in range(9))
    for page in (f"<html><body><article>{body}</article><div {attribute}='{name}'>{noise}</div></body></html>",
                 f"<html><body><div><article>{body}<div {attribute}='x1 {name}'>{noise}</div></article></div></body></html>"):
        text = html_text.main_text(page)
        assert text.count("paragraph") == 6 and "Reader" not in text


@pytest.mark.parametrize("name", ["has-sidebar", "no-sidebar", "with-comments", "post-share-enabled", "search-results", "ad-free", "social-policy", "content", "main-content", "adsorption"])
def test_names_that_say_something_else_stay_in(name):
    body = "".join(f"<p>This is paragraph {i} of the text, and it has a lot of plain words to read in it.</p>" for i in range(6))
    for page in (f"<html><body><div class='{name}'><article>{body}</article></div></body></html>", f"<html><body><div><div class='{name}'>{body}</div></div></body></html>"):
        assert html_text.main_text(page).count("paragraph") == 6
