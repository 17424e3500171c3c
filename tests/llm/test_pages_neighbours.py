"""Page extraction and neighbour search: expected texts, recall against brute force, odd cases."""

import html
import itertools
import random
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docsift.llm import neighbours, pages, queries

SF = "/root/testdata/sf0.01"


def text_of(page):
    return pages.main_text(pages.parsed(page), {})


@pytest.mark.parametrize(
    "page, want",
    [
        (None, ""),
        ("", ""),
        ("no tags &amp; all\n  text", "no tags & all text"),
        ("<p>a <b>b</b>c<p>d&nbsp;e<br>f", "a bc\nd e\nf"),
        ("<nav>x</nav><main><h1>T</h1><p>one</p><div class='comments'><p>no</p></div></main><footer>y</footer>", "T\none"),
        ("<div id='sidebar'>x</div><div class='post'><p>a<p>b</div><div class='ad-banner'>y</div>", "a\nb"),
        ("<article><header><h1>T</h1></header><p>a</p><form>f</form><aside>s</aside></article><p>outside</p>", "T\na"),
        ("<script>var a='<p>x</p>'</script><style>p{}</style><p>a</p><noscript>n</noscript>", "a"),
        ("<p>a<!-- <p>b</p> -->c</p>", "ac"),
        ("<ul><li>a<li>b</ul><table><tr><td>c<td>d</table>", "a\nb\nc\nd"),
        ("<p>1 &lt; 2 &#x41;&#66; &unknown;</p>", "1 < 2 AB &unknown;"),
        ("<p>cut in the &am", "cut in the &am"),
        ("<div class=cookie-notice>c</div><p hidden>h</p><p style='display: none'>n</p><p>a</p>", "a"),
        ("<p>a</b></i></p></div><p>b", "a\nb"),
        ("<article><section id=discussion><p>a</p></section><div class='legal-analysis search-results related-work'>b</div></article>", "a\nb"),
        ("<p>a</p><div id=discussion>c</div><div class=related-posts>r</div><section class=related-work>b</section>", "a\nb"),
    ],
)
def test_blocks(page, want):
    assert text_of(page) == want


def story(i):
    r = random.Random(i)
    line = lambda n: " ".join("".join(r.choices("abcdefgh", k=5)) for _ in range(n))
    return line(4), [line(r.randrange(20, 40)) for _ in range(r.randrange(2, 6))]


def bare(i):
    """A page that names nothing: neither elements nor classes tell what its parts are."""
    title, lines = story(i)
    return f"<dl><dt>Welcome to our site</dt><dd>Sale of the day {i % 3}</dd></dl><section><h1>{title}</h1>" + "".join(f"<p>{x}</p>" for x in lines) + f"</section><table><tr><td>{i} visitors since May</td></tr></table><div>All rights reserved</div>"


def test_template_of_a_host(spark):
    rows = [(i, "http://a.example/x", bare(i), "t", 1) for i in range(8)] + [(20 + i, "http://two.example/", bare(20 + i), "t", 1) for i in range(2)]
    rows += [(100 + i, "http://b.example/", "<article><p>A copy</p><p>of one text</p></article>", "t", 1) for i in range(9)]
    rows += [(200, None, "<p>alone</p>", None, None), (201, "odd", None, None, None), (None, "http://c.example", "", None, None), (202, "http://d.example", "<p>" + "x " * 200_000, None, None)]
    table = spark.createDataFrame(rows, "page_id long, url string, html string, text string, h int")
    got = {r.page_id: r for r in pages.extract(table).collect()}
    assert len(got) == len(rows)
    for i in [*range(8), 20, 21]:
        assert got[i].text == "\n".join([story(i)[0], *story(i)[1]]), got[i].text
        assert "Welcome" in pages.main_text(pages.parsed(bare(i)), {})  # without its template
    assert all(got[100 + i].text == "A copy\nof one text" for i in range(9))
    assert got[200].text == "alone" and got[201].text == got[None].text == "" and got[202].n_chars == 399_999
    assert pages.extract(table.limit(0)).count() == 0


def test_classes_equal_brute_force(spark):
    html = [bare(i) for i in range(6)] + [bare(0)] * 3  # copies count once
    table = spark.createDataFrame([(1, h, html.count(h)) for h in html], "h long, html string, copies long")
    got: dict = {}
    for r in pages.templates(table).collect():
        assert (r.pages, r["class"]) not in got or got[r.pages, r["class"]]
        got.setdefault((r.pages, r["class"]), set()).add(r.token)
    counts = [Counter(pages.parsed(h).tokens) for h in html[:6]]
    want: dict = {}
    for t in set().union(*counts):
        vector = tuple(c[t] for c in counts)
        if max(vector) == 1:
            want.setdefault(vector, set()).add(t)
    want = [c for v, c in want.items() if sum(v) >= 3 or (sum(v) >= pages.FREQUENT and len(c) >= pages.LARGE)]
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want))


SAME = ["Please read our notice first.", "You may also like these stories.", "Copyright of the whole paper."]
NAMED = ["social-history", "ad-hoc", "banner-image", "footer-notes", "menu-of-the-day", "navigation-history", "comments-on-the-text"]


def in_main(i, body="main"):
    title, lines = story(i)
    return (
        f"<body><{body}><div class=notice>{SAME[0]}</div><h1>{title}</h1>" + "".join(f"<p>{x}</p>" for x in lines)
        + f"<section class='{NAMED[i % 7]}'>Section {i} of {NAMED[i % 7]}.</section><section class=related-posts>{SAME[1]}</section><div class=copyright>{SAME[2]}</div></{body}></body>"
    )


@pytest.mark.parametrize("tokens", [500_000, 0])
def test_what_repeats_on_a_host_goes_from_articles_too(spark, monkeypatch, tokens):
    """Templates decide inside of main; names there count as a whole only; near copies of an article stay; both ways to send templates."""
    monkeypatch.setattr(pages, "BROADCAST_TOKENS", tokens)
    monkeypatch.setattr(pages, "HOST_PAGES", 5)
    rows = [(i, "http://a.example/x", in_main(i)) for i in range(14)]
    near = story(99)[1]
    rows += [(100 + i, "http://b.example/", "<article><h1>Title</h1>" + "".join(f"<p>{x}</p>" for x in near) + f"<p>Copy {i} of it.</p></article>") for i in range(8)]
    rows += [(200 + i, f"http://c{i}.example/", in_main(i)) for i in range(2)]  # a host of one page: nothing to compare
    rows += [(300 + i, "http://e.example/", bare(i)) for i in range(8)]
    got = {r.page_id: r.text for r in pages.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert len(got) == len(rows)
    for i in range(14):
        title, lines = story(i)
        assert got[i] == "\n".join([title, *lines, f"Section {i} of {NAMED[i % 7]}."]), got[i]
    for i in range(8):
        assert got[100 + i] == "\n".join(["Title", *near, f"Copy {i} of it."])
        assert got[300 + i] == "\n".join([story(i)[0], *story(i)[1]])
    for i in range(2):
        assert all(x in got[200 + i] for x in SAME) and f"Section {i}" in got[200 + i]


@settings(max_examples=100, deadline=None)
@given(st.permutations(range(7)))
def test_in_order(seconds):
    got = pages.in_order(list(enumerate(seconds)))
    best = max((c for n in range(8) for c in itertools.combinations(range(7), n) if all(seconds[i] < seconds[j] for i, j in zip(c, c[1:], strict=False))), key=len)
    assert len(got) == len(best) and all(seconds[i] < seconds[j] for i, j in zip(got, got[1:], strict=False))


def test_articles_without_names(spark):
    """The table's pages stripped of article elements and classes give the same text, where hosts have a template and articles some length."""
    source = spark.read.parquet(f"{SF}/pages.parquet")
    bare_ = source.withColumn("html", F.regexp_replace("html", r"</?article>| class=\"[^\"]*\"", ""))
    want = {r.page_id: r.text for r in pages.extract(source).collect()}
    got = pages.extract(bare_).collect()
    alike = [r.text == want[r.page_id] for r in got]
    assert sum(alike) / len(alike) > 0.8, sum(alike) / len(alike)


def test_articles_of_the_table(spark):
    source = {r.page_id: r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    for r in queries.QUERIES["op6_pages"](spark, SF).collect():
        inner = re.search(r"<article>(.*?)(</article>|<footer|$)", source[r.page_id], re.S)[1]
        lines = html.unescape(re.sub(r"<[^>]*>", "", re.sub(r"<(br|/?p|/?h1)[^>]*>", "\n", inner))).split("\n")
        assert r.text == "\n".join(" ".join(x.split()) for x in lines if x.strip()) and r.n_chars == len(r.text)


def brute(ids, v, q, k):
    d = np.sqrt(((v - v[ids == q]) ** 2).sum(1))
    order = [i for i in np.lexsort((ids, d)) if ids[i] != q][:k]
    return [(int(ids[i]), float(d[i])) for i in order]


def recall(got, v, asked):
    ids = np.arange(len(v))
    return np.mean([len({i for i, _ in brute(ids, v, q, 10)} & set(got[got.query_id == q].vec_id)) / 10 for q in asked])


def test_recall_with_descent_and_without(spark):
    v = np.random.default_rng(2).normal(size=(6000, 24)).astype("f4")
    v[7] *= 1e9  # one vector far away harms nobody
    table = spark.createDataFrame([(i, x.tolist(), 1) for i, x in enumerate(v)], "vec_id long, embedding array<float>, node int").repartition(5)
    got = neighbours.nearest(table, lambda i: i % 100 == 0, beam=16).toPandas()
    rough = neighbours.nearest(table, lambda i: i % 100 == 0, beam=16, turns=0).toPandas()
    asked = range(0, 6000, 100)
    full = v.astype("f8")
    for q in asked:
        g, want = got[got.query_id == q], dict(brute(np.arange(6000), full, q, 10))
        assert list(g["rank"].sort_values()) == list(range(1, 11))
        assert all(abs(s - want[i]) < 1e-12 for i, s in zip(g.vec_id, g.score, strict=True) if i in want)
    with_, without = recall(got, full, asked), recall(rough, full, asked)
    assert with_ > 0.9 and without < with_ - 0.05, (with_, without)


def test_the_beam_widens_until_a_sample_is_found(spark):
    """Clusters of about four, each far from all others: from one of them the graph leads nowhere near the rest."""
    r = np.random.default_rng(5)
    v = r.normal(size=(4000, 64))
    v = (r.normal(size=(1000, 64))[r.integers(0, 1000, 4000)] + 1e-3 * v).astype("f4")
    table = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<float>").repartition(4)
    got = neighbours.nearest(table, lambda i: i % 100 == 0).toPandas()
    assert len(got) == 400 and recall(got, v.astype("f8"), range(0, 4000, 100)) >= 0.975


def test_only_the_sample_is_searched_again(spark, monkeypatch):
    """A beam too narrow widens on SAMPLE queries at most; the others are searched once, as well as these."""
    monkeypatch.setattr(neighbours, "BEAM", 12)
    seen, measured = [], neighbours.recall
    monkeypatch.setattr(neighbours, "recall", lambda beams, wanted: seen.append(beams.select("q").distinct().count()) or measured(beams, wanted))
    v = np.random.default_rng(6).normal(size=(2000, 32)).astype("f4")
    table = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<float>").repartition(4)
    got = neighbours.nearest(table, lambda i: i % 8 == 0, degree=10).toPandas()
    assert len(seen) > 1 and max(seen) <= neighbours.SAMPLE, seen
    assert len(got) == 2500 and recall(got, v.astype("f8"), range(0, 2000, 8)) >= 0.96


def near_copies(noise):
    """3000 vectors, a third of them near copies of one, and an outlier."""
    r = np.random.default_rng(3)
    v = r.normal(size=(3000, 16))
    v /= np.sqrt((v * v).sum(1))[:, None]
    v[::3] = v[0] + noise * r.normal(size=(1000, 16))
    v[1] *= 1000
    return v


@pytest.mark.parametrize("noise, kind", [(1e-5, "float"), (1e-9, "double")])
def test_recall_of_near_copies(spark, noise, kind):
    v = near_copies(noise)
    v = v.astype("f4").astype("f8") if kind == "float" else v
    table = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], f"vec_id long, embedding array<{kind}>").repartition(5)
    got = neighbours.nearest(table, lambda i: i % 20 == 0).toPandas()
    hit = [len({i for i, _ in brute(np.arange(3000), v, q, 10)} & set(g.vec_id)) for q, g in got.groupby("query_id")]
    assert len(hit) == 150 and sum(hit) / 1500 > 0.95, sum(hit) / 1500


def test_odd_vectors(spark):
    nan = float("nan")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 2.0]), (4, None), (5, [0.0, 0.0]), (6, [nan, 1.0]), (7, [None, 1.0]), (8, []), (9, [1.0]), (12, [4.0]), (10, [3.0, 0.0]), (10, [3.0, 0.0]), (None, [1.0, 1.0]), (11, [float("inf"), 0.0])]
    rows += [(100 + i, [1.0, 0.0]) for i in range(30)]
    table = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<float>, label string")
    got = neighbours.nearest(table, lambda i: i.isin(0, 3, 5, 6, 9)).orderBy("query_id", "rank").collect()
    assert [r.vec_id for r in got if r.query_id == 0] == [1, 2, *range(100, 108)]
    assert [r.vec_id for r in got if r.query_id == 3] == [0, 1, 2, *range(100, 107)]
    assert [(r.vec_id, r.score) for r in got if r.query_id == 9] == [(12, 3.0)]
    assert {r.query_id for r in got} == {0, 3, 9}
    few = neighbours.nearest(table.where("vec_id in (0, 3, 10)"), lambda i: i == 0).orderBy("rank").collect()
    assert [(r.vec_id, r.score) for r in few] == [(10, 2.0), (3, 5**0.5)]
    assert neighbours.nearest(table.limit(0), lambda i: i == 0).count() == 0


def test_lists_of_a_hub_are_merged_as_they_pass(spark, monkeypatch):
    """A turn shuffles a row of lists for each node and call, not a row for each pair; node 0 has more lists than are merged at once."""
    from pyspark.sql import functions as F

    monkeypatch.setattr(neighbours, "LISTS", 3)
    draw = np.random.default_rng(4)
    edges = [(0 if i % 2 else int(draw.integers(1, 9)), int(draw.integers(100, 160)), bool(draw.integers(2))) for i in range(900)]
    table = spark.createDataFrame([(u, w, (u * 7 + w * 31) % 50 / 4, old) for u, w, old in edges], "u long, w long, d double, old boolean").repartition(7)
    lists = neighbours.listed(table.sortWithinPartitions("u"))
    assert lists.count() < 100
    got = {(r.u, r.w): (r.d, r.old) for r in neighbours.keep_nearest(lists, 5).collect()}
    pairs = table.groupBy("u", "w").agg(F.min("d").alias("d"), F.max("old").alias("old"))
    want = {(r.u, r.w): (r.d, r.old) for r in neighbours.keep_nearest_ranked(pairs, 5).collect()}
    assert got == want and len(want) == 45
    assert neighbours.keep_nearest(lists.where("u < 0"), 5).count() == 0
