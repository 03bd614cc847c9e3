"""Vector and page operators and the pipeline against brute-force versions."""

import math
import random

import numpy as np
import pytest

from lakeprep.llm import html_text, knn, near_vectors
from lakeprep.llm.components import components


def vector_rows(n=300, dim=8, seed=0):
    rng = np.random.default_rng(seed)
    rows = [(i, [float(v) for v in rng.standard_normal(dim)], int(rng.integers(0, 3))) for i in range(n)]
    for i in range(40):                                             # near copies and exact copies
        v = np.array(rows[i][1])
        rows.append((n + i, [float(x) for x in v + 0.05 * rng.standard_normal(dim) * (i % 4)], rows[i][2]))
    rows += [(900, None, 1), (901, [], 1), (902, [0.0] * dim, 1), (903, [float("nan")] * dim, 1), (904, [float("inf")] * dim, 1),
             (905, rows[0][1], None), (906, [None] * dim, 1), (None, rows[1][1], 1), (907, rows[2][1][:4], rows[2][2]), rows[5]]
    return rows


def fine(v):
    return bool(v) and all(x is not None and math.isfinite(x) for x in v)


def test_near_vectors_match_brute_force(spark):
    rows = vector_rows()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").selectExpr("*", "1 AS id", "2 AS vec", "3 AS copies")
    stored = {r["vec_id"]: (r["embedding"], r["label"]) for r in df.collect()}
    got = near_vectors.near_vectors(df).collect()
    usable = {i: np.array(v) for i, (v, y) in stored.items() if i is not None and fine(v) and any(v) and y is not None}
    links, parent = {i: 0 for i in stored}, {i: i for i in stored}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i
    ids = sorted(usable)
    for a in ids:
        for b in ids:
            if a < b and stored[a][1] == stored[b][1] and len(usable[a]) == len(usable[b]):
                if usable[a] @ usable[b] / (np.linalg.norm(usable[a]) * np.linalg.norm(usable[b])) >= 0.93:
                    links[a] += 1
                    links[b] += 1
                    x, y = sorted((root(a), root(b)))
                    parent[y] = x
    assert len(got) == len(stored)
    for r in got:
        i = r["vec_id"]
        if i is None:
            assert (r["n_links"], r["component_id"], r["kept"]) == (0, None, False)
        else:
            assert (r["n_links"], r["component_id"], r["kept"]) == (links[i], root(i), root(i) == i), i
    assert near_vectors.near_vectors(df.where("false")).count() == 0


def test_near_vectors_large_groups_are_counted_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(near_vectors, "BLOCK", 16)
    monkeypatch.setattr(near_vectors, "ROWS", 64)
    monkeypatch.setattr(near_vectors, "WINDOW", 4)
    rng = np.random.default_rng(1)
    base = rng.standard_normal(16)
    rows = [(i, [float(x) for x in base + 0.01 * rng.standard_normal(16)], 0) for i in range(150)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = near_vectors.near_vectors(df).collect()
    assert {r["component_id"] for r in got} == {0} and {r["n_links"] for r in got} == {149}


def brute_links(vectors, labels):
    x = np.array(vectors, float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    links = (x @ x.T >= 0.93) & (np.array(labels)[:, None] == np.array(labels)[None, :])
    np.fill_diagonal(links, False)
    return links


@pytest.mark.parametrize("mean_cosine", [0.0, 0.7, 0.85, 0.9])
def test_near_vectors_find_the_links_of_crowded_labels(spark, mean_cosine):
    """Labels whose rows share a direction: recall against brute force, and the operator's own measure of it."""
    rng = np.random.default_rng(11)
    n, dim = 2500, 64
    common = rng.standard_normal(dim)
    common /= np.linalg.norm(common)

    def noise(k):
        v = rng.standard_normal((k, dim)) / np.sqrt(dim)
        return v - (v @ common)[:, None] * common

    base = np.sqrt(mean_cosine) * common + np.sqrt(1 - mean_cosine) * noise(n)
    near = base[:400] + 0.33 * noise(400) * rng.random((400, 1))                   # planted neighbours, near and at the threshold
    vectors, labels = np.concatenate([base, near]), [3] * (n + 400)
    df = spark.createDataFrame([(i, [float(v) for v in x], y) for i, (x, y) in enumerate(zip(vectors, labels))], "vec_id long, embedding array<double>, label int")
    links = brute_links(vectors, labels)
    got = {r["vec_id"]: r["n_links"] for r in near_vectors.near_vectors(df).collect()}
    assert all(got[i] <= links[i].sum() for i in got)
    assert sum(got.values()) >= 0.99 * links.sum() > 300


def test_recall_is_measured_against_all_rows(spark):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((60, 8))
    x = np.concatenate([x, x + 0.01, x + 0.02])
    classes = spark.createDataFrame([(i, 1, [float(v) for v in row]) for i, row in enumerate(x)], "id long, label long, vec array<double>")
    whole = spark.createDataFrame([(i, i % 60) for i in range(180)], "id long, component long")
    part = spark.createDataFrame([(i, i % 60) for i in range(120)], "id long, component long")
    links = brute_links(x, [1] * 180)
    inside = sum(links[i, j] for i in range(180) for j in range(180) if i % 60 == j % 60)
    assert near_vectors.measured_recall(classes, whole) == pytest.approx(inside / links.sum())
    assert near_vectors.measured_recall(classes, part) < 0.6
    assert near_vectors.measured_recall(classes.limit(0), whole.limit(0)) == 1.0


def test_passes_grow_with_the_label():
    assert near_vectors.passes(10) <= near_vectors.passes(10_000) < near_vectors.passes(10_000_000)


def test_components_of_paths_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, k) for k in range(8, 60)] + [(3, 3), (5, 4), (4, 5)]
    random.Random(0).shuffle(edges)
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {i: 100 for i in range(100, 161)} | {i: 7 for i in range(7, 60)} | {4: 4, 5: 4}
    assert got == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("blocks", [None, 7])
def test_knn_matches_brute_force(spark, monkeypatch, blocks):
    if blocks:
        monkeypatch.setattr(knn, "QUERY_BLOCK", blocks)
        monkeypatch.setattr(knn, "DATA_BLOCK", 50)
        monkeypatch.setattr(knn, "SAMPLE", 40)
    rng = np.random.default_rng(3)
    rows = [(i, [float(v) for v in rng.integers(-3, 4, 4)]) for i in range(300)]                 # many ties
    rows += [(10, rows[10][1]), (500, None), (501, [1.0, None, 0.0, 0.0]), (502, [float("inf")] * 4), (503, [1.0, 2.0]), (None, [1.0] * 4)]
    df = spark.createDataFrame(rows, "id long, vec array<double>")
    got = {(r["query"], r["rank"]): (r["id"], r["score"]) for r in knn.top_k(df, df.where("id % 5 = 0"), 5).collect()}
    good = {i: np.array(v) for i, v in rows if i is not None and v and None not in v and len(v) == 4 and all(map(math.isfinite, v))}
    want = {}
    for q in (i for i in good if i % 5 == 0):
        best = sorted((-(good[q] @ v), i) for i, v in good.items() if i != q)[:5]
        want |= {(q, k + 1): (i, -s) for k, (s, i) in enumerate(best)}
    assert got == want


@pytest.mark.parametrize("clustered", [True, False])
def test_knn_copies_follow_the_bounds(spark, monkeypatch, clustered):
    """Many cells on clustered data, each row in few of them; without clusters few cells. Results are exact."""
    monkeypatch.setattr(knn, "MOVE", 5)
    monkeypatch.setattr(knn, "DATA_BLOCK", 200)
    rng = np.random.default_rng(6)
    centres = rng.standard_normal((20, 16)) * (4 if clustered else 0)
    vectors = np.round(np.concatenate([c + 0.2 * rng.standard_normal((60, 16)) for c in centres]), 3)
    df = spark.createDataFrame([(i, [float(v) for v in x]) for i, x in enumerate(vectors)], "id long, vec array<double>")
    queries = df.where("id % 7 = 0")
    left, right, _ = knn.copied(df, queries, 5)
    cells = right.select("cell").distinct().count()
    copies = left.groupBy("id", "cell").count().count() / len(vectors)
    assert (cells >= 16 and copies < cells / 4) if clustered else copies <= cells <= 16
    score = vectors @ vectors.T
    got = {}
    for r in knn.top_k(df, queries, 5).collect():
        got.setdefault(r["query"], []).append((r["rank"], r["id"]))
    for q in range(0, len(vectors), 7):
        want = sorted((i for i in range(len(vectors)) if i != q), key=lambda i: (-score[q, i], i))[:5]
        assert [score[q, i] for _, i in sorted(got[q])] == pytest.approx([score[q, i] for i in want])


def test_knn_bounds_hold():
    rng = np.random.default_rng(1)
    for _ in range(30):
        pivots = rng.standard_normal((5, 6)) * 3
        q, x = (pivots[rng.integers(0, 5, 80)] + rng.standard_normal((80, 6)) * rng.random() for _ in range(2))
        cell, own = knn._nearest(q, pivots), knn._nearest(x, pivots)
        far = np.linalg.norm(x - pivots[own], axis=1)
        used = np.unique(cell)
        cells = knn.Cells(used.tolist(), pivots[used], np.array([np.linalg.norm(q[cell == c] - pivots[c], axis=1).max() for c in used]), np.zeros(len(used)))
        score = q @ x.T
        rows = cells.row_bound(x, pivots[own], far)
        for i, c in enumerate(used):
            assert (score[cell == c].max(0) <= rows[:, i] + 1e-9).all()
            for j in np.unique(own):
                pair = cells.pair_bound(pivots[j][None], far[own == j].max()[None], np.linalg.norm(x[own == j], axis=1).max()[None])
                assert score[cell == c][:, own == j].max() <= pair[0, i] + 1e-9


def test_knn_repeated_id_spreads_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(knn, "DATA_BLOCK", 50)
    rows = [(i, [float(i % 7), float(i % 3)]) for i in range(20)] + [(3, [float(k), 1.0]) for k in range(400)]
    df = spark.createDataFrame(rows, "id long, vec array<double>")
    got = {(r["query"], r["rank"]): (r["id"], r["score"]) for r in knn.top_k(df, df.where("id % 5 = 0"), 2).collect()}
    score = lambda q, v: q[0] * v[0] + q[1] * v[1]
    for q in (0, 5, 10, 15):
        own = rows[q][1]
        top = {}
        for i, v in rows:
            if i != q:
                top[i] = max(top.get(i, -1.0), score(own, v))
        want = sorted((-s, i) for i, s in top.items())[:2]
        assert [got[(q, k)] for k in (1, 2)] == [(i, -s) for s, i in want]


def test_knn_small_and_empty_tables(spark):
    df = spark.createDataFrame([(0, [1.0]), (50, [2.0])], "id long, vec array<double>")
    assert sorted(tuple(r) for r in knn.top_k(df, df, 5).collect()) == [(0, 1, 50, 2.0), (50, 1, 0, 2.0)]
    assert knn.top_k(df.where("false"), df, 5).count() == 0 and knn.top_k(df, df.where("false"), 5).count() == 0


PAGES = [
    ("<html><head><title>T</title><style>p{}</style><script>var t='</p>';</script></head><body><nav><ul><li>Menu</ul></nav>"
     "<div class='ad'>Buy</div><article><h1>Head &amp; line</h1><p>One <b>two<br>three<p>A&nbsp;B  c &lt;i&gt;</p><aside>Related</aside>"
     "<form>Name <input></form></article><div id='comments'><article class='comment'>Nice</article></div><footer>F</footer>", "Head & line\nOne two three\nA B c <i>"),
    ("<main><header><h2>Title</h2><p>by X</p></header><p>Text</p><!-- <p>no</p> --></main><p>after</p>", "Title\nText"),
    (None, ""), ("", ""), ("plain words < only", "plain words < only"), ("<script>x", ""), ("<article></article>", ""),
    ("<article><p>" + "long " * 5000 + "</p>", ("long " * 5000).strip()),
]


def test_main_text_by_markup(spark):
    df = spark.createDataFrame([(i, f"http://h{i}.org/x", h) for i, (h, _) in enumerate(PAGES)], "page_id long, url string, html string")
    df = df.selectExpr("*", "'x' AS id", "'y' AS host", "'z' AS text")
    got = {r["page_id"]: r for r in html_text.main_text(df).collect()}
    for i, (_, text) in enumerate(PAGES):
        assert got[i]["text"] == text and got[i]["n_chars"] == len(text) and got[i]["url"] == f"http://h{i}.org/x"
    assert html_text.main_text(df.where("false")).count() == 0


def brute_runs(pages, depth):
    """Tokens of each page that no long window shares with a different page."""
    where = {}
    for p, words in enumerate(pages):
        for k in range(len(words) - depth + 1):
            where.setdefault(tuple(words[k:k + depth]), set()).add(tuple(words))
    out = []
    for words in pages:
        gone = [False] * len(words)
        for k in range(len(words) - depth + 1):
            if len(where[tuple(words[k:k + depth])]) > 1:
                gone[k:k + depth] = [True] * depth
        out.append(" ".join(w for w, g in zip(words, gone) if not g))
    return out


@pytest.mark.parametrize("shard_pages", [2000, 3])
def test_main_text_drops_passages_repeated_on_a_host(spark, monkeypatch, shard_pages):
    monkeypatch.setattr(html_text, "SHARD_PAGES", shard_pages)
    rng = random.Random(4)
    words = lambda n: [f"w{rng.randrange(5000)}" for _ in range(n)]
    top, low = words(12), words(20)
    pages = [top + words(rng.randrange(0, 40)) + low for _ in range(20)]
    pages.append(pages[0])                                          # a copy is no second page
    df = spark.createDataFrame([(i, "http://one.org/" + str(i), f"<div>{' '.join(p)}</div>") for i, p in enumerate(pages)]
                               + [(99, "http://two.org/", f"<div>{' '.join(pages[0])}</div>"), (100, None, "<p>x</p>")], "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in html_text.main_text(df).collect()}
    assert [got[i] for i in range(len(pages))] == brute_runs(pages, html_text.LONG)
    assert got[99] == " ".join(pages[0]) and got[100] == "x"


@pytest.mark.parametrize("page, text", [
    ("<script>for(i=0;i<n;i++){go(i);}</script><article><p>Whole</article><script>x</script>", "Whole"),
    ("<style>a<b{c:'d}</style><title>1 <b</title><article><p>Whole</article>", "Whole"),
    ("<SCRIPT>'</scripted' <a</Script ><article>Whole</article>", "Whole"),
    ("<select><option>a<article><p>Whole</article>", "Whole"),
    ("<div class='content-sidebar-wrap'><article><p>Whole</article><p>Out</div>", "Whole"),
    ("<div class='has-sidebar'><main><p>Whole</main></div>", "Whole"),
    ("<div class='with-menu'><p>Whole</div>", "Whole"),
    ("<div class='post-header'><article><h1>H</h1><p>Whole</article></div>", "H\nWhole"),
    ("<article><div class='post-header'><h1>H</h1><p>by X</div><p>Whole<div class='share'>S</div></article>", "H\nWhole"),
    ("<main><div class='has-sidebar x'><article><p>Whole</article></div></main>", "Whole"),
    ("<div class='sidebar'><article><p>Whole</article></div>", "Whole"),
    ("<article><p>Whole</article><div class='sidebar'><article><p>Teaser</article></div>", "Whole"),
    ("<article><p>Whole<div class='related-posts'><article><p>Teaser</article></div></article>", "Whole"),
    ("<article><p>Whole</article><aside><article>No</article></aside><div class='comment-list'><article>No</article></div>", "Whole"),
])
def test_page_markup_keeps_whole_articles(page, text):
    found = html_text.blocks(page)
    main = [t for z, t in found if z == html_text.ARTICLE] or [t for z, t in found if z == html_text.OPEN]
    assert "\n".join(main) == text


def test_main_text_has_one_row_per_page_for_any_url(spark):
    urls = ["Example.com/Page", "EXAMPLE.com/Page", "file:///A.html", "///B", "HTTP://H.org/X", "//H.org", "", None, "Mailto:Me", "http://É.org/\n"]
    df = spark.createDataFrame([(10 * i + k, u, h) for i, u in enumerate(urls) for k, h in enumerate([None, "", "<p>Text", "<article>Whole"])],
                               "page_id long, url string, html string")
    got = {r["page_id"]: (r["url"], r["text"]) for r in html_text.main_text(df).collect()}
    assert got == {10 * i + k: (u, t) for i, u in enumerate(urls) for k, t in enumerate(["", "", "Text", "Whole"])}
    assert html_text.main_text(df).count() == len(got)


@pytest.mark.parametrize("size", [24, 40, 200])
def test_main_text_keeps_copies_of_an_unmarked_article(spark, size):
    rng = random.Random(5)
    words = lambda n: [f"w{rng.randrange(5000)}" for _ in range(n)]
    body, menu, others = words(size), words(14), [words(30) for _ in range(6)]
    page = lambda text, k: f"<nav>{' '.join(words(9))}</nav><div class='ad'>Ad {k} {' '.join(words(k))}</div><p>{' '.join(text)}</p><footer>F {k % 2}</footer>"
    changed = [body[:k] + ["other"] + body[k + 1:] for k in (3, size // 2, size - 1)]
    texts = [body] * 4 + changed + [menu + t for t in others]
    df = spark.createDataFrame([(k, f"http://one.org/{k}", page(t, k)) for k, t in enumerate(texts)], "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in html_text.main_text(df).collect()}
    assert [got[k] for k in range(len(texts))] == [" ".join(t) for t in [body] * 4 + changed + others]


def test_main_text_decides_what_main_holds_beside_an_article(spark):
    rng = random.Random(6)
    words = lambda n: " ".join(f"w{rng.randrange(5000)}" for _ in range(n))
    box, quote, parts = words(20), words(12), [(words(4), words(30), words(15)) for _ in range(5)]
    page = lambda a, b, c: f"<p>out</p><main><h1>{a}</h1><article><p>{b}<p>{quote}</article><div>{box}</div><p>{c}</main><p>{c}"
    df = spark.createDataFrame([(k, f"http://one.org/{k}", page(*p)) for k, p in enumerate(parts)] + [(9, "http://two.org/", page(*parts[0]))],
                               "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in html_text.main_text(df).collect()}
    assert got == {k: "\n".join((a, b, quote, c)) for k, (a, b, c) in enumerate(parts)} | {9: "\n".join((parts[0][0], parts[0][1], quote, box, parts[0][2]))}


@pytest.mark.parametrize("shard_pages", [2000, 2])
def test_main_text_decides_sections_of_articles_by_the_host(spark, monkeypatch, shard_pages):
    """Every page passes the suffix arrays: a section whose class may mean either stays if it is the page's own."""
    monkeypatch.setattr(html_text, "SHARD_PAGES", shard_pages)
    rng = random.Random(8)
    words = lambda n: " ".join(f"w{rng.randrange(5000)}" for _ in range(n))
    nav, board, names = words(12), words(20), ["notice-board", "menu-items", "related-work", "page-banner"]
    page = lambda k, own: (f"<nav>{nav}</nav><article><p>{texts[k]}<div class='{names[k % 4]}'>{own}</div>"  # noqa: E731
                           f"<div class='main-notice'><p>{board[:40]}<p>{board[40:]}</div><div class='related-box'>More here</div><p>{ends[k]}</article>")
    texts, ends, lists = [words(30) for _ in range(6)], [words(15) for _ in range(6)], [[words(4), words(3), words(9 * (k % 2))] for k in range(6)]
    owns = ["".join(f"<li>{x}" for x in own) for own in lists]
    df = spark.createDataFrame([(k, f"http://one.org/{k}", page(k, owns[k])) for k in range(6)]
                               + [(6, "http://one.org/0?copy", page(0, owns[0])), (7, "http://two.org/", page(0, owns[0]))], "page_id long, url string, html string")
    got = {r["page_id"]: (r["text"], r["n_repeated"]) for r in html_text.main_text(df).collect()}
    whole = ["\n".join([texts[k], *filter(None, lists[k]), ends[k]]) for k in range(6)]
    alone = "\n".join([texts[0], *filter(None, lists[0]), board[:40].strip(), board[40:].strip(), "More here", ends[0]])
    size = [len(x.split()) for x in (nav, board, "More here")]
    assert got == {k: (whole[k % 6], sum(size)) for k in range(7)} | {7: (alone, 0)}
    assert html_text.blocks(page(0, owns[0]))[2][0] in html_text.LISTED


@pytest.mark.parametrize("page, text", [
    ("<main><p>Food<div class='menu-items'><li>Soup 5<li>Fish 9</div></main>", "Food\nSoup 5\nFish 9"),
    ("<article><p>A<div class='related-work'><p>Of others</div><p>B</article>", "A\nOf others\nB"),
    ("<article><p>A<div class='notice-board'><p>Of the town</div><div class='ad-banner'>Buy</div><div class='menu'>M</div></article>", "A\nOf the town"),
    ("<article><p>A<div class='related-posts'><p>Own<article>Teaser</article></div><aside>No</aside></article>", "A\nOwn"),
    ("<article><p>A <span class='search-term'>b</span></article><div class='menu-items'>No</div>", "A"),
    ("<main><p>A<div class='related-work'>Out</div><article><p>Whole</article></main>", "A\nWhole"),
])
def test_class_words_of_two_meanings_break_ties(spark, page, text):
    assert html_text.main_text(spark.createDataFrame([(1, "u", page)], "page_id long, url string, html string")).first()["text"] == text


def test_pipeline_keeps_other_texts_of_an_id(spark):
    import corpus_pipeline as cp
    long = "one two three four five six seven eight nine ten eleven twelve"
    rows = [(1, long, "en"), (1, long, "de"), (1, "quite another text with six words and more", "en"), (2, long, "en"), (3, long + " and one word more", "en"),
            (3, None, "en"), (3, " \n", "en"), (4, "", "en"), (None, long, "en"), (None, long, "en"), (5, "the last one stays as it is alone", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "'s' AS source", "1 AS n_chars")
    got = sorted(((r["doc_id"], r["text"], r["lang"]) for r in cp.one_of_a_group(spark, docs, "").collect()), key=str)
    want = [(1, long, "de"), rows[2], *rows[4:]]                     # of two equal texts of one id the smaller row
    assert got == sorted(want, key=str)
    assert cp.one_of_a_group(spark, docs.limit(0), "").count() == 0


def test_pipeline_groups_hold_near_copies_only(spark, monkeypatch):
    """Unrelated documents that share runs of words move to no block of the third stage."""
    import random

    import corpus_pipeline as cp
    from lakeprep.llm import jaccard
    for name, value in (("LONG_LIST", 3), ("RANKED", 0), ("FREQUENT", 0)):
        monkeypatch.setattr(jaccard, name, value, raising=False)
    rng = random.Random(11)
    runs = [" ".join(f"r{i}x{k}" for k in range(5)) for i in range(12)]
    texts = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(60)) + " " + " ".join(rng.sample(runs, 8)) for _ in range(60)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, texts[7] + " end"])], "doc_id long, text string").selectExpr("*", "'en' AS lang", "'s' AS source", "1 AS n_chars")
    seen, stage = {}, jaccard.stage
    monkeypatch.setattr(jaccard, "stage", lambda df, label: seen.setdefault(label, stage(df, label)))
    assert sorted(r["doc_id"] for r in cp.one_of_a_group(spark, docs, "").collect()) == list(range(60))
    assert seen["related-sets"].count() == 2


def test_pipeline_stages_on_a_fixture(spark, tmp_path):
    import corpus_pipeline as cp
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert [n for n, _ in cp.STAGES] == ["toxicity", "quality classifier", "n-gram Jaccard join", "PII", "packing"]
    seen = []
    for k, (_, step) in enumerate(cp.STAGES):
        out = step(spark, docs, sf)
        out.write.parquet(str(tmp_path / str(k)))
        out = spark.read.parquet(str(tmp_path / str(k)))
        if k < 4:
            assert set(out.columns) == set(docs.columns)
        seen.append((docs, out))
        docs = out
    truth = {r["doc_id"]: r for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    ids = lambda df: {r[0] for r in df.select("doc_id").collect()}
    gone = ids(seen[0][0]) - ids(seen[0][1])
    assert gone and sum(truth[i]["toxic"] == 1 for i in gone if i in truth) >= 0.9 * sum(i in truth for i in gone)
    gone = ids(seen[1][0]) - ids(seen[1][1])
    assert gone and sum(truth[i]["quality"] == 0 for i in gone if i in truth) >= 0.9 * sum(i in truth for i in gone)
    from test_text_operators import brute_components
    rows = seen[2][0].orderBy("doc_id").collect()
    groups = brute_components([r["text"] for r in rows])
    assert ids(seen[2][1]) == {rows[k]["doc_id"] for k, (_, c) in groups.items() if k == c}
    before, after = ({r["doc_id"]: r for r in x.collect()} for x in seen[3])
    from lakeprep.llm import pii
    for i, r in before.items():
        own = list(pii.entities(r["text"]))
        assert (after[i]["text"] == r["text"]) == (not own) and after[i]["n_chars"] == len(after[i]["text"])
        assert all(r["text"][a:b] not in after[i]["text"] for a, b, k, _ in own if k in ("email", "phone", "card"))
    assert ids(seen[4][1]) == ids(seen[3][1])
