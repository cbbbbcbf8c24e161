import html
import re

import numpy as np
import pytest

from plexmat.llm import hnsw, htmlextract
from plexmat.llm.labelledpages import LABELLED_PAGES


def vectors(n, dim=16, seed=0):
    rng = np.random.default_rng(seed)
    return (rng.normal(size=(n, dim)) + rng.normal(size=(10, dim))[rng.integers(0, 10, n)]).astype(np.float32)


def test_recall_over_several_shards(spark):
    x = vectors(3000)
    x[100:400] = x[100]  # a vector that many rows share
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    rows = hnsw.neighbours(df, shard_nodes=700).collect()
    exact, hit, n = x.astype(float), 0, 0
    by = {}
    for r in rows:
        by.setdefault(r.query_id, []).append(r)
    assert sorted(by) == list(range(0, 3000, 20))
    for q, rs in by.items():
        rs.sort(key=lambda r: r["rank"])
        assert [r["rank"] for r in rs] == list(range(1, 21)) and all(r.vec_id != q for r in rs)
        s = exact @ exact[q]
        assert all(abs(r.score - s[r.vec_id]) < 1e-9 for r in rs)
        assert [(-r.score, r.vec_id) for r in rs] == sorted((-r.score, r.vec_id) for r in rs)
        order = [i for i in np.lexsort((np.arange(len(s)), -s)) if i != q][:20]
        hit, n = hit + len({r.vec_id for r in rs} & set(order)), n + 20
    assert hit / n >= 0.95


def test_vectors_that_take_no_part(spark):
    rows = [(0, [1.0, 0.0]), (1, None), (2, [0.0, 0.0]), (3, [float("nan"), 1.0]), (4, [float("inf"), 1.0]), (5, [None, 1.0]), (6, []), (7, [0.5, 0.5]), (7, [0.5, 0.5]), (None, [1.0, 1.0]), (20, [0.0, 1.0]), (40, [1.0, 2.0, 3.0])]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, embedding array<float>, shard int, vector int")
    got = {(r.query_id, r["rank"]): r.vec_id for r in hnsw.neighbours(df).collect()}
    assert got == {(0, 1): 7, (0, 2): 20, (20, 1): 7, (20, 2): 0}
    assert hnsw.neighbours(df.limit(0)).count() == 0


def test_rows_that_repeat_an_id(spark):
    """The smallest vector stands for an id, as a candidate and as a query."""
    rows = [(1, [5.0, 1.0]), (1, [1.0, 1.0]), (20, [9.0, 0.0]), (20, [1.0, 0.0]), (2, [2.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 3.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [(r.query_id, r["rank"], r.vec_id, r.score) for r in hnsw.neighbours(df).orderBy("rank").collect()]
    assert got == [(20, 1, 2, 2.0), (20, 2, 1, 1.0), (20, 3, 3, 0.0)]


def test_model_learns_the_labelled_pages():
    model = htmlextract.train(LABELLED_PAGES)
    wrong = total = 0
    for page in LABELLED_PAGES:
        nodes = htmlextract.parse(page)
        for x, want, p in zip(nodes, htmlextract.labels(nodes), model.marginals(nodes), strict=True):
            if not x.tag:
                total, wrong = total + 1, wrong + ((p > 0.5) != want)
    assert wrong <= 0.02 * total


def test_marginals_equal_enumeration():
    model = htmlextract.train(LABELLED_PAGES[:2])
    nodes = htmlextract.parse("<body><div class=menu><a href=x>Home</a></div><p>Some plain words stand here.</p></body>")
    total, on = 0.0, np.zeros(len(nodes))
    unary = [sum(model.weights[i] * v for i, v in htmlextract.active(x, nodes[0].size)) for x in nodes]
    for code in range(1 << len(nodes)):
        y = [(code >> i) & 1 for i in range(len(nodes))]
        p = np.exp(sum(u for u, b in zip(unary, y) if b))
        for i, x in enumerate(nodes[1:], 1):
            p *= model.pair[not x.tag][y[x.parent]][y[i]]
        total += p
        on += p * np.array(y)
    assert np.allclose(model.marginals(nodes), on / total)


def test_pages_of_the_table(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    got = {r.page_id: r for r in htmlextract.extract(pages).collect()}
    for r in pages.collect():
        blocks = re.split(r"</?(?:p|h1)>", re.search(r"<article>(.*?)(</article>|$)", r.html, re.S)[1])
        want = "\n\n".join(t for b in blocks if (t := " ".join(html.unescape(re.sub(r"<[^>]*>", " ", b)).split())))
        assert got[r.page_id].text == want and got[r.page_id].n_chars == len(want) and got[r.page_id].url == r.url


def test_broken_and_empty_pages(spark):
    body = "The first sentence of a longer text stands here. " * 4
    rows = [(1, "u", None), (2, None, ""), (3, "u", "<p"), (4, "u", f"<article><p>{body}<p>A &amp; B are&nbsp;two letters, aren't they?<br>Yes."), (5, "u", "<script>var a = '<p>x</p>'"), (None, "u", f"<p>{body}</p>"), (4, "u", f"<article><p>{body}")]
    got = spark.createDataFrame([(*r, 1, "x") for r in rows], "page_id long, url string, html string, n_chars int, text string")
    out = {}
    for r in htmlextract.extract(got).collect():
        out.setdefault(r.page_id, []).append(r.text)
    assert out[1] == out[2] == out[5] == [""] and len(out[4]) == 2
    assert f"{body.strip()}\n\nA & B are two letters, aren't they? Yes." in out[4]
    assert out[None] == [body.strip()]
    assert htmlextract.extract(got.limit(0)).count() == 0


@pytest.mark.parametrize("raw", [
    '<svg class="icon"/>', "<math/>", '<svg class="icon">', "<svg><svg><text>no</text></svg><text>no</text></svg>", "<iframe src='x'>", "<video>", "<SELECT>",
    "<svg><g/><svg/><text>no</text></svg>", "<script>'<p>no</p>'</script>", "<style>no</style>", "<title>no</title>"])
def test_raw_elements_leave_the_rest_of_the_page(raw):
    leaves = [n.text for n in htmlextract.parse(f"<body><a>{raw}</a><article><p>First text.</p>{raw}<p>Second text.</p></article>") if not n.tag]
    assert leaves == ["First text.", "Second text."]


def test_an_unclosed_script_runs_to_the_end():
    assert [n.text for n in htmlextract.parse("<p>One</p><script>no <p>no") if not n.tag] == ["One"]


def test_foreign_marks_and_odd_markup():
    """``data-content`` of a page means nothing; a page takes time linear in its length."""
    import time

    from plexmat.llm.labelledpages import LABELLED_PAGES

    model = htmlextract.train(LABELLED_PAGES)
    body = "<article><p>The council met on Tuesday to discuss the new bridge, which has been closed since spring.</p></article>"
    want = htmlextract.main_text(body, model)
    assert want
    for mark in ("Popover", "1", "0", ""):
        assert htmlextract.main_text(f'<div data-content="{mark}">{body}</div>', model) == want
    assert htmlextract.main_text(body + "<p class='x", model) == want
    began = time.time()
    for junk in ("<a " * 350_000, "<blockquote>" * 20_000 + "</div>" * 100_000, '<a ">"' * 150_000, "<svg " * 200_000, "<!" * 400_000, "<p>x<div>" + "<blockquote>" * 30_000):
        htmlextract.main_text(body + junk, model)
    assert time.time() - began < 30


def test_odd_pages_through_spark(spark):
    rows = [(1, None, '<div data-content="Popover"><article><p>A sentence that is long enough to be the text of a page, surely.</p></article></div>'), (2, "u", "<a " * 100_000)]
    got = {r.page_id: r.text for r in htmlextract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {1: "A sentence that is long enough to be the text of a page, surely.", 2: ""}


def test_scores_are_exact_for_doubles(spark):
    """Components that a float can't hold, and some beyond its range."""
    for scale in (1.0, 1e150):
        rows = [(i, [scale * (0.1 * (i % 7) + 0.01 * i), scale * 0.17, -scale * 0.3 * (i % 3)]) for i in range(60)]
        x = {i: np.array(v) for i, v in rows}
        got = hnsw.neighbours(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
        assert {r.query_id for r in got} == {0, 20, 40}
        for r in got:
            assert np.isclose(r.score, float(x[r.query_id] @ x[r.vec_id]), rtol=1e-12, atol=0)
        for q in (0, 20, 40):
            want = sorted((-float(x[q] @ v), i) for i, v in x.items() if i != q)[:20]
            found = sorted((r.rank, r.vec_id) for r in got if r.query_id == q)
            assert len(found) == 20 and len({i for _, i in want} & {i for _, i in found}) >= 19


def test_recall_on_the_given_vectors(spark, sf):
    """Several shards against brute force over the whole table."""
    df = spark.read.parquet(f"{sf}/embeddings.parquet")
    rows = df.collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float)
    found = {}
    for r in hnsw.neighbours(df, shard_nodes=200).collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    hits = 0
    for q in ids[ids % 20 == 0]:
        s = x @ x[ids == q][0]
        s[ids == q] = -np.inf
        hits += len(found[q] & set(ids[np.lexsort((ids, -s))[:20]].tolist()))
    assert hits >= 0.95 * 20 * (ids % 20 == 0).sum()
