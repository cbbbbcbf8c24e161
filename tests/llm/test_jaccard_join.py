import numpy as np
import pytest

from plexmat.llm import jaccardjoin
from plexmat.llm.minhash import near_duplicates
from tests.llm.test_minhash import LOWER, corpus


def shingles(text, width):
    w = [x for x in (text or "").translate(LOWER).replace("\n", " ").replace("\t", " ").split(" ") if x]
    return frozenset(tuple(w[i : i + width]) for i in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)] if w else [])


def brute(rows, width):
    """Components of ids: rows with words of one id are one node."""
    sets = [(i, shingles(t, width)) for i, t in rows]
    parent = {i: i for i, _ in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (a, s) in enumerate(sets):
        for b, t in sets[k + 1 :]:
            both = len(s & t)
            if both and 100 * both >= 85 * len(s | t):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return sorted((i, len(s), root(i) if s else i) for i, s in sets)


def answer(df):
    return sorted((r.doc_id, r.n_shingles, r.component_id) for r in df.collect())


def families(seed):
    """Many copies of one text with a few words changed each, so that lists are long and copies are linked through others only."""
    rng = np.random.default_rng(seed)
    base = [f"b{i}" for i in range(90)]
    out = []
    for i in range(140):
        w = list(base)
        for _ in range(int(rng.integers(1, 5))):
            w[int(rng.integers(len(w)))] = f"n{rng.integers(10**6)}"
        out.append((1000 + i, " ".join(w)))
    shared = " ".join(f"s{i}" for i in range(40))  # a passage that many otherwise different texts hold
    return out + [(2000 + i, shared + " " + " ".join(f"o{x}" for x in rng.integers(0, 10**6, int(rng.integers(1, 60))))) for i in range(80)]


@pytest.mark.parametrize("seed,small", [(0, 64), (1, 3)])
def test_equals_brute_force(spark, monkeypatch, seed, small):
    """Also with nearly all lists compared block by block."""
    monkeypatch.setattr(jaccardjoin, "SMALL", small)
    monkeypatch.setattr(jaccardjoin, "LISTED", 40 * small)
    monkeypatch.setattr(jaccardjoin, "BLOCK", 7 if small < 64 else 1000)
    rows = corpus(seed) + families(seed)
    assert answer(jaccardjoin.similar_sets(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows, 4)


def test_any_order_and_any_prefix_give_the_same(spark, monkeypatch):
    rows = corpus(5, 120) + families(5)
    df, want = spark.createDataFrame(rows, "doc_id long, text string"), brute(rows, 4)
    # the longest prefixes; then the shortest, in another order
    monkeypatch.setattr(jaccardjoin, "POSTING", 0.0)
    monkeypatch.setattr(jaccardjoin, "VERIFY", 50.0)
    assert answer(jaccardjoin.similar_sets(df)) == want
    monkeypatch.setattr(jaccardjoin, "POSTING", 1e9)
    monkeypatch.setattr(jaccardjoin, "slot_levels", lambda texts: np.random.default_rng(1).integers(0, 9, jaccardjoin.SLOTS).astype(np.int8))
    assert answer(jaccardjoin.similar_sets(df)) == want


def test_prefixes_grow_with_meetings(spark):
    rows = spark.createDataFrame([(400, 0), (400, 10), (400, 10_000), (3, 100)], "n long, meetings long")
    got = [r.matches for r in rows.select(jaccardjoin.chosen_matches(85).alias("matches")).collect()]
    assert got[0] == 1 and got[0] < got[1] < got[2] == 32 and got[3] <= 3


def test_rows_that_repeat_an_id_are_one_node(spark):
    w, x = " ".join(f"w{i}" for i in range(30)), " ".join(f"x{i}" for i in range(30))
    rows = [(1, w), (5, w), (5, x), (9, x), (5, w), (7, "z"), (7, None), (2, "z"), (5, "y y"), (5, "v v v v v v")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert answer(jaccardjoin.similar_sets(df)) == brute(rows, 4)
    assert answer(near_duplicates(df)) == brute(rows, 5)


def test_edges(tricky, nothing):
    got = jaccardjoin.similar_sets(tricky).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == 13 and by[None].component_id is None
    assert [by[i].component_id for i in (0, 1, 2, 3, 4, 5)] == [0, 1, 2, 3, 3, 3] and by[0].n_shingles == by[2].n_shingles == 0 and by[8].n_shingles == 1
    assert jaccardjoin.similar_sets(nothing).count() == 0


def test_rejected_pairs_of_two_components_do_not_take_a_round_each():
    """Twenty likely pairs a side: the first rounds take four of them for the link, later ones try some for every member."""
    import numpy as np
    import pandas as pd

    from plexmat.llm import jaccardjoin

    bits = jaccardjoin.parities(np.arange(1, 41, dtype=np.uint64))
    rows = pd.DataFrame({"block": 0, "bi": 0, "bj": 0, "rep": range(40), "n": 40, "comp": [i // 20 for i in range(40)], "bits": [bits] * 40, "barred": None})
    assert [len(jaccardjoin._large_list(85, nth)(rows)) for nth in (0, 1, 2, 3)] == [4, 4, 160, 320]
    rows["barred"] = [list(range(20, 40))] * 19 + [list(range(20, 37))] + [None] * 20
    assert sorted(jaccardjoin._large_list(85, 5)(rows).b) == [37, 38, 39]
