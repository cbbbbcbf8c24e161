import re
from collections import Counter
from itertools import permutations

import numpy as np

from plexmat.llm import filteraudit

WORD = re.compile("[^\x20\x09-\x0d]+")
COLUMNS = "kept removed redundant unique_fails good_lost toxic_lost shapley".split()


def brute(docs, labels):
    """One document at a time through all orders."""
    lows, good, toxic = {}, set(), set()
    for i, text, _ in docs:
        if i is not None:
            lows[text or ""] = min(lows.get(text or "", i), i)
    for i, q, t in labels:
        good |= {i} if q == 1 and i is not None else set()
        toxic |= {i} if t == 1 and i is not None else set()
    out = {}
    orders = ["".join(p) for p in permutations("ABCDE")]
    for part in {lang or "" for _, _, lang in docs}:
        for o in orders:
            for step in range(1, 6):
                out[part, o, step] = Counter()
    for i, text, lang in docs:
        text, part = text or "", lang or ""
        w = WORD.findall(text)
        fails = {f for f, bad in zip("ABCDE", (len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * sum("A" <= c <= "Z" for c in text) > 3 * len(text), any(c in "#$%&*|" for c in text), i is not None and i > lows[text]), strict=True) if bad}
        for o in orders:
            for step in range(1, 6):
                c, f, early = out[part, o, step], o[step - 1], fails & set(o[: step - 1])
                here = f in fails and not early
                c["kept"] += f not in fails and not early
                c["removed"] += here
                c["redundant"] += f in fails and bool(early)
                c["unique_fails"] += fails == {f}
                c["good_lost"] += here and i in good
                c["toxic_lost"] += here and i in toxic
                c["shapley"] += 120 // len(fails) if f in fails else 0
    return {k: tuple(c[x] for x in COLUMNS) for k, c in out.items()}


def answer(df):
    return {(r.part, r.filter_order, r.step): tuple(r[c] for c in COLUMNS) for r in df.collect()}


def documents():
    rng = np.random.default_rng(3)
    out = []
    for i in range(120):
        n, pool = int(rng.integers(0, 420)), int(rng.choice([3, 120, 4000]))
        w = [f"w{x}" if rng.random() > 0.03 else f"W{x}É" for x in rng.integers(0, pool, n)]
        text = " ".join(w) + (" 100 %" if i % 5 == 0 else "") + ("\n\t" if i % 7 == 0 else "")
        out.append((i, text if i % 11 else None, [None, "en", "", "fr"][i % 4]))
    return out + [(200 + i, out[i % 9][1], "en") for i in range(40)] + [(200, "again", "en"), (200, out[3][1], "fr"), (None, out[3][1], "fr"), (3, out[3][1], "fr")]


def test_equals_brute_force(spark):
    docs = documents()
    labels = [(i, i % 2, int(i % 5 == 0)) for i in range(0, 260, 3)] + [(3, None, 1), (None, 1, 1), (6, 1, 0), (6, 0, 1)]
    got = answer(filteraudit.audit(spark.createDataFrame(docs, "doc_id long, text string, lang string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")))
    assert got == brute(docs, labels)


def test_the_matrix_holds_every_word(spark):
    docs = documents()
    shards = filteraudit.csr_shards(spark.createDataFrame(docs, "doc_id long, text string, lang string").repartition(3)).collect()
    assert len(shards) >= 2
    seen, columns = [], set()
    for s in shards:
        assert s.indptr[0] == 0 and s.indptr[-1] == len(s.columns) == len(s.counts)
        columns |= set(s.columns)
        for i, a, b in zip(s.doc_id, s.indptr, s.indptr[1:], strict=False):
            assert len(set(s.columns[a:b])) == b - a
            seen.append((i, sum(s.counts[a:b]), b - a, tuple(sorted(Counter(s.counts[a:b]).items()))))
    words = [WORD.findall(t or "") for _, t, _ in docs]
    assert columns == set(range(len({x for w in words for x in w})))  # dense, one number a word
    want = [(d[0], len(w), len(set(w)), tuple(sorted(Counter(Counter(w).values()).items()))) for d, w in zip(docs, words, strict=True)]
    assert sorted(seen, key=repr) == sorted(want, key=repr)


def test_edges(spark, tricky, nothing):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = answer(filteraudit.audit(tricky, labels))
    assert {k[0] for k in got} == {"", "en", "fr"} and len(got) == 3 * 600
    n = {"": 2, "en": 5, "fr": 6}
    assert all(sum(got[p, "ABCDE", s][1] for s in range(1, 6)) + got[p, "ABCDE", 5][0] == n[p] for p in n)
    assert filteraudit.audit(nothing, labels).count() == 0 and filteraudit.csr_shards(nothing).count() == 0
