import re
from collections import defaultdict

import numpy as np
import pytest

from plexmat.llm import minhash
from plexmat.llm.minhash import USED, estimate, near_duplicates, registers

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    w = re.findall("[^\x20\x09-\x0d]+", (text or "").translate(LOWER))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute(rows, percent=85):
    sets = {i: shingles(t) for i, t in rows}
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in sets}


def corpus(seed, n=160):
    rng = np.random.default_rng(seed)
    words = [f"w{i}" for i in range(300)]
    docs, out = [rng.choice(words, rng.integers(3, 150)).tolist() for _ in range(n // 8)], []
    for i in range(n):
        d = list(docs[rng.integers(len(docs))])
        for _ in range(rng.integers(0, 4)):
            d[rng.integers(len(d))] = words[rng.integers(300)]
        out.append((i * 3 + 1, " ".join(d).upper() if i % 7 == 0 else "  ".join(d)))
    return out


@pytest.mark.parametrize("seed,small", [(0, 128), (1, 2), (2, 3)])
def test_equals_brute_force(spark, monkeypatch, seed, small):
    """Also with nearly all buckets taking the blockwise way of large ones."""
    monkeypatch.setattr(minhash, "SMALL", small)
    monkeypatch.setattr(minhash, "BLOCK", 5 if small < 128 else 1000)
    rows = corpus(seed)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows)


def test_estimate_follows_jaccard():
    rng = np.random.default_rng(5)
    for share in (0.5, 0.85, 0.95):
        common = rng.integers(0, 2**63, 2000).astype(np.uint64)
        own = int(2000 * (1 - share) / (2 * share))
        a, b = (np.unique(np.concatenate([common, rng.integers(0, 2**63, own).astype(np.uint64)])) * np.uint64(2) for _ in range(2))
        sig = registers([np.sort(a), np.sort(b)])[:, :USED]
        assert abs(estimate(sig[:1], sig[1:], np.array([len(a)]), np.array([len(b)]))[0] - share) < 0.17


def test_edges(tricky, nothing):
    got = defaultdict(list)
    for r in near_duplicates(tricky).collect():
        got[r.doc_id].append(r)
    assert got[0][0].n_shingles == 0 and got[0][0].component_id == 0 and got[1][0].n_shingles == 0 and got[2][0].n_shingles == 0
    assert [r.component_id for r in got[4]] == [3, 3] and got[3][0].kept and not got[4][0].kept and got[5][0].component_id == 3
    assert got[None][0].component_id is None and got[None][0].kept
    assert sum(map(len, got.values())) == 13
    assert near_duplicates(nothing).count() == 0


def test_dropping_keeps_columns(tricky):
    out = minhash.drop_near_duplicates(tricky)
    assert out.columns == tricky.columns and sorted(r.doc_id for r in out.where("doc_id IS NOT NULL").collect()) == [0, 1, 2, 3, 6, 7, 8, 9, 10]


def test_open_buckets_meet_their_classes_once(spark, monkeypatch):
    """Steps after the stars read what was joined with the classes, and don't join it again for small buckets, large ones and their weights."""
    read, write = {}, minhash.materialize

    def spied(df, label="step"):
        read.setdefault(label, []).append(df.inputFiles())
        return write(df, label)

    monkeypatch.setattr(minhash, "materialize", spied)
    monkeypatch.setattr(minhash, "SMALL", 4)
    rows = corpus(5)
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), percent=80).collect()
    assert {x.doc_id: (x.n_shingles, x.component_id) for x in got} == brute(rows, 80)
    assert read["minhash-cross"] and not any("set-classes" in f for f in read["minhash-cross"][0])
