import hashlib
import zlib

import numpy as np
import pytest

from plexmat.llm import periodic


def brute(w):
    """Every maximal stretch of each period by definition, smallest periods only."""
    n, out = len(w), []
    for q in range(1, n // 3 + 1):
        i = 0
        while i < n - q:
            if w[i] != w[i + q]:
                i += 1
                continue
            e = i
            while e < n - q and w[e] == w[e + q]:
                e += 1
            length = e - i + q
            if length >= max(24, 3 * q) and not any(q % c == 0 and all(w[x] == w[x + c] for x in range(i, i + length - c)) for c in range(1, q)):
                out.append((i, length, q))
            i = e
    return sorted(out, key=lambda r: (r[0], r[2]))


def sequences(seed, n=60):
    """Few different words, repeated blocks, periods made of repeated blocks, and neighbours that break or lengthen a run."""
    rng = np.random.default_rng(seed)
    out = []
    for k in range(n):
        alphabet = int(rng.integers(1, 5))
        block = rng.integers(0, alphabet, rng.integers(1, 40)).tolist()
        if k % 3 == 0:  # a period in which all 16-grams come twice
            a, b = rng.integers(0, 9, 17).tolist(), rng.integers(0, 9, 17).tolist()
            block = a + a + b + b + a + a + a + b + b + b
        w = rng.integers(0, alphabet, rng.integers(0, 30)).tolist() + block * int(rng.integers(2, 6)) + block[: rng.integers(0, len(block) + 1)]
        w += rng.integers(0, alphabet, rng.integers(0, 30)).tolist() + w[: rng.integers(0, len(w) + 1)]
        if k % 4 == 0 and w:
            w[int(rng.integers(len(w)))] = 77
        out.append(w)
    return out


def texts_of(sequences):
    return [" ".join(f"x{i}" for i in w) for w in sequences]


@pytest.mark.parametrize("seed", range(4))
def test_runs_equal_brute_force(seed):
    docs = sequences(seed)
    bounds = np.concatenate([[0], np.cumsum([len(w) for w in docs])])
    codes = np.random.default_rng(1).integers(1, 1 << 62, 100).astype(np.uint64)[np.concatenate([np.array(w, int) for w in docs])]
    got = [[] for _ in docs]
    for d, *run in periodic.find_runs(codes, bounds):
        got[d].append(tuple(run))
    want = [brute(w) for w in docs]
    assert got == want and sum(map(len, want)) > 60


def test_the_query_equals_brute_force(spark):
    """The whole contract on generated texts: changed words, counts, the best run and both checksums."""
    rows = list(enumerate(texts_of(sequences(9, 150))))
    got = {r.doc_id: r for r in periodic.digest(periodic.periodic_runs(periodic.with_periods(spark.createDataFrame(rows, "doc_id long, text string")))).collect()}
    planted = 0
    for i, text in rows:
        w, h = text.split(), zlib.crc32(str(i).encode())
        n, g = len(w), h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[k] if k < a else w[a + (k - a) % p] for k in range(n)]
            planted += 1
        runs, gone = brute(w), set()
        for s, length, q in runs:
            gone |= set(range(s + q, s + length))
        best = (None,) * 4
        for s, length, q in runs:
            if best[0] is None or length * best[2] > best[1] * q:
                best = (s, length, q, 1000 * length // q)
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        r = got[i]
        assert (r.n_runs, r.start, r.length, r.period, r.exponent_milli) == (len(runs), *best)
        assert r.runs_sha256 == sha("".join(f"{s},{length},{q}\n" for s, length, q in runs)) and r.collapsed_sha256 == sha(" ".join(x for k, x in enumerate(w) if k not in gone))
    assert planted > 5 and len(got) == 150


def test_edges(spark, tricky, nothing):
    rows = periodic.periodic_runs(tricky).collect()
    assert len(rows) == 13 and {r.doc_id for r in rows if r.n_words == 0} == {0, 1, 2}
    by = {r.doc_id: r for r in rows}
    assert by[0].runs == [] and by[0].collapsed == "" and by[10].collapsed == "é" * 250 + " fin"
    assert [tuple(x) for x in by[7].runs] == [(0, 24000, 8)] and by[7].collapsed == "many words stand here once more and again"
    assert periodic.digest(periodic.periodic_runs(periodic.with_periods(tricky))).count() == 13
    assert periodic.digest(periodic.periodic_runs(periodic.with_periods(nothing))).count() == 0


def test_long_texts_take_no_longer_than_their_length(spark):
    """A word 300,000 times, and a block of 1,000 words 200 times: one run each."""
    block = " ".join(f"b{i}" for i in range(1000))
    rows = [(1, "a " * 300_000), (2, " ".join([block] * 200))]
    got = {r.doc_id: [tuple(x) for x in r.runs] for r in periodic.periodic_runs(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: [(0, 300_000, 1)], 2: [(0, 200_000, 1000)]}
