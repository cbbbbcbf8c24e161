"""Language identification, packing, suffix de-duplication, decontamination, licences, scoring and sharding."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from plexmat.llm import ctw, decontaminate, langid, licenses, packing, sharding, suffixdedup

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# language identification


def test_language_accuracy(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    j = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out")
    assert j.where("lang = lang_pred").count() >= 0.95 * j.count() and j.count() > 10


def test_predictions_equal_a_plain_recomputation(spark, sf):
    """Counts, classifiers, losses and decoding once more, a document and an n-gram at a time."""
    docs = [(r.doc_id, r.text, r.lang) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]

    def grams(text):
        data = (text or "").translate(LOWER).encode()
        for order in (1, 2, 3):
            for i in range(len(data) - order + 1):
                code = order
                for byte in data[i : i + order]:
                    code = (code * 257 + byte) % 2**32
                yield code * 0x9E3779B1 % 2**32 >> 18

    counts = defaultdict(Counter)
    for i, t, lang in docs:
        if zlib.crc32(str(i).encode()) % 5 and t is not None and lang is not None:
            counts[lang].update(grams(t))
    langs = sorted(counts)
    totals = {x: sum(counts[x].values()) for x in langs}
    floor = 0.5 / sum(totals.values())
    code = langid.codewords(len(langs))
    weights = []
    for b in range(code.shape[1]):
        side = {s: [x for x, c in zip(langs, code[:, b], strict=True) if c == s] for s in (1, -1)}
        mean = {s: Counter() for s in side}
        for s, names in side.items():
            for x in names:
                for g, n in counts[x].items():
                    mean[s][g] += n / totals[x] / len(names)
        weights.append({g: math.log((mean[1][g] + floor) / (mean[-1][g] + floor)) for g in set(mean[1]) | set(mean[-1])})
    apart = [max(1e-6, min(code[k, b] * sum(n / totals[x] * w[g] for g, n in counts[x].items()) for k, x in enumerate(langs))) for b, w in enumerate(weights)]
    want = {}
    for i, t, _ in docs:
        if not re.search(r"[^\W\d_]", t or ""):
            want[i] = "und", 0.0
            continue
        own = list(grams(t))
        margin = [sum(w.get(g, 0.0) for g in own) / math.sqrt(len(own)) for w in weights]
        loss = [sum(r * np.logaddexp(0, -m * code[k, b]) for b, (r, m) in enumerate(zip(apart, margin, strict=True))) / sum(apart) for k in range(len(langs))]
        best = min(range(len(langs)), key=lambda k: (loss[k], k))
        want[i] = langs[best], 1 / sum(math.exp(-(x - loss[best]) * code.shape[1]) for x in loss)
    got = {r.doc_id: r for r in langid.identify(spark.read.parquet(f"{sf}/documents.parquet")).collect()}
    assert len(got) == len(docs)
    for i, (lang, score) in want.items():
        assert got[i].lang_pred == lang and math.isclose(got[i].score, score, rel_tol=1e-3, abs_tol=1e-3)


def test_rows_are_kept_by_their_own_text(spark):
    """A repeated id, an ambiguous text, and a table without labels."""
    en, fr = "the dog and the cat of the house are in the garden with the children", "le chien et le chat de la maison sont dans le jardin avec les enfants"
    rows = [(i, en if i % 2 else fr, "en" if i % 2 else "fr") for i in range(40)] + [(50, "12 !", None), (50, en, None), (51, "x", None), (52, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    ambiguous = {r.doc_id for r in langid.identify(df).where("ambiguous").collect()}
    kept = sorted((r.doc_id, r.text) for r in langid.keep_identified(df).collect())
    assert kept == sorted((i, t) for i, t, _ in rows if t not in (None, "12 !") and i not in ambiguous) and (50, en) in kept
    assert langid.keep_identified(df.withColumn("lang", F.lit(None).cast("string"))).count() == 42


def test_codewords_are_apart():
    for n in (2, 4, 6, 9, 20):
        c = langid.codewords(n)
        assert min(int((c[i] != c[j]).sum()) for i in range(n) for j in range(i)) >= (1 if n == 2 else 2)


def test_language_edges(tricky, nothing):
    got = defaultdict(list)
    for r in langid.identify(tricky).collect():
        got[r.doc_id].append(r)
    for i in (0, 1, 2, 6):
        assert got[i][0].lang_pred == "und" and got[i][0].score == 0
    assert len(got[4]) == 2 and not got[None][0].held_out and got[None][0].lang_pred in ("fr", "en")
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, rs in got.items() if i is not None for r in rs)
    assert langid.identify(nothing).count() == 0
    kept = langid.keep_identified(tricky)
    assert kept.columns == tricky.columns and kept.count() == 9


# packing


@pytest.fixture(scope="module")
def vocabulary():
    return pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")


def test_cached_words_give_the_tokenizers_ids(vocabulary):
    w = packing.WordTokenizer(vocabulary)
    for text in ["It's 3,5 ''s don't", "İstanbul ß ﬁ é ½ x² <|endoftext|> a b", "\x1c a\x85b", "ΑΣ οδος", "I'LL'd 'S", "a'''sb 'tis", "", "x" * 3000]:
        assert w.ids(text) == np.array(w.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def test_packing_is_gapless_and_tight(spark):
    rng = np.random.default_rng(4)
    lengths = [int(x) for x in rng.integers(1, 101, 3000)]
    pieces = spark.createDataFrame([(i, n) for i, n in enumerate(lengths)], "doc_id long, length long")
    rows = packing.pack(pieces, 100).collect()
    assert sorted(r.doc_id for r in rows) == list(range(3000))
    bins = defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for offset, n in sorted(b):
            assert offset == at
            at += n
        assert at <= 100
    assert len(bins) <= 1.03 * math.ceil(sum(lengths) / 100)


def test_crossover_places_everything_once():
    rng = np.random.default_rng(0)
    lengths = rng.integers(1, 60, 200).tolist()
    a, b = (packing.Bins(lengths, 100).best_fit(rng.permutation(200)[:50].tolist()) for _ in range(2))
    for p in (a, b):
        p.best_fit(sorted(set(range(200)) - {i for items in p.bins for i in items}))
    for child in (packing.crossover(a, b, rng), packing.mutate(a, rng)):
        assert sorted(i for items in child.bins for i in items) == list(range(200))
        assert all(sum(lengths[i] for i in items) <= 100 for items in child.bins)


def hard_lengths(kind, rng):
    """Classes of lengths on which best fit wastes bins: few large items a bin, and triplets that fill bins exactly."""
    if kind == "uniform":
        return rng.integers(20, 101, 300).tolist(), 150
    out = []
    for _ in range(60):
        a = int(rng.integers(380, 490))
        b = int(rng.integers(250, (1000 - a) // 2))
        out += [a, b, 1000 - a - b]
    return out, 1000


@pytest.mark.parametrize("kind", ["uniform", "triplets"])
def test_islands_beat_best_fit(spark, kind):
    """Never worse in any block, and better over all; every item is placed once, no bin is over-filled."""
    rng = np.random.default_rng(11)
    blocks = [hard_lengths(kind, rng) for _ in range(6)]
    capacity = blocks[0][1]
    rows = [(k, k * 10_000 + i, n) for k, (lengths, _) in enumerate(blocks) for i, n in enumerate(lengths)]
    items = spark.createDataFrame(rows, "block long, uid long, length long")
    found = defaultdict(lambda: defaultdict(list))
    for r in packing.evolved(items, capacity).collect():
        found[r.block][r.bin].append((r.uid, r.length, r.fill))
    plain = [len(packing.Bins(lengths, capacity).best_fit(list(range(len(lengths)))).bins) for lengths, _ in blocks]
    own = [len(found[k]) for k in range(6)]
    assert all(a <= b for a, b in zip(own, plain, strict=True)) and sum(own) < sum(plain)
    for k in range(6):
        assert sorted((u, n) for items in found[k].values() for u, n, _ in items) == [(u, n) for b, u, n in rows if b == k]
        assert all(sum(n for _, n, _ in items) == items[0][2] <= capacity for items in found[k].values())


def test_elites_never_get_worse():
    rng = np.random.default_rng(3)
    lengths, capacity = hard_lengths("triplets", rng)
    people = [packing.Bins(lengths, capacity).best_fit(list(range(len(lengths))))]
    for epoch in range(4):
        before = people[0].fitness()
        people = packing.evolve(lengths, capacity, epoch, people)
        assert people[0].fitness() <= before and len(people) <= packing.POPULATION
        assert packing.decoded(packing.coded(people[0]), lengths, capacity).fitness()[0] == people[0].fitness()[0]


def test_packing_edges(tricky, nothing, vocabulary):
    rows = packing.pack_documents(tricky, vocabulary, with_ids=True).collect()
    empty = [r for r in rows if r.doc_id in (0, 1)]
    assert [r.length for r in empty] == [1, 1] and empty[0].ids_crc32 == zlib.crc32(b"\0\0\0\0")
    long = sorted((r for r in rows if r.doc_id == 7), key=lambda r: r.piece)
    assert [r.start for r in long] == [2048 * i for i in range(len(long))] and all(r.length == 2048 for r in long[:-1])
    assert all(zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length for r in rows)
    assert sum(r.doc_id == 4 for r in rows) == 2
    assert packing.pack_documents(nothing, vocabulary).count() == 0


# suffix de-duplication


def brute_cut(rows):
    seen, out = set(), {}
    for i, t in sorted(rows):
        data = (t or "").encode()
        mark = bytearray(len(data))
        for s in range(len(data) - 99):
            w = data[s : s + 100]
            if w in seen:
                mark[s : s + 100] = b"\1" * 100
            else:
                seen.add(w)
        kept = bytes(b for b, m in zip(data, mark) if not m)
        out[i] = (len(data), sum(mark), sum(1 for k in range(len(mark)) if mark[k] and (k == 0 or not mark[k - 1])), hashlib.sha256(kept).hexdigest())
    return out


def passages(seed, n=60):
    rng = np.random.default_rng(seed)
    text = lambda k: "".join(rng.choice(list("abcdeé \n"), k))
    shared = [text(k) for k in (90, 120, 300, 150)] + ["ab" * 90, "x" * 260]
    return [(i * 2, "".join(text(rng.integers(0, 200)) + (shared[rng.integers(6)] if rng.random() < 0.7 else "") for _ in range(rng.integers(1, 5)))) for i in range(n)]


@pytest.mark.parametrize("seed,group,sieve", [(0, 4096, 1 << 29), (1, 3, 1 << 29), (2, 4, 0), (3, 4096, 0)])
def test_cut_equals_brute_force(spark, seed, group, sieve):
    """Also with salted groups, and beyond the bound of the broadcast, with hot anchors there."""
    rows = passages(seed)
    df = suffixdedup.keyed(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text")
    spans = suffixdedup.repeated_spans(df, sieve, group)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.join(spans, ["doc_id", "key"], "left").mapInArrow(
        suffixdedup._digest, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string").collect()}
    assert got == brute_cut(rows)


def test_rows_that_share_an_id(spark):
    """Other texts are documents of their own; the same text is the same document."""
    rng = np.random.default_rng(2)
    text = lambda n: "".join(rng.choice(list("abcdefgh "), n))
    one, two, three = text(300), text(300), text(400)
    df = spark.createDataFrame([(1, one), (1, two), (2, one), (1, two), (3, three), (3, three)], "doc_id long, text string")
    got = sorted((r.doc_id, r.n_bytes, r.n_removed) for r in suffixdedup.digest(df).collect())
    assert got == [(1, 300, 0), (1, 300, 0), (1, 300, 0), (2, 300, 300), (3, 400, 0), (3, 400, 0)]
    runs = spark.createDataFrame([(1, "a" * 300), (1, "b" * 300), (2, "a" * 300)], "doc_id long, text string")
    assert sorted((r.doc_id, r.n_removed) for r in suffixdedup.digest(runs).collect()) == [(1, 299), (1, 299), (2, 300)]


@pytest.mark.parametrize("sieve", [1 << 29, 0])
def test_long_runs_stay_small(spark, sieve):
    """Runs of one byte, of two bytes and of a line, a million bytes each: few contexts travel."""
    rng = np.random.default_rng(3)
    line = "".join(rng.choice(list("abcdefgh "), 150)) + "\n"
    rows = [(i, x * (1_000_000 // len(x))) for i, x in enumerate(("a", "ab", line, "a"))]
    df = suffixdedup.keyed(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text")
    assert suffixdedup._candidates(df, sieve, 4096, True).where("e IS NULL").count() < 100
    spans = {r.doc_id: [tuple(x) for x in r.spans] for r in suffixdedup.repeated_spans(df, sieve).collect()}
    end = [len(t.encode()) for _, t in rows]
    merged = {i: suffixdedup._merge(list(s)) for i, s in spans.items()}
    assert merged == {0: [(1, end[0])], 1: [(2, end[1])], 2: [(len(line), end[2])], 3: [(0, end[3])]}


@pytest.mark.parametrize("group", [4096, 3])
def test_repeat_groups_are_repeats_that_go_no_further(spark, group):
    rows = passages(5, 30)
    data = {i: t.encode() for i, t in rows}
    groups = defaultdict(list)
    for r in suffixdedup.repeat_groups(spark.createDataFrame(rows, "doc_id long, text string"), group=group).collect():
        groups[r.repeat_id, r.length, r.n_occurrences].append((r.doc_id, r.start))
    covered = {i: bytearray(len(d)) for i, d in data.items()}
    for (_, length, n), places in groups.items():
        assert len(set(places)) == len(places) == n > 1 and length >= 100
        assert len({data[d][s : s + length] for d, s in places}) == 1 and all(s + length <= len(data[d]) for d, s in places)
        for d, s in sorted(places)[1:]:
            covered[d][s : s + length] = b"\1" * length
    if group == 4096:
        assert {i: sum(c) for i, c in covered.items()} == {i: n for i, (_, n, _, _) in brute_cut(rows).items()}


def test_a_passage_is_one_group(spark):
    rng = np.random.default_rng(6)
    text = lambda n: "".join(rng.choice(list("abcdefgh "), n))
    passage = text(700)
    rows = [(i, text(200) + "<" + passage + ">" + text(100 + i)) for i in range(6)] + [(9, text(50) + passage[100:450] + "!")]
    got = defaultdict(set)
    for r in suffixdedup.repeat_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        got[r.length, r.n_occurrences].add((r.doc_id, r.start))
    assert got[350, 7] == {(i, 301) for i in range(6)} | {(9, 50)}
    around = [(length, places) for (length, n), places in got.items() if n == 6]  # what the six share on both sides of it
    assert any((0, 200) in p and length > 100 for length, p in around) and any((0, 201 + 700 + 1 - length) in p for length, p in around)
    assert all({d for d, _ in places} == set(range(6)) for _, places in around)
    assert suffixdedup.repeat_groups(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_intervals_cover_every_common_prefix():
    words = sorted(b"%s" % w.encode() for w in ("banana", "band", "bandana", "can", "cane", "canes"))
    found = {(d, words[lo][:d], hi - lo + 1) for d, lo, hi, _ in suffixdedup.intervals(words) if d}
    assert found == {(3, b"ban", 3), (4, b"band", 2), (3, b"can", 3), (4, b"cane", 2)}


def test_cut_edges(tricky, nothing):
    got = defaultdict(list)
    for r in suffixdedup.digest(tricky).collect():
        got[r.doc_id].append(r)
    assert got[0][0].n_bytes == 0 and got[1][0].n_removed == 0 and sum(map(len, got.values())) == 13
    assert got[7][0].n_bytes - got[7][0].n_removed < 300
    assert suffixdedup.digest(nothing).count() == 0
    out = suffixdedup.deduplicate(tricky)
    assert out.columns == tricky.columns and out.count() == 13 and out.where("doc_id = 0").first().text is None


# decontamination


def test_reparameterised_questions_are_found(spark):
    bench = spark.createDataFrame([(1, "Today Anna has 12 apples and gives 3 apples to Tom every day. How many apples does Anna have after 2 days?"), (2, "too short"), (3, None)], "item_id long, text string")
    ask = "Today Bert has 40 apples and gives 5 apples to Lisa every day. How many apples does Bert have after 9 days?"
    mixed = "Today Bert has 40 apples and gives 5 apples to Lisa every day. How many apples does Carl have after 9 days?"
    docs = spark.createDataFrame([(1, ask), (2, "Nothing to see here, only plain words in a plain text without any question at all"), (3, None), (4, "")], "doc_id long, text string")
    got = {r.doc_id: r for r in decontaminate.report(docs, bench).collect()}
    assert got[1].contaminated and got[1].item_id == 1 and got[1].reworded
    assert not got[2].contaminated and not got[3].contaminated and not got[4].contaminated
    m = decontaminate.matches(spark.createDataFrame([(1, mixed)], "doc_id long, text string"), bench).first()
    assert m.n_conflicts > 0
    exact = decontaminate.report(spark.createDataFrame([(5, "Today Anna has 12 apples and gives 3 apples to Tom every day. How many apples does Anna have after 2 days?")], "doc_id long, text string"), bench).first()
    assert exact.contaminated and not exact.reworded


def test_names_in_every_place(spark):
    """Names that begin sentences, of two words, in lower case; a word put in; short items."""
    bench = spark.createDataFrame([
        (1, "Tom has 3 apples. Tom buys 5 more apples. How many apples does Tom have now?"), (2, "She flew from New York to Boston in 5 hours and came back to New York after 3 days of rest."),
        (3, "What is 2 + 2?"), (4, "Define entropy."), (5, "7 8 9 10 11 12 13 14 15 16 17 18 19 20 21 22")], "item_id long, text string")
    docs = spark.createDataFrame([
        (1, "Anna has 4 apples. Anna buys 9 more apples. How many apples does Anna have now?"), (2, "tom has 3 apples. tom buys 5 more apples. how many apples does tom have now?"),
        (3, "She flew from Paris to Rome in 2 hours and came back to Paris after 9 days of rest."), (4, "She flew from New York to Boston in 5 hours and quickly came back to New York after 3 days of rest."),
        (5, "what is 2 + 2"), (6, "Define  ENTROPY"), (7, "Define entropy in your own words."), (8, "What is 2 + 3?"), (9, "31 32 33 34 35 36 37 38 39 40 41 42 43 44 45 46"),
        (10, "1 7 8 9 10 11 12 13 14 15 16 17 18 19 20 21 22 1"), (11, "Nina has 4 pears. Otto sells 9 old chairs. How many tables does Paul own now?")], "doc_id long, text string")
    got = {r.doc_id: r.item_id for r in decontaminate.report(docs, bench).where("contaminated").collect()}
    assert got == {1: 1, 2: 1, 3: 2, 4: 2, 5: 3, 6: 4, 10: 5}


def test_both_joins_find_the_same(spark, sf):
    docs, bench = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    a, b = (sorted(decontaminate.matches(docs, bench, broadcast_windows=n).collect()) for n in (1 << 20, 0))
    assert a == b and a


def test_decontamination_against_plain_search(spark, sf):
    docs, bench = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    norm = lambda t: " ".join(re.findall(r"\w+", t.lower()))
    items = [norm(r.text) for r in bench.collect()]
    want = {r.doc_id for r in docs.collect() if any(i in norm(r.text) for i in items)}
    assert {r.doc_id for r in decontaminate.report(docs, bench).where("contaminated").collect()} == want


def test_decontamination_edges(spark, tricky, nothing):
    bench = spark.createDataFrame([(1, "a b c d e f g h i j k")], "item_id long, text string")
    assert decontaminate.report(tricky, bench).where("contaminated").count() == 0
    assert decontaminate.report(tricky, bench.limit(0)).count() == 13
    assert decontaminate.report(nothing, bench).count() == 0
    assert decontaminate.drop_contaminated(tricky, bench).columns == tricky.columns


# licences


def licences_of(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [r.licenses for r in sorted(licenses.scan_licenses(df).collect(), key=lambda r: r.doc_id)]


def test_licence_rules(spark, tricky, nothing):
    s = licenses.SENTENCES
    texts = [
        "Some text. Licensed under the Apache License, Version 2.0.\nmore", f"{s['bsd_grant']}\n{s['bsd_source']}.\n{s['bsd_binary']}.", f"{s['bsd_binary']}.\n{s['bsd_source']}.",
        f"{s['mit_title']}\n\nx\n{s['mit_grant']}\n{s['mit_condition']}.", "RELEASED under the  mit   license!", None, "Foo is released under the MIT License, bar is not", "under the. MIT License",
        f"{s['bsd_grant']} {s['bsd_source']}. {s['bsd_binary']}. {s['bsd_endorse']}.", "not under the MIT Licenses", "." * 200_000 + " licence",
    ]
    assert licences_of(spark, texts) == ["Apache-2.0", "BSD-2-Clause", "", "MIT", "MIT", "", "MIT", "", "BSD-3-Clause", "", ""]
    assert licenses.scan_licenses(tricky).count() == 13 and licenses.scan_licenses(nothing).count() == 0
    assert all(re.search(licenses.TELLTALE, v) for v in s.values())
    assert {i for _, ids, unless in licenses.RULES for i in [*ids, *unless]} <= set(s)


def test_repeated_notices_take_linear_time(spark):
    """10,000 notices in one text (about 5 MB), most of a rule but not its last sentence; then the same with it."""
    import time

    s = licenses.SENTENCES
    notice = f"{s['bsd_grant']} {s['bsd_source']}. {s['bsd_binary']}.\n\n"
    licences_of(spark, [notice])
    began = time.time()
    assert licences_of(spark, [notice * 10_000, notice * 10_000 + s["bsd_endorse"] + "."]) == ["BSD-2-Clause", "BSD-3-Clause"]
    assert time.time() - began < 60
    assert licences_of(spark, [f"{s['bsd_binary']}. {s['bsd_source']}. {s['bsd_grant']} " * 3]) == ["BSD-2-Clause"]
    assert licences_of(spark, [f"{s['bsd_binary']}. {s['bsd_source']}. {s['bsd_grant']} " * 2]) == [""]


def test_wrapped_licence_texts(spark):
    """As they stand in files: wrapped, indented, behind comment marks, with a lead-in."""
    import textwrap

    s = licenses.SENTENCES
    head = "Copyright (c) 2020 Jane Roe. All rights reserved.\n\n"
    whole = {
        "MIT": [f"MIT License\n\nCopyright (c) 2020 Jane Roe\n\n{s['mit_grant']}", f"{s['mit_condition']}.", f"{s['mit_warranty']}."],
        "ISC": [head + s["isc_grant"] + ".", s["isc_warranty"] + "."],
        "BSD-3-Clause": [head + s["bsd_grant"], "1. " + s["bsd_source"] + ".", "2. " + s["bsd_binary"] + ".", "3. " + s["bsd_endorse"] + "."],
        "BSD-2-Clause": [head + s["bsd_grant"], "* " + s["bsd_source"] + ".", "* " + s["bsd_binary"] + "."],
        "GPL-3.0-or-later": ["This file is part of Foo.", s["gpl3_later"] + ".", s["gpl_no_warranty"] + ".  See the GNU General Public License for more details."],
        "GPL-2.0-or-later": [s["gpl2_later"] + ".", s["gpl_no_warranty"] + "."],
        "Apache-2.0": ['Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.', s["apache_copy"] + "\n\n  http://www.apache.org/licenses/LICENSE-2.0", s["as_is_law"] + "."],
        "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."],
        "Zlib": [s["zlib_warranty"] + ".", s["zlib_grant"], "1. " + s["zlib_origin"] + ".", "3. " + s["zlib_notice"] + "."],
        "Unlicense": [s["unlicense"] + ".", s["unlicense_grant"] + "."],
    }
    texts, want = [], []
    for mark in ("", "# ", " * ", "// ", ";; ", "-- "):
        for width in (60, 72, 79):
            for name, parts in whole.items():
                lines = [line for part in parts for block in part.split("\n\n") for line in [*textwrap.wrap(block, width, break_on_hyphens=False), ""]]
                texts.append("/*\n" + "\n".join((mark + line).rstrip() for line in lines) + "\n*/\n\nint main() {}\n")
                want.append(name)
    assert licences_of(spark, texts) == want


# scoring


def test_base_scores_and_known_words(spark):
    rng = np.random.default_rng(6)
    rows = [(i, " ".join(f"W{x}" for x in rng.integers(0, 40, rng.integers(0, 60)))) for i in range(80)] + [(None, "w1 w2"), (200, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    tokens = [(i, re.findall("[^\x20\x09-\x0d]+", (t or "").translate(LOWER)) + [None]) for i, t in rows]
    held = lambda i: i is None or zlib.crc32(str(i).encode()) % 10 == 0
    c = Counter(w for i, t in tokens if not held(i) for w in t)
    n, v = sum(c.values()), len(c)
    want = {i: (len(t), sum(c[w] > 0 for w in t), n, sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t)) for i, t in tokens}
    for limit in (10_000, 20, 0):
        got = {r.doc_id: r for r in ctw.score(df, frequent_words=limit).collect()}
        for i, (a, b, total, base) in want.items():
            assert (got[i].n_tokens, got[i].n_known, got[i].train_tokens, got[i].held_out) == (a, b, total, held(i))
            assert math.isclose(got[i].base_score, base, abs_tol=1e-6)


def test_context_tree_weights_equal_a_plain_recursion():
    rng = np.random.default_rng(8)
    text = bytes(rng.choice(list(b"ab "), 300).tolist())
    grams, _ = ctw.byte_grams(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
    key, n = ctw._distinct(grams)
    levels = [ctw.deepest(key, n)]
    while len(levels) < ctw.DEPTH + 1:
        levels.append(levels[-1].parent())
    counts = defaultdict(lambda: [0, 0])
    coded = bytes([255] * ctw.DEPTH) + text + b"\xff"
    for i in range(ctw.DEPTH, len(coded)):
        node = 1
        for bit in range(8):
            up = coded[i] >> (7 - bit) & 1
            for depth in range(ctw.DEPTH + 1):
                counts[coded[i - depth : i][::-1], node][up] += 1
            node = node * 2 + up

    def kt(a, b):
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.log(math.pi) - math.lgamma(a + b + 1)

    def weighted(context, node):
        own = kt(*counts[context, node])
        if len(context) == ctw.DEPTH:
            return own
        below = sum(weighted(c, v) for c, v in list(counts) if v == node and len(c) == len(context) + 1 and c[:-1] == context)
        return np.logaddexp(own, below) - math.log(2)

    root = levels[-1]
    assert math.isclose(root.weighted[list(root.key).index(1)], weighted(b"", 1), rel_tol=1e-9)


def test_byte_model_is_a_distribution(spark):
    df = spark.createDataFrame([(i, "the cat sat on the mat " * (1 + i % 3)) for i in range(30)], "doc_id long, text string")
    counted = df.select("text").mapInArrow(ctw._learn, "kind int, key long, n long").where("kind = 0").groupBy("key").agg(F.sum("n").alias("n"))
    model = ctw.fit(counted)
    for context in (b" eht ", b"zzzzz", b"\xff" * 5):
        grams = np.array([int.from_bytes(context + bytes([b]), "big") for b in range(256)], np.uint64)
        assert math.isclose((2.0 ** -model.bits_of(grams)).sum(), 1, rel_tol=1e-5)


def test_scores_use_the_whole_tree(spark):
    """Contexts seen once count, however few grams are broadcast."""
    rng = np.random.default_rng(9)
    docs = [(i, bytes(rng.choice(list(b"abcde "), 40).tolist()).decode() if i else "") for i in range(40)]
    counts = defaultdict(lambda: [0, 0])

    def steps(text):
        coded = bytes([255] * ctw.DEPTH) + text.encode() + b"\xff"
        for i in range(ctw.DEPTH, len(coded)):
            node = 1
            for bit in range(8):
                up = coded[i] >> (7 - bit) & 1
                yield coded[i - ctw.DEPTH : i][::-1], node, up
                node = node * 2 + up

    for i, text in docs:
        if zlib.crc32(str(i).encode()) % 10:
            for context, node, up in steps(text):
                for depth in range(ctw.DEPTH + 1):
                    counts[context[:depth], node][up] += 1
    below = defaultdict(list)
    for context, node in list(counts):
        below[context[:-1], node].append(context) if context else None
    logs = {}
    for context, node in sorted(counts, key=lambda x: -len(x[0])):
        a, b = counts[context, node]
        own = math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.log(math.pi) - math.lgamma(a + b + 1)
        whole = own if len(context) == ctw.DEPTH else np.logaddexp(own, sum(logs[c, node][1] for c in below[context, node])) - math.log(2)
        logs[context, node] = own, whole

    def chance(context, node):
        mixed, left, estimate = 0.0, 1.0, 0.5
        for depth in range(ctw.DEPTH + 1):
            at = context[:depth], node
            if at not in logs:
                break
            a, b = counts[at]
            estimate = (b + 0.5) / (a + b + 1)
            stop = 1.0 if depth == ctw.DEPTH else math.exp(logs[at][0] - math.log(2) - logs[at][1])
            mixed, left, held = mixed + left * stop * estimate, left * (1 - stop), mixed + left * estimate
        else:
            return mixed
        return held if (b"", node) in logs else 0.5

    want = {i: sum(math.log10(p if up else 1 - p) for c, v, up in steps(t) for p in [chance(c, v)]) for i, t in docs}
    df = spark.createDataFrame(docs, "doc_id long, text string")
    for options in ({}, {"frequent_grams": 0}, {"frequent_grams": 50}):
        got = {r.doc_id: r.score for r in ctw.score(df, **options).collect()}
        assert all(math.isclose(got[i], want[i], rel_tol=1e-9) for i in want)


def test_scores_beat_the_base_on_held_out_text(spark, sf):
    larger = sf.replace("sf0.001", "sf0.01")
    s = ctw.score(spark.read.parquet(f"{larger}/documents.parquet")).where("held_out").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b")).first()
    assert s.s > s.b


def test_scoring_edges(tricky, nothing):
    got = {r.doc_id: r for r in ctw.score(tricky).collect()}
    assert got[0].n_tokens == 1 and got[1].n_tokens == 1 and got[0].score < 0 and got[None].held_out
    assert ctw.score(nothing).count() == 0


# sharding


def test_shards_are_even_and_slots_gapless(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = sharding.shard_documents(docs).collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    load, slots, of = Counter(), defaultdict(list), defaultdict(set)
    for r in rows:
        assert r.size == len(texts[r.doc_id].encode()) + 1 and r.text_crc32 == zlib.crc32(texts[r.doc_id].encode()) and r.law == "bytes" and r.grown_shard is None
        load[r.shard] += r.size
        slots[r.shard].append(r.slot)
        of[texts[r.doc_id]].add(r.shard)
    assert len(rows) == len(texts) and set(load) <= set(range(16))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(s) == 1 for s in of.values())  # groups stay together at this size
    assert max(load.values()) < 1.1 * sum(load.values()) / 16


def loads(rows):
    load, of = Counter(), defaultdict(set)
    for r in rows:
        load[r.shard] += r.size
        of[r.text_crc32].add(r.shard)
    return [load[i] for i in range(16)], of


def test_a_hot_text_stays_whole_while_its_bytes_fit(spark):
    """A third of the rows and a ninth of a shard's bytes: whole. Half of all bytes: dealt out, since no shard can hold it."""
    rows = [(i, "" if i % 3 == 0 else f"text {i} " + "x" * (i % 50)) for i in range(3000)]
    load, of = loads(sharding.shard_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert max(load) < 1.02 * sum(load) / 16 and all(len(s) == 1 for s in of.values())
    rows = [(i, "a hot text of some length" if i % 2 == 0 else f"text {i} number of others") for i in range(3000)]
    load, of = loads(sharding.shard_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert max(load) < 1.05 * sum(load) / 16 and sum(len(s) > 1 for s in of.values()) == 1


def test_groups_are_split_only_where_bytes_force_it():
    """26 groups of 0.6 shares don't fit 16 shards whole; 16 groups of 0.9 shares do."""
    pieces, left = sharding.place_large(np.full((26, 3), 0.6), np.full(26, 1000), 16)
    assert left[:, 0].min() >= -sharding.SLACK and max(map(len, pieces)) > 1
    pieces, left = sharding.place_large(np.full((16, 3), 0.9), np.full(16, 1000), 16)
    assert all(len(p) == 1 for p in pieces) and sorted(p[0] for p in pieces) == list(range(16))
    pieces, left = sharding.place_large(np.array([[3.0, 3.0, 0.01]]), np.array([1]), 16)  # one row is never cut
    assert len(pieces[0]) == 1


def test_small_groups_are_placed_in_cells(spark, monkeypatch):
    """Few groups are large and the cells are small: still even, whole and gapless."""
    monkeypatch.setattr(sharding, "SHARE", 4)
    monkeypatch.setattr(sharding, "CELL_GROUPS", 100)
    rng = np.random.default_rng(5)
    rows = [(i, f"{i % 1900} " + "x" * int(rng.integers(0, 3) * (i % 1900 % 400))) for i in range(4000)]
    got = sharding.shard_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    load, of = loads(got)
    assert len(got) == 4000 and max(load) < 1.05 * sum(load) / 16 and all(len(s) == 1 for s in of.values())
    for shard in range(16):
        assert sorted(r.slot for r in got if r.shard == shard) == list(range(sum(r.shard == shard for r in got)))


def test_sharding_edges(tricky, nothing):
    rows = sharding.shard_documents(tricky).collect()
    assert len(rows) == 13 and [(r.size, r.text_crc32) for r in rows if r.doc_id == 0] == [(1, 0)]
    assert sharding.shard_documents(nothing).count() == 0
