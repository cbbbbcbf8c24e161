"""Language identification with error-correcting output codes.

Every learned language gets a codeword; each bit has a binary classifier over hashed byte n-grams (orders 1 to 3 of the
text with A-Z lower-cased), a naive Bayes log-odds that is summed over the whole text. Decoding adds up the
logistic losses of a codeword's bits, each weighted by how well its classifier separates the training languages, and takes the
nearest codeword. The score is the decoded share of the nearest codeword (a softmax of the losses); a text whose two
nearest codewords are close is flagged as ambiguous.

Training counts n-grams over all training rows on Spark (one partial table a task, then a sum by n-gram); what reaches the
driver is (languages x ``DIMS``) counts, whatever the size of the corpus.

Edge cases: a null text, or one without any letter, gives ``und`` with score 0 and is never ambiguous; rows with a null lang are not
trained on; without a training row every text gives ``und``; ties between codewords go to the alphabetically first
language; a null doc_id counts as neither held out nor trained on; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plexmat.llm.textkit import LOWER, text_chunks
from plexmat.llm.tuning import by_place

DIMS = 1 << 14
ORDERS = (1, 2, 3)
SMOOTHING = 0.5
#: Nearest codewords closer than this in mean bit loss make a text ambiguous.
AMBIGUITY_MARGIN = 0.05
UNKNOWN = "und"


def features(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each order, (hashed feature, row) of every n-gram that lies inside one row."""
    data = LOWER[data].astype(np.uint32)
    rows = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    for order in ORDERS:
        n = len(data) - order + 1
        if n <= 0:
            continue
        code = np.full(n, order, np.uint32)
        for i in range(order):
            code = code * np.uint32(257) + data[i : i + n]
        code *= np.uint32(0x9E3779B1)
        inside = rows[:n] == rows[order - 1 :]
        yield (code >> np.uint32(18))[inside].astype(np.int64) & (DIMS - 1), rows[:n][inside]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    totals: dict[str, np.ndarray] = {}
    for rows, data, offsets in text_chunks(batches, "text"):
        langs = np.array(rows.column("lang").to_pylist(), object)
        names = sorted(set(langs))
        code = np.searchsorted(names, langs) if len(names) > 1 else np.zeros(len(langs), np.int64)
        for feature, row in features(data, offsets):
            counts = np.bincount(code[row] * DIMS + feature, minlength=len(names) * DIMS).reshape(len(names), DIMS)
            for i, name in enumerate(names):
                totals[name] = totals.get(name, 0) + counts[i]
    for name, counts in totals.items():
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array([name] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(counts[at].astype(np.int64))], ["lang", "feature", "n"])


def codewords(n: int) -> np.ndarray:
    """One row of +1 and -1 for each language: every split of few languages, else random words far from each other."""
    if n <= 1:
        return np.ones((n, 1))
    if n <= 6:
        bits = np.arange(1, 1 << (n - 1))
        return np.array([[1 if i == 0 or not (b >> (i - 1)) & 1 else -1 for b in bits] for i in range(n)], float)
    width, rng, best, best_d = int(np.ceil(10 * np.log2(n))), np.random.default_rng(11), None, -1
    for _ in range(200):
        m = rng.choice([-1.0, 1.0], (n, width))
        m = m[:, np.abs(m.sum(axis=0)) < n]
        d = min(int((m[i] != m[j]).sum()) for i in range(n) for j in range(i))
        if d > best_d:
            best, best_d = m, d
    return best


@dataclass
class EcocModel:
    langs: list[str]
    code: np.ndarray
    weights: np.ndarray
    reliability: np.ndarray

    def losses(self, margins: np.ndarray) -> np.ndarray:
        """Mean weighted logistic loss of each row against each codeword."""
        loss = np.logaddexp(0, -margins[:, None, :] * self.code[None])
        return (loss * self.reliability).sum(axis=2) / self.reliability.sum()


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> EcocModel:
    """Learn from all rows with a text and a lang."""
    rows = docs.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where("text IS NOT NULL AND lang IS NOT NULL")
    table = rows.mapInArrow(_count, "lang string, feature int, n long").groupBy("lang", "feature").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(table.lang.unique())
    counts = np.zeros((len(langs), DIMS))
    counts[table.lang.map({x: i for i, x in enumerate(langs)}).to_numpy(dtype=int), table.feature.to_numpy()] = table.n.to_numpy()
    code = codewords(len(langs))
    weights = np.zeros((DIMS, code.shape[1]), np.float32)
    share = counts / np.maximum(counts.sum(axis=1, keepdims=True), 1)  # each language counts alike
    for b in range(code.shape[1]):
        pos, neg = (share[code[:, b] == s].mean(axis=0) if (code[:, b] == s).any() else np.zeros(DIMS) for s in (1, -1))
        floor = SMOOTHING / max(counts.sum(), 1)
        weights[:, b] = np.log((pos + floor) / (neg + floor)) if len(langs) > 1 else 1.0
    # how far the expected log-odds of the two sides lie apart, for each bit
    expected = share @ weights
    reliability = np.array([max(1e-6, min(code[i, b] * expected[i, b] for i in range(len(langs)))) if len(langs) else 1.0 for b in range(code.shape[1])])
    return EcocModel(langs, code, weights, reliability / max(reliability.max(), 1e-9))


def decide(model: EcocModel, known: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(language, score, ambiguous) of each text; ``known`` says which have a letter."""
    n = len(known)
    known = known & (len(model.langs) > 0)
    margins, size = np.zeros((n, model.code.shape[1])), np.zeros(n)
    for feature, row in features(data, offsets):
        if len(row):
            begin = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
            margins[row[begin]] += np.add.reduceat(model.weights[feature], begin, axis=0)
            size += np.bincount(row, minlength=n)
    # evidence grows with the square root of the length, so that long texts keep graded scores
    loss = model.losses(margins / np.sqrt(np.maximum(size, 1))[:, None]) if len(model.langs) else np.zeros((n, 1))
    order = np.argsort(loss, axis=1, kind="stable")
    first = loss[np.arange(n), order[:, 0]]
    gap = loss[np.arange(n), order[:, 1]] - first if loss.shape[1] > 1 else np.full(n, np.inf)
    share = np.exp(-(loss - first[:, None]) * model.code.shape[1])
    names = np.array([*model.langs, UNKNOWN], object)
    return names[np.where(known, order[:, 0], len(model.langs))], np.where(known, 1 / share.sum(axis=1), 0.0), known & (gap < AMBIGUITY_MARGIN)


def _decode(model: EcocModel):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in text_chunks(batches, "text", 1_000_000):
            pred, score, ambiguous = decide(model, np.array(rows.column("has_letter").to_pylist(), bool), data, offsets)
            yield pa.RecordBatch.from_arrays(
                [rows.column("doc_id"), rows.column("held_out"), pa.array(pred, pa.string()), pa.array(score), pa.array(ambiguous)],
                ["doc_id", "held_out", "lang_pred", "score", "ambiguous"])

    return run


def _keep(model: EcocModel, text_col: str, letter_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in text_chunks(batches, text_col, 1_000_000):
            lettered = np.array(rows.column(letter_col).to_pylist(), bool)
            pred, _, ambiguous = decide(model, lettered, data, offsets)
            good = (pred != UNKNOWN) & ~ambiguous if model.langs else lettered
            yield rows.filter(pa.array(good)).drop_columns([letter_col])

    return run


def held_out(doc_id: Column, folds: int = 5) -> Column:
    """The fold rule: crc32 of the id as text, remainder 0."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % folds == 0, F.lit(False))


def identify(docs: DataFrame, folds: int = 5, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(doc_id, held_out, lang_pred, score, ambiguous) of every row; learns from the rows outside the held-out fold."""
    doc_id = F.col(id_col).cast("long")
    model = fit(docs.where(doc_id.isNotNull() & ~held_out(doc_id, folds)), text_col, lang_col)
    rows = docs.select(doc_id.alias("doc_id"), held_out(doc_id, folds).alias("held_out"), F.col(text_col).alias("text"), has_letter(text_col).alias("has_letter"))
    return rows.mapInArrow(_decode(model), "doc_id long, held_out boolean, lang_pred string, score double, ambiguous boolean")


def has_letter(text_col: str) -> Column:
    return F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False))


def keep_identified(docs: DataFrame, folds: int = 5, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``docs`` without the rows that get no language (``und``) or whose language is ambiguous; all columns stay.

    Each row is judged by its own text, whatever its id. Without a row to learn from, only rows without a letter go.
    """
    doc_id = F.col(id_col).cast("long")
    model = fit(docs.where(doc_id.isNotNull() & ~held_out(doc_id, folds)), text_col, lang_col)
    plain, (text,) = by_place(docs, text_col)
    judged = plain.withColumn("has_letter", has_letter(text)).mapInArrow(_keep(model, text, "has_letter"), plain.schema)
    return judged.toDF(*docs.columns)
