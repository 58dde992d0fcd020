"""Quality classifier: ordinal cumulative-link regression on graded ratings.

One weight vector over hashed text features is shared by all grades; ordered thresholds
``t_0 < t_1 < ...`` turn a document's score ``s`` into ``P(grade <= k) = sigmoid(t_k - s)``.
From these come the expected grade and the tail probability ``P(grade >= k)`` used for
selection.

Features are binary: hashed lower-cased words, and hashed "shape" marks (shares of
symbols, digits and upper-case letters, mean word length, length, repeated lines).

The model is trained on the driver from at most ``sample_rows`` labelled documents, the
ones with the smallest id hashes (a bound that doesn't grow with the corpus); every
document is scored.  Features whose presence doesn't depend on the grade in the sample (a
chi-squared statistic of at most ``least_statistic``) get no weight: common words would
drown the few that tell, such as insults.  Null or empty texts get the mark "empty" only.  Labels with nulls are
left out; of several labels of one document the lowest grade holds, and of several texts
under one labelled id the smallest is learned from (each is scored).  With fewer than two
grades in the sample nothing can be learned: every document gets the top grade.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIMENSIONS = 1 << 18
#: Every byte that is no letter, digit or part of a longer UTF-8 character becomes a blank.
_BLANKED = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))
_SYMBOLS = bytes(b for b in range(33, 127) if not chr(b).isalnum())
_DIGITS, _CAPITALS = b"0123456789", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _step(share: float) -> int:
    """A share from 0 to 1 on a scale that is finer near 0."""
    return int(np.searchsorted((0.005, 0.01, 0.02, 0.04, 0.06, 0.08, 0.12, 0.2, 0.35, 0.6), share))


class Features:
    """Sorted distinct feature numbers of a text; word hashes are memoised up to a fixed number of words."""

    def __init__(self, memo: int = 200_000):
        self.memo, self.seen = memo, {}

    def _word(self, word: bytes) -> int:
        if len(self.seen) >= self.memo:
            self.seen.clear()
        value = self.seen[word] = zlib.crc32(word) % DIMENSIONS
        return value

    def __call__(self, text: str | None) -> np.ndarray:
        raw = (text or "").encode("utf-8", "surrogatepass")
        words = raw.lower().translate(_BLANKED).split()
        seen, slow = self.seen, self._word
        found = {seen.get(w) or slow(w) for w in set(words)}
        if raw.strip():
            n = len(raw)
            lines = [x for x in raw.split(b"\n") if x.strip()]
            marks = {
                "symbols": _step((n - len(raw.translate(None, _SYMBOLS))) / n),
                "digits": _step((n - len(raw.translate(None, _DIGITS))) / n),
                "capitals": _step((n - len(raw.translate(None, _CAPITALS))) / n),
                "word": min(20, sum(map(len, words)) // max(1, len(words))),
                "length": int(np.log2(n)),
                "repeated": _step(1 - len(set(lines)) / max(1, len(lines))),
                "variety": _step(len(set(words)) / max(1, len(words))),
            }
        else:
            marks = {"empty": 1}
        found |= {zlib.crc32(f"\0{k}:{v}".encode()) % DIMENSIONS for k, v in marks.items()}
        return np.array(sorted(found), dtype=np.int32)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


@dataclass
class OrdinalModel:
    """Shared weights and ordered thresholds; ``grades`` counts the grades, from 0."""

    weights: np.ndarray
    thresholds: np.ndarray

    @property
    def grades(self) -> int:
        return len(self.thresholds) + 1

    def tails(self, scores: np.ndarray) -> np.ndarray:
        """``P(grade >= k)`` for k = 1 .. grades - 1, a column each."""
        return 1 - _sigmoid(self.thresholds[None, :] - scores[:, None])


def chi_squared(rows: list[np.ndarray], grades: np.ndarray, n_grades: int) -> np.ndarray:
    """For every feature the statistic of its presence against the grades; 0 for features of no row or of all."""
    flat, owner = np.concatenate(rows), np.repeat(grades, [len(r) for r in rows])
    sizes = np.bincount(grades, minlength=n_grades).astype(float)
    holding = np.stack([np.bincount(flat[owner == k], minlength=DIMENSIONS) for k in range(n_grades)]).astype(float)
    share = holding.sum(axis=0) / len(rows)
    usual = np.outer(sizes, share)
    spread = usual * (1 - share)  # both of a feature's cells, with it and without it, are off by the same amount
    return np.divide((holding - usual) ** 2, spread, out=np.zeros_like(usual), where=spread > 0).sum(axis=0)


def fit(
    rows: list[np.ndarray], grades: np.ndarray, n_grades: int, epochs: int = 12, rate: float = 0.15, decay: float = 4e-3,
    least_statistic: float = 25.0, seed: int = 3,
) -> OrdinalModel:
    """Maximum likelihood by mini-batch AdaGrad, over the features that tell grades apart."""
    used = chi_squared(rows, grades, n_grades) > least_statistic
    rows = [r[used[r]] for r in rows]
    weights, squares = np.zeros(DIMENSIONS), np.full(DIMENSIONS, 1e-2)
    # thresholds start at the grades' own shares; gaps are kept positive through their logarithms
    below = np.array([(grades <= k).mean() for k in range(n_grades - 1)]).clip(1e-3, 1 - 1e-3)
    start = np.maximum.accumulate(np.log(below / (1 - below)) + 1e-2 * np.arange(n_grades - 1))
    raw = np.concatenate([start[:1], np.log(np.maximum(np.diff(start), 1e-2))])
    raw_squares = np.full(len(raw), 1e-2)
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), 64):
            batch = order[at : at + 64]
            flat = np.concatenate([rows[i] for i in batch])
            owner = np.repeat(np.arange(len(batch)), [len(rows[i]) for i in batch])
            scores = np.bincount(owner, weights[flat], len(batch))
            thresholds = np.cumsum(np.concatenate([raw[:1], np.exp(raw[1:])]))
            y = grades[batch]
            padded = np.concatenate([[-np.inf], thresholds, [np.inf]])
            high, low = _sigmoid(padded[y + 1] - scores), _sigmoid(padded[y] - scores)
            chance = np.maximum(high - low, 1e-9)
            d_high, d_low = high * (1 - high) / chance, low * (1 - low) / chance
            # ascent on the log-likelihood
            by_score = d_low - d_high
            by_threshold = np.zeros(n_grades + 1)
            np.add.at(by_threshold, y + 1, d_high)
            np.add.at(by_threshold, y, -d_low)
            by_threshold = by_threshold[1:-1]
            by_raw = np.cumsum(by_threshold[::-1])[::-1].copy()
            by_raw[1:] *= np.exp(raw[1:])
            touched, where = np.unique(flat, return_inverse=True)
            slope = np.bincount(where, by_score[owner], len(touched)) / len(batch) - decay * weights[touched]
            squares[touched] += slope**2
            weights[touched] += rate * slope / np.sqrt(squares[touched])
            by_raw /= len(batch)
            raw_squares += by_raw**2
            raw += rate * by_raw / np.sqrt(raw_squares)
    return OrdinalModel(weights.astype(np.float32), np.cumsum(np.concatenate([raw[:1], np.exp(raw[1:])])))


def graded(quality: str = "quality", toxic: str = "toxic") -> Column:
    """Grades from two marks: 0 poor or toxic and poor, 1 toxic but else good, 2 good."""
    return F.when(F.col(quality) == 0, 0).when(F.col(toxic) == 1, 1).otherwise(2).cast("int")


def labelled_sample(docs: DataFrame, labels: DataFrame, grade: Column, sample_rows: int) -> DataFrame:
    """``doc_id, grade, features`` of at most ``sample_rows`` labelled documents."""
    chosen = (
        labels.withColumn("grade", grade)
        .where("doc_id is not null and quality is not null and toxic is not null")
        .groupBy("doc_id")
        .agg(F.min("grade").alias("grade"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(sample_rows)
    )

    def extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        features = Features()
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "grade": b["grade"], "features": [features(t) for t in b["text"]]})

    # the chosen rows are ``sample_rows`` at most, so they may be broadcast
    return (
        docs.select("doc_id", F.col("text").cast("string").alias("text"))
        .join(F.broadcast(chosen), "doc_id")
        .groupBy("doc_id", "grade")
        .agg(F.min("text").alias("text"))  # an id may be repeated
        .mapInPandas(extract, "doc_id long, grade int, features array<int>")
    )


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = 12_000, n_grades: int = 3) -> OrdinalModel | None:
    """The model, or None where the labels hold fewer than two grades."""
    sample = labelled_sample(docs, labels, graded(), sample_rows).toPandas()
    sample = sample.sort_values("doc_id")
    if sample["grade"].nunique() < 2:
        return None
    return fit([np.asarray(x, np.int64) for x in sample["features"]], sample["grade"].to_numpy(), n_grades)


SCORED = "expected_grade double, tail_probability double, keep boolean"


def score(docs: DataFrame, model: OrdinalModel | None, least_tail: float = 0.5, n_grades: int = 3) -> DataFrame:
    """``docs`` with ``expected_grade``, ``tail_probability`` (of the top grade) and ``keep``.

    Columns of ``docs`` with these names are replaced.
    """
    plain = docs.drop("expected_grade", "tail_probability", "keep")
    if model is None:
        return plain.withColumns(
            {"expected_grade": F.lit(float(n_grades - 1)), "tail_probability": F.lit(1.0), "keep": F.lit(True)}
        )
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of fixed size

    @F.pandas_udf(SCORED)
    def scored(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        features, m = Features(), shared.value
        for t in texts:
            tails = m.tails(np.array([m.weights[features(x)].sum(dtype=np.float64) for x in t]).reshape(-1))
            yield pd.DataFrame(
                {"expected_grade": tails.sum(axis=1), "tail_probability": tails[:, -1], "keep": tails[:, -1] >= least_tail}
            )

    # columns are put beside the text by position, whatever their names
    return plain.withColumn("keep", scored(F.col("text").cast("string"))).select(
        *[c for c in plain.columns], "keep.expected_grade", "keep.tail_probability", F.col("keep.keep").alias("keep")
    )


def grade_documents(docs: DataFrame, labels: DataFrame, least_tail: float = 0.5, sample_rows: int = 12_000) -> DataFrame:
    """Train on the labelled sample and score every document."""
    return score(docs, train(docs, labels, sample_rows), least_tail)
