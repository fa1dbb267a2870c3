"""Toxicity by classifier chains.

Categories are predicted one after the other by linear models over hashed words and word
stems of a document; each later model also sees the probabilities of the earlier
categories. For training, those come from models that have not seen the document
(out-of-fold), so later models learn how much they can rely on them. A feature is used if
it is clearly more frequent in positive documents and survives an L1 penalty.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

LABELLED_ROWS = 8_000  # labelled documents used for fitting, at most about this many
FOLDS = 3
STEMS = (4, 5, 6, 7)  # leading letters that make a stem
MIN_DOCS = 4  # positive documents a feature must occur in
LIFT = 4.0  # standard deviations by which it must be more frequent in them
THRESHOLD = 0.5
# categories that refine the label: toxic documents that use one of these words
PERSONS = ("clown", "idiot", "loser", "moron", "scum")
CONTEMPT = ("disgusting", "pathetic", "stupid", "trash", "worthless")
CATEGORIES = ("insult", "contempt", "toxic")
_WORD = re.compile(r"[^\W\d_]+")
_CACHE_WORDS = 400_000
_LENGTH = 60  # words added to a text's length when a stem's rate is taken


def words_of(text: str | None) -> list[str]:
    """Lower-case letter runs of a whole text; null has none."""
    return _WORD.findall(text.lower()) if text else []


def _word_id(word: str) -> int:
    return zlib.crc32(word.encode())


def _stem_ids(word: str) -> list[int]:
    return [zlib.crc32((word[:k] + "*").encode()) for k in STEMS if len(word) > k]


def _rate(count, words: int):
    return np.minimum(100.0 * count / (words + _LENGTH), 3.0)


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Feature hashes and values: 1 for a word that occurs, the rate per 100 words for a stem."""
    words = words_of(text)
    distinct = set(words)
    ids = np.fromiter(map(_word_id, distinct), np.uint32, len(distinct))
    stems: dict[int, int] = {}
    for w in words:
        for k in _stem_ids(w):
            stems[k] = stems.get(k, 0) + 1
    at = np.fromiter(stems, np.uint32, len(stems))
    rates = _rate(np.fromiter(stems.values(), np.float64, len(stems)), len(words))
    return np.concatenate([ids, at]), np.concatenate([np.ones(len(ids)), rates]).astype(np.float32)


class _Sparse:
    """Rows of (feature hashes, values), with dense extra columns at hand."""

    def __init__(self, rows: list[tuple[np.ndarray, np.ndarray]]):
        lens = np.array([len(a) for a, _ in rows], np.int64)
        hashes = np.concatenate([a for a, _ in rows]) if rows else np.empty(0, np.uint32)
        self.hashes, self.at = np.unique(hashes, return_inverse=True)
        self.values = np.concatenate([v for _, v in rows]) if rows else np.empty(0, np.float32)
        self.row = np.repeat(np.arange(len(rows)), lens)
        self.width, self.rows = max(len(self.hashes), 1), len(rows)

    def fit(self, y: np.ndarray, extra: np.ndarray, use: np.ndarray) -> tuple:
        """Logistic regression on the rows ``use``: an L1 fit chooses features, a second weighs them.

        The penalty falls with the root of the number of rows, as chance correlations do.
        """
        inside = use[self.row]
        n = np.bincount(self.at[inside], minlength=self.width)
        positive = np.bincount(self.at[inside], weights=y[self.row[inside]], minlength=self.width)
        base = float(y[use].mean()) if use.any() else 0.0
        lift = (positive - n * base) / np.sqrt(np.maximum(n * base * (1 - base), 1e-9))
        chosen = (positive >= MIN_DOCS) & (lift >= LIFT)
        penalty = max(1e-3, 0.1 / max(int(use.sum()), 1) ** 0.5)
        chosen = self._steps(y, extra, use, penalty, chosen)[0] > 0
        return self._steps(y, extra, use, 1e-4, chosen)

    def _steps(self, y, extra, use, l1: float, chosen: np.ndarray, rounds: int = 150) -> tuple:
        inside = use[self.row] & chosen[self.at]
        at, row, x = self.at[inside], self.row[inside], self.values[inside]
        w, v, b = np.zeros(self.width), np.zeros(extra.shape[1]), 0.0
        sw, sv, sb = np.full(self.width, 1e-8), np.full(extra.shape[1], 1e-8), 1e-8
        n = max(int(use.sum()), 1)
        for _ in range(rounds):
            z = np.bincount(row, weights=w[at] * x, minlength=self.rows) + extra @ v + b
            error = np.where(use, 1 / (1 + np.exp(-np.clip(z, -40, 40))) - y, 0.0) / n
            g, gv, gb = np.bincount(at, weights=error[row] * x, minlength=self.width), extra.T @ error, error.sum()
            sw, sv, sb = sw + g * g, sv + gv * gv, sb + gb * gb
            step = 0.5 / np.sqrt(sw)
            w = np.maximum(w - step * (g + l1), 0.0)
            v, b = v - 0.5 * gv / np.sqrt(sv), b - 0.5 * gb / np.sqrt(sb)
        return np.where(chosen, w, 0.0), v, b

    def predict(self, model: tuple, extra: np.ndarray) -> np.ndarray:
        w, v, b = model
        z = np.bincount(self.row, weights=w[self.at] * self.values, minlength=self.rows) + extra @ v + b
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit_chain(rows: list[tuple[np.ndarray, np.ndarray, int]], folds: int = FOLDS) -> dict:
    """The chain's models from (feature hashes, values, toxic) rows; features without weight go."""
    docs = _Sparse([r[:2] for r in rows])
    toxic = np.array([r[2] for r in rows], np.float64)
    uses = lambda names: np.array([float(np.isin(a, [_word_id(w) for w in names]).any()) for a, _, _ in rows])
    labels = {"insult": toxic * uses(PERSONS), "contempt": toxic * uses(CONTEMPT), "toxic": toxic}
    fold = np.arange(len(rows)) % folds
    extra, models = np.zeros((len(rows), 0)), []
    for name in CATEGORIES:
        y = labels[name]
        models.append(docs.fit(y, extra, np.ones(len(rows), bool)))
        if name == CATEGORIES[-1]:
            break
        held_out = np.zeros(len(rows))
        for k in range(folds):
            part = docs.fit(y, extra, fold != k)
            held_out = np.where(fold == k, docs.predict(part, extra), held_out)
        extra = np.column_stack([extra, held_out])
    weighed = np.flatnonzero(np.any([m[0] != 0 for m in models], axis=0)) if len(docs.hashes) else []
    weights = {int(docs.hashes[k]): tuple(float(m[0][k]) for m in models) for k in weighed}
    return {"weights": weights, "chain": [(m[1].tolist(), float(m[2])) for m in models], "rows": len(rows)}


class _Known(dict):
    """Word to its weighed features: None, or (word feature or None, weighed stems)."""

    def __init__(self, weights: dict):
        self._weights = weights

    def __missing__(self, word: str):
        if len(self) >= _CACHE_WORDS:
            self.clear()
        own = _word_id(word)
        stems = tuple(k for k in _stem_ids(word) if k in self._weights)
        found = (own if own in self._weights else None, stems) if stems or own in self._weights else None
        if len(word) <= 64:
            self[word] = found
        return found


def predict(text: str | None, model: dict, known: _Known) -> list[float]:
    """Probabilities of the categories, in chain order."""
    words = words_of(text)
    value: dict[int, float] = {}
    for own, stems in filter(None, map(known.__getitem__, words)):
        if own is not None:
            value[own] = -1.0  # a word counts once
        for k in stems:
            value[k] = value.get(k, 0.0) + 1.0
    hits = [(model["weights"][k], 1.0 if c < 0 else float(_rate(c, len(words)))) for k, c in value.items()]
    out: list[float] = []
    for k, (v, b) in enumerate(model["chain"]):
        z = b + sum(w[k] * x for w, x in hits) + sum(a * p for a, p in zip(v, out))
        out.append(1 / (1 + float(np.exp(-max(min(z, 40.0), -40.0)))))
    return out


def fit(docs: DataFrame, labels: DataFrame, labelled_rows: int = LABELLED_ROWS, seed: int = 5) -> dict:
    """Fits the chain on a hash-drawn sample of about ``labelled_rows`` labelled documents.

    Labels without a value, and labels whose document is missing, are left out. Only
    the sample's feature hashes come to the driver.
    """
    known = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    total = known.count()
    share = min(1.0, labelled_rows / total) if total else 0.0
    drawn = known.where(F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1 << 30)) < int(share * (1 << 30)))
    sample = docs.select("doc_id", "text").join(F.broadcast(drawn), "doc_id").where("text IS NOT NULL")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [features(t.as_py()) for t in batch.column("text")]
            at = pa.array([a.astype("<u4").tobytes() for a, _ in found], pa.binary())
            values = pa.array([v.astype("<f4").tobytes() for _, v in found], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), at, values], names=["toxic", "at", "values"])

    kind = T.StructType([sample.schema["toxic"], T.StructField("at", T.BinaryType()), T.StructField("values", T.BinaryType())])
    got = sorted((bytes(r["at"]), bytes(r["values"]), int(r["toxic"] > 0)) for r in sample.select("toxic", "text").mapInArrow(rows, kind).collect())
    return fit_chain([(np.frombuffer(a, "<u4"), np.frombuffer(v, "<f4"), y) for a, v, y in got])


_SCORES = "struct<" + ", ".join(f"p_{c} double" for c in CATEGORIES) + ">"


def score(docs: DataFrame, model: dict) -> DataFrame:
    """``docs`` with the probabilities ``p_insult``, ``p_contempt``, ``p_toxic``.

    Null and empty texts have no words, so they get what the models say without any.
    """

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        known = _Known(model["weights"])
        for texts in batches:
            yield pd.DataFrame([predict(t, model, known) for t in texts], columns=[f"p_{c}" for c in CATEGORIES], dtype="float64")

    # named nondeterministic so that a filter on the scores does not run it a second time
    scored = docs.withColumn("__p", F.pandas_udf(run, _SCORES).asNondeterministic()("text"))
    return scored.withColumns({f"p_{c}": F.col(f"__p.p_{c}") for c in CATEGORIES}).drop("__p")
