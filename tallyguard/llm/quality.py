"""Quality classifier from weak labels.

Overlapping heuristic labellers vote on every document: good, bad or nothing. Votes are
counted per vote pattern over the whole corpus, and expectation-maximisation estimates
from those counts how reliable each labeller is and how likely each pattern is to be a
good document. These posteriors are the labels on which a linear scorer over hashed
word-shape features is trained; the scorer decides.
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

from tallyguard.llm.lookup import claim

BUCKETS = 2048  # hashed features
TRAIN_ROWS = 6_000  # distinct texts the scorer is fitted on, about this many at most
KEEP = 0.5
BAD, GOOD, NONE = 0, 1, 2
LABELLERS = ("symbols", "separators", "capitals", "repeats", "clean_words", "short_words")
_CACHE_WORDS = 150_000  # an executor has several workers, each with a table of its own
_SYMBOLS = "#$%&*~^=<>\\"
_FEW = 6  # words below which the general labellers abstain
_CLEAN = re.compile(r"[(\"'«]?[^\W\d_]?[^\W\d_A-ZÀ-ÖØ-Þ]*[.,;:?!]?[)\"'»]?")


def _shape(word: str) -> str:
    s = re.sub(r"[^\W\d_]+", lambda x: "A" if x[0].isupper() and len(x[0]) > 1 else "Aa" if x[0][0].isupper() else "a", word)
    return re.sub(r"\d+", "0", s)[:12]


class _Words(dict):
    """Word to 4 times the feature number of its shape, plus 0 (odd), 1 (a plain word) or 2
    (a plain word of up to three small letters); filled as words are met."""

    def __missing__(self, word: str) -> int:
        if len(self) >= _CACHE_WORDS:
            self.clear()
        plain = len(word) <= 64 and _CLEAN.fullmatch(word) is not None
        kind = 0 if not plain else 2 if len(word.rstrip(".,;:?!")) <= 3 and word[0].islower() else 1
        code = _CODES[zlib.crc32(_shape(word[:256]).encode()) % BUCKETS * 4 + kind]
        if len(word) <= 64:
            self[word] = code
        return code


_CODES = tuple(range(4 * BUCKETS))  # one object per code, whatever the number of words
_WORDS = _Words()


def _codes(words: list[str]) -> np.ndarray:
    return np.fromiter(map(_WORDS.__getitem__, words), np.int64, len(words))


def _signals(text: str, words: list[str], codes: np.ndarray) -> tuple[float, ...]:
    """Per word: symbols, separators, words in capitals, repeats of the word before,
    plain words, and short plain words in small letters (the last two without repeats)."""
    n = len(words)
    marked = sum(text.count(c) for c in _SYMBOLS)
    bars = text.count("|") + text.count("\t")
    shout = sum(map(str.isupper, words)) - sum(1 for w in words if len(w) < 3 and w.isupper())
    same = sum(map(str.__eq__, words, words[1:]))
    kinds = codes & 3
    odd, short = int(np.count_nonzero(kinds == 0)), int(np.count_nonzero(kinds == 2))
    again = same / max(n - 1, 1)
    return marked / n, bars / n, shout / n, again, (n - odd) / n * (1 - again), short / n * (1 - again)


# per labeller: (bad from, good up to); between them it abstains
_DEFECTS = ((0.2, 0.05), (0.15, 0.05), (0.35, 0.15), (0.15, 0.05))
# (bad up to, good from)
_MERITS = ((0.6, 0.85), (0.05, 0.15))


def votes(signals: tuple[float, ...], n: int) -> tuple[int, ...]:
    """One vote per labeller for a text of ``n`` words."""
    out = [BAD if s >= bad else GOOD if s <= good else NONE for s, (bad, good) in zip(signals, _DEFECTS)]
    for s, (bad, good) in zip(signals[len(_DEFECTS) :], _MERITS):
        out.append(NONE if n < _FEW else BAD if s <= bad else GOOD if s >= good else NONE)
    return tuple(out)


def pattern(v: tuple[int, ...]) -> int:
    return sum(x * 3**k for k, x in enumerate(v))


def fit_labellers(counts: dict[int, int], rounds: int = 200) -> dict:
    """EM over vote patterns: prior of good, P(vote | class, votes) per labeller, posteriors.

    Starts from the votes against a document, so "good" keeps its meaning. Abstentions
    say nothing about the class; pseudo-counts favour labellers that are right.
    """
    m = len(LABELLERS)
    codes = np.array(sorted(counts), dtype=np.int64)
    n = np.array([counts[c] for c in codes.tolist()], dtype=np.float64)
    v = (codes[:, None] // 3 ** np.arange(m)[None, :]) % 3
    good, bad = (v == GOOD).sum(1), (v == BAD).sum(1)
    q = np.clip((good + 1) / (good + bad + 2), 0.02, 0.98)
    q = np.where(bad > 0, np.minimum(q, 0.5 ** bad), q)
    onehot = (v[:, :, None] == np.arange(3)).astype(np.float64)
    onehot = onehot[:, :, :NONE]
    prior, table = 0.5, np.full((2, m, 2), 0.5)
    favoured = np.array([[2.0, 1.0], [1.0, 2.0]])
    for _ in range(rounds if len(codes) else 0):
        prior = (np.dot(n, q) + 1) / (n.sum() + 2)
        for y, w in ((0, n * (1 - q)), (1, n * q)):
            t = np.einsum("p,pmv->mv", w, onehot) + favoured[y]
            table[y] = t / t.sum(1, keepdims=True)
        log = [np.einsum("pmv,mv->p", onehot, np.log(table[y])) for y in (0, 1)]
        fresh = 1 / (1 + np.exp(np.clip(log[0] + np.log(1 - prior) - log[1] - np.log(prior), -50, 50)))
        if np.abs(fresh - q).max() < 1e-9:
            break
        q = fresh
    accuracy = {}
    for k, name in enumerate(LABELLERS):
        right = prior * table[1, k, GOOD] + (1 - prior) * table[0, k, BAD]
        spoken = right + prior * table[1, k, BAD] + (1 - prior) * table[0, k, GOOD]
        accuracy[name] = float(right / spoken)
    return {"prior": float(prior), "posterior": dict(zip(codes.tolist(), q.tolist())), "accuracy": accuracy}


def features(words: list[str], codes: np.ndarray, signals: tuple[float, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features: word-shape frequencies, and the bucketised signals."""
    count = np.bincount(codes >> 2, minlength=BUCKETS).astype(np.float32)
    at = np.flatnonzero(count)
    weigh = np.float32(1 / (len(words) + _FEW))  # a short text says little either way
    steps = [f"{name}={min(int(s * 10), 15)}" for name, s in zip(LABELLERS, signals)]
    extra = np.array([zlib.crc32(s.encode()) % BUCKETS for s in steps])
    half = np.full(len(extra), len(words) * weigh / 2, np.float32)
    return np.concatenate([at, extra]), np.concatenate([count[at] * weigh * 4, half]).astype(np.float32)


def fit_scorer(rows: list[tuple[np.ndarray, np.ndarray, float]], rounds: int = 300) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels, full batch with per-weight steps."""
    w, b = np.zeros(BUCKETS, np.float32), np.float32(0)
    if not rows:
        return w, b
    x = np.zeros((len(rows), BUCKETS), np.float32)
    y = np.array([r[2] for r in rows], np.float32)
    for i, (at, values, _) in enumerate(rows):
        np.add.at(x[i], at, values)
    used = np.flatnonzero(x.any(0))
    x, v = x[:, used], np.zeros(len(used), np.float32)
    square, square_b = np.full(len(used), 1e-6, np.float32), np.float32(1e-6)
    for _ in range(rounds):
        error = 1 / (1 + np.exp(-(x @ v + b))) - y
        g, gb = x.T @ error / len(y) + 1e-4 * v, error.mean()
        square, square_b = square + g * g, square_b + gb * gb
        v, b = v - 0.5 * g / np.sqrt(square), b - 0.5 * gb / np.sqrt(square_b)
    w[used] = v
    return w, float(b)


def _vote_code(texts: pd.Series) -> pd.Series:
    claim("quality", _WORDS)
    out = []
    for t in texts:
        words = t.split() if t else []
        out.append(pattern(votes(_signals(t, words, _codes(words)), len(words))) if words else -1)
    return pd.Series(out, dtype="int64")


def fit(docs: DataFrame, train_rows: int = TRAIN_ROWS, seed: int = 11) -> dict:
    """The label model, from the votes on all of ``docs``, and the scorer.

    The label model is fitted on counts per vote pattern (3 to the number of labellers at
    most), in which repeated rows count as often as they occur. The scorer is fitted on a
    hash-drawn sample of about ``train_rows`` distinct texts, each once however many rows
    have it, so copies neither enlarge the sample nor outvote the rest. Its sparse features
    come to the driver; the number of distinct texts is estimated to 1%.
    """
    vote, h = F.pandas_udf(_vote_code, "bigint"), F.xxhash64(F.lit(seed), "text")
    voted = docs.select(vote("text").alias("v"), h.alias("h")).groupBy("v")
    counted = voted.agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct("h", 0.01).alias("d")).where("v >= 0").collect()
    model = fit_labellers({r["v"]: r["n"] for r in counted})
    distinct = sum(r["d"] for r in counted)
    share = min(1.0, train_rows / distinct) if distinct else 0.0
    drawn = docs.select("text").where(F.pmod(h, F.lit(1 << 30)) < int(share * (1 << 30))).dropDuplicates(["text"])
    posterior = model["posterior"]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("quality", _WORDS)
        for batch in batches:
            found = []
            for t in batch.column("text").to_pylist():
                words = t.split() if t else []
                if not words:
                    continue
                codes = _codes(words)
                s = _signals(t, words, codes)
                at, values = features(words, codes, s)
                y = posterior.get(pattern(votes(s, len(words))), 0.5)
                found.append({"at": at.astype("<i4").tobytes(), "values": values.astype("<f4").tobytes(), "y": y})
            yield pa.RecordBatch.from_pylist(found, pa.schema([("at", pa.binary()), ("values", pa.binary()), ("y", pa.float64())]))

    kind = T.StructType([T.StructField("at", T.BinaryType()), T.StructField("values", T.BinaryType()), T.StructField("y", T.DoubleType())])
    sample = drawn.mapInArrow(rows, kind).collect()
    model["sample"] = len(sample)
    ordered = sorted((bytes(r["at"]), bytes(r["values"]), r["y"]) for r in sample)
    model["weights"], model["bias"] = fit_scorer([(np.frombuffer(a, "<i4"), np.frombuffer(v, "<f4"), y) for a, v, y in ordered])
    return model


_SCORES = "struct<votes int, weak_label double, quality double>"


def score(docs: DataFrame, model: dict) -> DataFrame:
    """``docs`` with ``votes`` (pattern code), ``weak_label`` (posterior) and ``quality``.

    ``quality`` is the scorer's probability that the document is good. Texts that are
    null or without words have votes and weak_label null and quality 0.
    """
    weights, bias, posterior = model["weights"], model["bias"], model["posterior"]

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        claim("quality", _WORDS)
        for texts in batches:
            out = []
            for t in texts:
                words = t.split() if t else []
                if not words:
                    out.append((None, None, 0.0))
                    continue
                codes = _codes(words)
                s = _signals(t, words, codes)
                at, values = features(words, codes, s)
                code = pattern(votes(s, len(words)))
                z = float(np.dot(weights[at], values)) + bias
                out.append((code, posterior.get(code), 1 / (1 + float(np.exp(-max(min(z, 50.0), -50.0))))))
            frame = pd.DataFrame(out, columns=["votes", "weak_label", "quality"])
            yield frame.astype({"votes": "Int32", "weak_label": "float64", "quality": "float64"})

    # named nondeterministic so that a filter on the scores does not run it a second time
    scored = docs.withColumn("__q", F.pandas_udf(run, _SCORES).asNondeterministic()("text"))
    return scored.withColumns({n: F.col(f"__q.{n}") for n in ("votes", "weak_label", "quality")}).drop("__q")


def keep_good(docs: DataFrame, threshold: float = KEEP, **options) -> DataFrame:
    """Pipeline stage form: the documents scored ``threshold`` or more, columns unchanged."""
    model = fit(docs, **options)
    scored = score(docs.select(F.struct(*docs.columns).alias("__doc"), "text"), model)
    return scored.where(F.col("quality") >= threshold).select("__doc.*")
