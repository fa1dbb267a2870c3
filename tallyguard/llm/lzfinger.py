"""Document fingerprints from Lempel-Ziv phrase sets.

A text is parsed into dictionary phrases: each phrase is the shortest run that has not
been a phrase before. The dictionary is keyed by (number of the phrase without its last
code point, last code point), so a step costs the same however long the phrase is. The set of phrases is hashed and its smallest hashes are the signature; the likeness of two signatures estimates the
Jaccard similarity of the phrase sets, which behaves like compression distance.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

KEPT = 48  # smallest hashes in a signature
_CHUNKS = 2  # key ranges per shuffle partition in ``edited_neighbours``
# odd multipliers of the phrase hash and its finalizer
_BASE, _M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_CODES = 0x110000  # code points, so parent * _CODES + code is a key of its own


class Parse:
    """A parse that can go on: the dictionary, the ends of the phrases, the unfinished phrase."""

    def __init__(self):
        self.phrases: dict[int, int] = {}
        self.ends: list[int] = []
        self.chars, self.node = 0, 0

    def copy(self) -> Parse:
        other = Parse()
        other.phrases, other.ends = dict(self.phrases), list(self.ends)
        other.chars, other.node = self.chars, self.node
        return other

    def feed(self, text: str) -> Parse:
        """Goes on with ``text``; a phrase may begin in what came before."""
        node, phrases, ends, found = self.node, self.phrases, self.ends, self.phrases.get
        for at, code in enumerate(_codes(text).tolist(), self.chars + 1):
            key = node * _CODES + code
            node = found(key)
            if node is None:
                phrases[key] = len(phrases) + 1
                ends.append(at)
                node = 0
        self.node, self.chars = node, self.chars + len(text)
        return self


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def phrases(text: str) -> list[str]:
    """The phrases of ``text`` in order of appearance, each once; an unfinished last one equals an earlier one."""
    ends = Parse().feed(text).ends
    return [text[a:b] for a, b in zip([0, *ends], ends)]


_powers = np.ones(1, np.uint64)


def _powers_to(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        with np.errstate(over="ignore"):
            _powers = np.cumprod(np.full(2 * n, _BASE, dtype=np.uint64))
    return _powers


def signature(text: str, ends: list[int], kept: int = KEPT) -> np.ndarray:
    """The ``kept`` smallest 32-bit hashes of the phrases of ``text``, ascending.

    Phrases follow each other without gaps and end at ``ends``. Sets with fewer distinct
    hashes are kept whole.
    """
    if not ends:
        return np.empty(0, np.uint32)
    stops = np.array(ends, np.int64)
    starts = np.concatenate([[0], stops[:-1]])
    lens = stops - starts
    codes = _codes(text)[: ends[-1]].astype(np.uint64)
    with np.errstate(over="ignore"):
        codes += np.uint64(1)
        codes *= _powers_to(int(lens.max()))[np.arange(len(codes)) - np.repeat(starts, lens)]
        h = np.add.reduceat(codes, starts)
        h ^= h >> np.uint64(30)
        h *= _M1
        h ^= h >> np.uint64(27)
        h *= _M2
        h ^= h >> np.uint64(31)
    low = (h >> np.uint64(32)).astype(np.uint32)
    if len(low) > 4 * kept:
        low = np.partition(low, 4 * kept)[: 4 * kept]
    low = np.unique(low)
    return low[:kept]


def encode(sig: np.ndarray) -> str:
    return base64.b64encode(sig.astype("<u4").tobytes()).decode("ascii")


def decode(fingerprint: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(fingerprint), "<u4")


def fingerprint(text: str | None) -> str:
    """Fingerprint of one whole text; null and empty texts have the empty string."""
    return encode(signature(text or "", Parse().feed(text or "").ends))


def likeness(a: np.ndarray, b: np.ndarray, kept: int = KEPT) -> float:
    """Estimated Jaccard similarity of two phrase sets from their signatures, 0 to 1.

    The ``kept`` smallest hashes of the union are a random sample of it; the share of
    them in both sets is the estimate. Two empty sets are alike (1.0).
    """
    if not len(a) and not len(b):
        return 1.0
    union = np.union1d(a, b)[:kept]
    both = np.intersect1d(a, b, assume_unique=True)
    return float(np.searchsorted(both, union[-1], side="right")) / len(union)


def edit(text: str, following: str) -> str:
    """``text`` with its last half (rounded down) replaced by the start of ``following``."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


_OUT = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("n_chars", T.LongType()),
        T.StructField("edited_sha256", T.StringType()),
        T.StructField("fingerprint", T.StringType()),
        T.StructField("edited_fingerprint", T.StringType()),
        T.StructField("near_edited", T.DoubleType()),
        T.StructField("near_next", T.DoubleType()),
    ]
)


class _Doc:
    """One text with its parse, which an edited text shares up to the middle."""

    def __init__(self, doc_id, text):
        self.doc_id, self.text = doc_id, text or ""
        self.half = len(self.text) // 2
        head = self.text[: len(self.text) - self.half]
        self.parsed = Parse().feed(head)
        self.sig = signature(self.text, self.parsed.copy().feed(self.text[len(head) :]).ends)

    def against(self, following: _Doc) -> tuple:
        part = following.text[: self.half]
        text = self.text[: len(self.text) - self.half] + part
        edited = signature(text, self.parsed.feed(part).ends)
        self.parsed = None
        digest = hashlib.sha256(text.encode("utf-8")).hexdigest()
        near = likeness(self.sig, edited), likeness(self.sig, following.sig)
        return self.doc_id, len(self.text), digest, encode(self.sig), encode(edited), *near


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a partition by chunk, descending id, then the first row of the next chunk."""
    last, chunk, out = None, None, []

    def flush():
        columns = list(zip(*out)) if out else [[]] * len(_OUT)
        types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types)], names=_OUT.names)

    for batch in batches:
        at = [batch.column(n) for n in ("chunk", "tail", "doc_id", "text")]
        for i in range(batch.num_rows):
            c, tail, doc_id, text = (x[i].as_py() for x in at)
            doc = _Doc(doc_id, text)
            if last is not None and c == chunk:
                out.append(last.against(doc))
            last, chunk = (None if tail else doc), c
            if len(out) >= 1000:
                yield flush()
                out = []
    yield flush()


def edited_neighbours(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text of ``docs`` (doc_id, text), and of its edited text.

    The edited text takes its last half from the next document by descending doc_id
    (null ids last, equal ids in text order); after the last comes the first. Rows go by
    key ranges to sorted partitions; the ranges are split where approximate quantiles of
    doc_id say (as many numbers as there are ranges), and each range also gets the first
    row of the next. So the texts are shuffled once, and a task holds two at a time. Rows of
    one doc_id, and all rows without one, are of one range and so of one task.
    Null texts are empty. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    n = parts * _CHUNKS
    cuts = docs.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)], 10_000)).first()[0] or []
    cuts = [float("-inf"), *sorted({float(c) for c in cuts} or {0.0}), float("inf")]
    # chunk numbers rise as ids fall; any rising function of the id may deal them out
    at = F.col("doc_id").cast("double").alias("_at")
    rows = Bucketizer(splits=cuts, inputCol="_at", outputCol="_bucket", handleInvalid="keep").transform(docs.select("*", at))
    last = len(cuts) - 2
    chunk = F.when(F.col("doc_id").isNull(), last + 1).otherwise(F.lit(last) - F.col("_bucket").cast("int"))
    rows = rows.withColumn("chunk", chunk).drop("_at", "_bucket")
    firsts = rows.groupBy("chunk").agg(F.max("doc_id").alias("id")).orderBy("chunk").collect()
    ids = [r["id"] for r in firsts if r["id"] is not None]
    first = F.col("doc_id").isin(ids) if ids else F.lit(False)
    heads = rows.where(first | (F.col("doc_id").isNull() if len(ids) < len(firsts) else F.lit(False)))
    heads = heads.groupBy("chunk", "doc_id").agg(F.min("text").alias("text"))
    before = {r["chunk"]: firsts[i - 1]["chunk"] for i, r in enumerate(firsts)}
    if not before:
        return spark.createDataFrame([], _OUT)
    back = F.element_at(F.create_map(*[F.lit(x) for kv in before.items() for x in kv]), F.col("chunk"))
    tails = heads.select(back.alias("chunk"), F.lit(True).alias("tail"), "doc_id", "text")
    both = rows.select("chunk", F.lit(False).alias("tail"), "doc_id", "text").unionByName(tails)
    placed = both.repartitionById(last + 2, "chunk").sortWithinPartitions("chunk", "tail", F.col("doc_id").desc_nulls_last(), "text")
    return placed.mapInArrow(_pairs, _OUT)
