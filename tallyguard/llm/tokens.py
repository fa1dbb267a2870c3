"""Token counts by a map-side two-tier lookup.

A text's tokens are the sum over its white-space separated words: the tokenizers used
here drop white space before merging, so no token crosses it. Tier one is a broadcast
table with the token counts of the corpus's frequent words, found by mergeable
frequent-item sketches; tier two is a cache in each Python worker, which encodes a
word with the library the first time it is missed. Words are never shuffled.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FREQUENT = 2_000  # words of the broadcast table
TRACKED = 8_192  # items a sketch keeps
WORD_CHARS = 64  # longer words are not kept in either tier
CACHE_WORDS = 400_000  # words a worker keeps before it starts afresh
_SKETCH_GROUPS = 32  # first level of the merge tree
# str.split() also splits on these four, which the tokenizer keeps as text
_SEPARATORS = ("\x1c", "\x1d", "\x1e", "\x1f")


def frequent_words(texts: DataFrame, frequent: int = FREQUENT, tracked: int = TRACKED) -> list[str]:
    """The most frequent words of the column ``text``, over all rows.

    Every task feeds its words to a frequent-item sketch of bounded size; the sketches
    are merged in two levels. At most ``frequent`` words of ``WORD_CHARS`` characters
    reach the driver. Which words are found changes the speed of counting only.
    """
    words = texts.select(F.explode(F.split("text", r"\s+")).alias("w"), (F.spark_partition_id() % _SKETCH_GROUPS).alias("g"))
    words = words.where(F.length("w").between(1, WORD_CHARS))
    sketches = words.groupBy("g").agg(F.expr(f"approx_top_k_accumulate(w, {tracked})").alias("s"))
    merged = sketches.groupBy(F.lit("all")).agg(F.expr(f"approx_top_k_estimate(approx_top_k_combine(s, {tracked}), {frequent})").alias("top"))
    row = merged.first()
    return [x["item"] for x in row["top"]] if row else []


_TOKENIZERS: dict[int, object] = {}


def _tokenizer(spec: str):
    key = hash(spec)
    if key not in _TOKENIZERS:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tok = Tokenizer.from_str(spec)
        tok.no_truncation()
        tok.no_padding()
        _TOKENIZERS[key] = tok
    return _TOKENIZERS[key]


class _Lengths(dict):
    """Word to token count; a missing word is encoded once and kept."""

    def __init__(self, table: dict[str, int], tokenizer):
        super().__init__(table)
        self._table, self._tokenizer = table, tokenizer

    def __missing__(self, word: str) -> int:
        n = len(self._tokenizer.encode(word, add_special_tokens=False).ids)
        if len(word) <= WORD_CHARS:
            self[word] = n
        return n

    def trim(self) -> None:
        if len(self) > CACHE_WORDS + len(self._table):
            self.clear()
            self.update(self._table)


_CACHES: dict[tuple, _Lengths] = {}


def _lengths(key: tuple, spec: str, table: dict[str, int]) -> _Lengths:
    if key not in _CACHES:
        _CACHES.clear()  # one tokenizer and table at a time
        _CACHES[key] = _Lengths(table, _tokenizer(spec))
    return _CACHES[key]


def count_words(text: str | None, lengths: _Lengths) -> int:
    """Tokens of one whole text; null counts as empty."""
    if not text:
        return 0
    if any(c in text for c in _SEPARATORS):
        return len(lengths._tokenizer.encode(text, add_special_tokens=False).ids)
    return sum(map(lengths.__getitem__, text.split()))


def count_tokens(docs: DataFrame, tokenizer_path: str, limit: int = 2048) -> DataFrame:
    """``docs`` with ``n_bytes``, ``n_tokens`` and ``over_limit`` for the column ``text``.

    The counts are those of ``tokenizers`` for the file at ``tokenizer_path`` on the
    whole text, without added special tokens, truncation or padding; strings of special
    tokens inside a text count as the library has it by default. The file must be one
    whose tokens never hold white space. The file's content is broadcast (its size is
    that of the vocabulary), so executors need no copy. A null text counts as empty;
    columns of these three names are replaced, all others pass through.
    """
    spark = docs.sparkSession
    with open(tokenizer_path, encoding="utf-8") as f:
        spec = f.read()
    tok = _tokenizer(spec)
    words = frequent_words(docs.select("text"))
    counts = [len(e.ids) for e in tok.encode_batch(words, add_special_tokens=False)] if words else []
    shared = spark.sparkContext.broadcast((spec, dict(zip(words, counts))))
    key = (hash(spec), hash(tuple(words)))

    @F.pandas_udf("bigint")
    def n_tokens(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        spec, table = shared.value
        lengths = _lengths(key, spec, table)
        for texts in batches:
            out = []
            for t in texts:
                out.append(count_words(t, lengths))
                lengths.trim()
            yield pd.Series(out, dtype="int64")

    n_bytes = F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint")
    out = docs.withColumn("n_bytes", n_bytes).withColumn("n_tokens", n_tokens("text"))
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
