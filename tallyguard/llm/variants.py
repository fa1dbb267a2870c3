"""Spelling variants: words one edit apart, found by a relational trie frontier.

The trie of all words is a distributed edge table (node, letter, child); a node is the
hash of its prefix. States (word, target, depth, node) walk it: an unedited state of a word
meets the children of its node once per depth and leaves them with one edit, and edited
states are then joined with the edge table level by level until they end on a word. An
edge also says which letters follow, and where only one word is left below, the hash of
its rest, so most states end after one or two joins.

Two words one edit apart share their first or their last half. Edits in the second half
are looked for in the trie of the words, edits in the first half in the trie of the words
read backwards; both are one table. So no state meets the crowded nodes near the root.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyguard.session import settle

LETTERS = "A-Za-zÀ-ÿ"
MIN_CHARS = 7
MIN_COUNT = 2
RATIO = 10  # a form occurs at least so many times as often
DAMAGE = 31  # one in so many runs loses a letter
TRIE_CHARS = 64  # longer words are compared by rolling hashes, with the same result
_BITS = 63  # letters are marked in one BIGINT by their code modulo this


def word_counts(docs: DataFrame, min_chars: int = MIN_CHARS, min_count: int = MIN_COUNT, damage: int = DAMAGE) -> DataFrame:
    """(word, n): words of ``docs`` (doc_id, text) with ``min_count`` occurrences or more.

    A word is a maximal run of letters with A-Z in lower case. Where ``damage`` divides the
    CRC-32 of ``<doc_id>:<run>`` the run loses one letter, as by a typing error. Words are
    at least ``min_chars`` code points long. Null texts have no words, a null doc_id is the
    empty string. Occurrences are summed map-side before the shuffle by word.
    """
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    runs = docs.select(
        F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("d"),
        F.explode(F.regexp_extract_all(lower, F.lit(f"([{LETTERS}]{{{min_chars},}})"), 1)).alias("run"),
    )
    h = F.crc32(F.concat("d", F.lit(":"), "run"))
    runs = runs.select("run", h.alias("h"))
    at = (F.col("h") % F.length("run")).cast("int")
    cut = F.concat(F.col("run").substr(F.lit(1), at), F.col("run").substr(at + 2, F.length("run")))
    word = F.when(F.col("h") % damage == 0, cut).otherwise(F.col("run")).alias("word")
    counted = runs.select(word).where(F.length("word") >= min_chars).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counted.where(F.col("n") >= min_count)


# --- trie -------------------------------------------------------------------------
def _node(prefix) -> Column:
    return F.xxhash64("side", prefix)


def _head(text: str, chars) -> Column:
    return F.substring(F.col(text), F.lit(1), chars)


def _letter(text: str, at) -> Column:
    """The letter of ``text`` at 0-based ``at``; the empty string behind its end."""
    return F.substring(F.col(text), at + 1, F.lit(1))


def _rest(text: str, at) -> Column:
    return F.substring(F.col(text), at + 1, F.length(text))


def _sides(words: DataFrame) -> DataFrame:
    """Every word forwards (side 0) and backwards (side 1), with its length."""
    sides = F.array(
        F.struct(F.lit(0).alias("side"), F.col("word").alias("w")), F.struct(F.lit(1).alias("side"), F.reverse("word").alias("w"))
    )
    return words.select(F.explode(sides).alias("x")).select("x.side", "x.w", F.length("x.w").alias("len"))


def _edges(sides: DataFrame, shallow: int) -> DataFrame:
    """(node, letter, child, below, ends, rest, mask): children of nodes at depth ``shallow`` or more.

    ``below`` counts the words through the child, ``ends`` tells whether it is a word,
    ``rest`` is the hash of what follows (of use where one word is left) and ``mask`` has a
    bit for every letter that follows.
    """
    at = F.col("at")
    steps = sides.where(F.col("len") > shallow).withColumn("at", F.explode(F.sequence(F.lit(shallow), F.col("len") - 1)))
    bit = F.expr(f"shiftleft(1L, ascii(substring(w, at + 2, 1)) % {_BITS})")
    last = at + 1 == F.col("len")
    rows = steps.select(
        _node(_head("w", at)).alias("node"),
        _letter("w", at).alias("letter"),
        _node(_head("w", at + 1)).alias("child"),
        last.alias("last"),
        F.xxhash64(_rest("w", at + 1)).alias("rest"),
        F.when(last, F.lit(0).cast("bigint")).otherwise(bit).alias("mask"),
    )
    return rows.groupBy("node", "letter", "child").agg(
        F.count(F.lit(1)).alias("below"), F.max("last").alias("ends"), F.min("rest").alias("rest"), F.bit_or("mask").alias("mask")
    )


def _judge(met: DataFrame) -> DataFrame:
    """States (side, w, t, depth, node) after a step to a child; ``done`` where the target is
    a word (but for a hash). States that cannot end on a word are dropped."""
    end, alone = F.col("depth") == F.length("t"), F.col("below") == 1
    done = F.when(end, F.col("ends")).when(alone, F.col("rest") == F.xxhash64(_rest("t", F.col("depth")))).otherwise(False)
    bit = F.expr(f"shiftright(mask, ascii(substring(t, depth + 1, 1)) % {_BITS}) & 1L = 1L")
    met = met.withColumn("done", done).where(F.col("done") | (~end & ~alone & bit))
    return met.select("side", "w", "t", "depth", F.col("child").alias("node"), "done")


def _first_step(sides: DataFrame, edges: DataFrame) -> DataFrame:
    """Unedited states at every depth of the second half meet the children of their node."""
    half = F.floor(F.col("len") / 2).cast("int")
    start = F.when(F.col("side") == 0, half).otherwise(F.col("len") - half)
    d, length, letter = F.col("d"), F.col("len"), F.col("letter")
    states = sides.withColumn("d", F.explode(F.sequence(start, length)))
    met = states.withColumn("node", _node(_head("w", d))).join(edges, "node")
    here, following, head = _letter("w", d), _letter("w", d + 1), _head("w", d)
    targets = F.array(
        F.when((d < length) & (letter != here), F.concat(head, letter, _rest("w", d + 1))),  # replaced
        F.when(letter != here, F.concat(head, letter, _rest("w", d))),  # inserted, or added at the end
        F.when((letter == following) & (here != following), F.concat(head, _rest("w", d + 1))),  # deleted
    )
    met = met.withColumn("t", F.explode(F.array_compact(targets))).withColumn("depth", d + 1)
    return _judge(met)


def _trie_neighbours(words: DataFrame, shortest: int) -> DataFrame:
    """(word, near) candidates among ``words`` of ``shortest`` code points or more; a few may be no words."""
    sides = _sides(words)
    edges = settle(_edges(sides, shortest // 2), "trie-edges")
    states = settle(_first_step(sides, edges), "trie-level")
    ended = [states.where("done").select("side", "w", "t")]
    while True:
        states = states.where("not done").drop("done")
        if states.isEmpty():
            break
        step = states.withColumn("letter", _letter("t", F.col("depth"))).withColumn("depth", F.col("depth") + 1)
        states = settle(_judge(step.join(edges, ["node", "letter"])), "trie-level")
        ended.append(states.where("done").select("side", "w", "t"))
    last_cut = sides.select("side", "w", F.expr("substring(w, 1, len - 1)").alias("t"))  # the last letter deleted
    found = last_cut
    for e in ended:
        found = found.unionByName(e)
    back = lambda c: F.when(F.col("side") == 0, F.col(c)).otherwise(F.reverse(c))
    return found.select(back("w").alias("word"), back("t").alias("near"))


# --- long words -------------------------------------------------------------------
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


def variant_hashes(word: str) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the word without its i-th letter, for all i, and of the whole word (one value)."""
    codes = np.frombuffer(word.encode("utf-32-le"), "<u4").astype(np.uint64) + np.uint64(1)
    with np.errstate(over="ignore"):
        powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(len(codes) - 1, _BASE)]))
        sums = np.concatenate([[np.uint64(0)], np.cumsum(codes * powers)])
        cut = sums[:-1] + (sums[-1] - sums[1:]) * _INVERSE
    return cut.view(np.int64), sums[-1:].view(np.int64)


def _hash_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for key, word in zip(batch.column("id").to_pylist(), batch.column("word").to_pylist()):
            cut, whole = variant_hashes(word)
            once = np.unique(cut)
            # at -2: the word itself, -1: its variants once each, from 0: its variants by place
            at = np.concatenate([[-2], np.full(len(once), -1), np.arange(len(cut))])
            hashes = np.concatenate([whole, once, cut])
            rows = pa.array(np.full(len(at), key)), pa.array(at, pa.int64()), pa.array(hashes), pa.array(np.full(len(at), len(word)))
            yield pa.RecordBatch.from_arrays(list(rows), names=["id", "at", "h", "len"])


def _long_neighbours(words: DataFrame) -> DataFrame:
    """(word, near) candidates among long words by hashes of their one-letter deletions.

    Words that differ in one letter have the same hash without it, at the same place; a word
    with one letter more has a deletion with the other word's hash. A word gives as many
    rows as twice its letters; only words with near words meet.
    """
    words = settle(words.select("word").withColumn("id", F.monotonically_increasing_id()), "long-words")
    rows = settle(words.mapInArrow(_hash_rows, "id bigint, at bigint, h bigint, len bigint"), "long-hashes")
    a, b = rows.where("at >= 0").alias("a"), rows.where("at >= 0").alias("b")
    replaced = a.join(b, F.expr("a.at = b.at AND a.h = b.h AND a.len = b.len AND a.id < b.id"))
    a, b = rows.where("at = -1").alias("a"), rows.where("at = -2").alias("b")
    shorter = a.join(b, F.expr("a.h = b.h AND a.len = b.len + 1"))
    pairs = replaced.select("a.id", F.col("b.id").alias("other")).unionByName(shorter.select("a.id", F.col("b.id").alias("other")))
    pairs = pairs.distinct().join(words, "id")
    pairs = pairs.join(words.select(F.col("id").alias("other"), F.col("word").alias("near")), "other")
    pairs = pairs.where(F.levenshtein("word", "near", 1) == 1).select("word", "near")
    return pairs.unionByName(pairs.select(F.col("near").alias("word"), F.col("word").alias("near")))


def near_words(words: DataFrame, trie_chars: int = TRIE_CHARS) -> DataFrame:
    """(word, near, near_n): ordered pairs of ``words`` (word, n; read from files) that differ by
    exactly one inserted, deleted or replaced code point.

    Words of up to ``trie_chars`` code points go through the trie. Pairs with a longer word
    come from hashes of one-letter deletions, so a very long word costs one row per letter
    and not one prefix. Both are exact: the pairs found are joined with the words themselves.
    """
    least, most = words.agg(F.min(F.length("word")), F.max(F.length("word"))).first()
    empty = words.select("word", F.col("word").alias("near")).limit(0)
    found = empty
    if least is not None and least <= trie_chars:
        found = _trie_neighbours(words.where(F.length("word") <= trie_chars), least)
    if most is not None and most > trie_chars:
        longer = _long_neighbours(words.where(F.length("word") >= trie_chars))
        found = found.unionByName(longer.where(F.greatest(F.length("word"), F.length("near")) > trie_chars))
    targets = words.select(F.col("word").alias("near"), F.col("n").alias("near_n"))
    return found.join(targets, "near").select("word", "near", "near_n").distinct()


def group_variants(words: DataFrame, ratio: int = RATIO, trie_chars: int = TRIE_CHARS) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for ``words`` (word, n; read from files; each word once).

    ``form`` is the near word of largest n (ties: the first in code point order), if that n
    is at least ``ratio`` times the word's; ``root`` is where following forms ends, and the
    word itself without a form. As n grows with every step (for ``ratio`` above 1), the
    number of rounds is at most the logarithm of the largest n.
    """
    if ratio <= 1:
        raise ValueError("ratio must be above 1")
    near = near_words(words, trie_chars)
    best = near.groupBy("word").agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("k"), F.col("near").alias("v"))).alias("b")
    )
    rows = words.join(best, "word", "left")
    good = -F.col("b.k") >= F.col("n") * ratio
    rows = rows.select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("bigint")).alias("n_near"),
        F.when(good, F.col("b.v")).alias("form"), F.when(good, -F.col("b.k")).alias("form_n"),
    )
    rows = settle(rows, "variant-forms")
    step = rows.where("form IS NOT NULL").select(F.col("word").alias("_from"), F.col("form").alias("_to"))
    roots = step.select(F.col("_from").alias("word"), F.col("_to").alias("root"))
    while True:
        moved = roots.join(step, F.col("root") == F.col("_from"), "left")
        roots = settle(moved.select("word", F.coalesce("_to", "root").alias("root"), F.col("_to").isNotNull().alias("_moved")), "variant-roots")
        if roots.where("_moved").isEmpty():
            break
        roots = roots.drop("_moved")
    out = rows.join(roots.drop("_moved"), "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def variant_groups(docs: DataFrame, **options) -> DataFrame:
    """Words of ``docs`` (doc_id, text) with the forms they are variants of; other columns are not read."""
    return group_variants(settle(word_counts(docs.select("doc_id", "text"), **options), "variant-words"))
