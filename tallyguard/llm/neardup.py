"""Near-duplicate documents by MinHash with tensored banding.

A document's set of word shingles is min-hashed into two small collections of ``m``
half keys, each made of two minimum hashes. A hash table's key combines one half key of
either collection, so ``m`` squared tables cost the minimum hashes of 2 ``m`` half keys.
Two documents are candidates if they share a key, that is, at least one half key of
either collection; ``m`` is chosen so that a pair at the threshold is missed with a
probability of about 1e-4 at most.

Documents with equal sets form a class and go on as one. Candidates are confirmed on
full sets in three steps, each after merging what the one before has linked: every class
with the table representative it shares most keys with; then with all representatives
of other components; then, in tables that still hold several components, every pair of
members from different components, compared block against block. So a group of copies
costs about as many comparisons as it has members, and no candidate pair between
components is left out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyguard.llm.components import components
from tallyguard.llm.lookup import claim
from tallyguard.llm.order import ROW, numbered
from tallyguard.session import settle

SHINGLE = 5
PERCENT = 80  # links: 100 * intersection >= PERCENT * union
MISS = 1e-4  # probability of missing a pair at the threshold
_ROWS = 2  # minimum hashes per half key
_MEMBERS = 2_000  # comparisons with one representative per task group
_BLOCK = 2_048  # members of a table compared in memory at a time
_SKETCH = 512  # minimum hashes, one byte each, that such comparisons use
_ALPHA = 4.5  # standard deviations a linked pair may fall short of the threshold there
_CACHE_WORDS = 150_000
_SLICE = 256  # rows that a task turns into sets and passes on at a time
_ENOUGH = 0.30  # a pair goes to the exact check unless its estimate is this far below
_U = np.uint64
_M1, _M2 = _U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB)


def _mix(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h ^ (h >> _U(30))) * _M1
        h = (h ^ (h >> _U(27))) * _M2
        return h ^ (h >> _U(31))


def _sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of ``_SLICE`` rows at most: what a task makes of them is sent off in small parts."""
    claim("neardup", _WORDS)
    for batch in batches:
        for lo in range(0, max(batch.num_rows, 1), _SLICE):
            yield batch.slice(lo, _SLICE)


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= _CACHE_WORDS:
            self.clear()
        h = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 64:
            self[word] = h
        return h


_WORDS = _WordHashes()


def shingle_set(text: str | None, k: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the ``k``-word shingles of a whole text.

    A-Z are lower-cased and words are cut at ASCII white space. A text of fewer words
    has one shingle, all of it; without words the set is empty.
    """
    words = text.encode("utf-8").lower().split() if text else []
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(_WORDS.__getitem__, words), np.uint64, n)
    width = min(k, n)
    with np.errstate(over="ignore"):
        out = np.full(n - width + 1, _U(width), np.uint64)
        for i in range(width):
            out = _mix(out * _U(0x9E3779B97F4A7C15) + h[i : n - width + 1 + i])
    return np.unique(out)


def collections(percent: int, miss: float = MISS) -> int:
    """Half keys per collection: the smallest m with 2 (1 - s^rows)^m <= ``miss``."""
    p = (percent / 100) ** _ROWS
    return max(1, math.ceil(math.log(miss / 2) / math.log(1 - p))) if p < 1 else 1


def _multipliers(count: int) -> tuple[np.ndarray, np.ndarray]:
    base = np.arange(1, 2 * count + 1, dtype=np.uint64)
    with np.errstate(over="ignore"):
        mixed = _mix(base * _U(0xD1342543DE82EF95))
    return mixed[:count] | _U(1), mixed[count:]


def min_hashes(shingles: np.ndarray, count: int) -> np.ndarray:
    """``count`` minimum 32-bit hashes of a set."""
    a, b = _multipliers(count)
    low = np.full(count, _U(0xFFFFFFFF))
    with np.errstate(over="ignore"):
        for at in range(0, len(shingles), 1024):
            h = a[:, None] * shingles[None, at : at + 1024]
            h += b[:, None]
            low = np.minimum(low, h.min(1) >> _U(32))
    return low


def _half_keys(low: np.ndarray) -> np.ndarray:
    pairs = low.reshape(-1, _ROWS)
    key = np.arange(1, len(pairs) + 1, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for r in range(_ROWS):
            key = _mix(key * _U(0x9E3779B97F4A7C15) + pairs[:, r])
    return key.view(np.int64)


_SIGNED = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("n", T.LongType()),
        T.StructField("h1", T.LongType()),
        T.StructField("h2", T.LongType()),
        T.StructField("halves", T.ArrayType(T.LongType())),
        T.StructField("low", T.BinaryType()),
    ]
)
_SIGNED_ARROW = pa.schema(
    [("doc_id", pa.int64()), ("n", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64()), ("halves", pa.list_(pa.int64())), ("low", pa.binary())]
)


def _signatures(docs: DataFrame, k: int, m: int) -> DataFrame:
    """doc_id, n (set size), h1, h2 (set identity), halves (2 m half keys), low (hashes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _sliced(batches):
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                s = shingle_set(text.as_py(), k)
                if not len(s):
                    rows.append((doc_id, 0, 0, 0, None, None))
                    continue
                low = min_hashes(s, 2 * m * _ROWS)
                with np.errstate(over="ignore"):
                    h1, h2 = _mix(s + _U(1)).sum(dtype=np.uint64), _mix(s ^ _M2).sum(dtype=np.uint64)
                ids = np.array([h1, h2], np.uint64).view(np.int64).tolist()
                rows.append((doc_id, len(s), *ids, _half_keys(low).tolist(), low.astype("<u2").tobytes()))
            columns = list(zip(*rows)) if rows else [[]] * len(_SIGNED_ARROW)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, _SIGNED_ARROW)], schema=_SIGNED_ARROW)

    return docs.select("doc_id", "text").mapInArrow(run, _SIGNED)


def _members(classes: DataFrame, m: int) -> DataFrame:
    """(key, table, id, rep) of every table key that at least two classes share; rep is the smallest."""
    halves = classes.select("id", F.posexplode("halves").alias("at", "half"))
    shared = halves.groupBy("half").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("half")
    own = halves.join(shared, "half", "left_semi").groupBy("id").agg(F.collect_list(F.struct("at", "half")).alias("hs"))
    first, second = F.filter("hs", lambda h: h["at"] < m), F.filter("hs", lambda h: h["at"] >= m)
    table = lambda a, b: (a["at"] * m + b["at"] - m).alias("table")
    keys = F.flatten(
        F.transform(first, lambda a: F.transform(second, lambda b: F.struct(table(a, b), F.xxhash64(a["half"], b["half"]).alias("key"))))
    )
    rows = settle(own.select("id", F.explode(keys).alias("k")).select("id", "k.table", "k.key"), "near-keys")
    several = rows.groupBy("key").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("c")).where("c > 1").select("key", "rep")
    return settle(rows.join(several, "key"), "near-members")


def _plausible(pairs: DataFrame, classes: DataFrame, percent: int, count: int) -> DataFrame:
    """Pairs (id, rep) whose set sizes and minimum hashes do not rule a link out."""
    a = classes.select(F.col("id"), F.col("n").alias("n_a"), F.col("low").alias("low_a"))
    b = classes.select(F.col("id").alias("rep"), F.col("n").alias("n_b"), F.col("low").alias("low_b"))
    rows = pairs.join(a, "id").join(b, "rep")
    rows = rows.where(F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent)
    need = _needed(percent, count)
    equal = sum(
        (F.substring("low_a", 2 * j + 1, 2) == F.substring("low_b", 2 * j + 1, 2)).cast("int") for j in range(count)
    )
    return rows.where(equal >= need).select("id", "rep")


def _needed(percent: int, count: int) -> int:
    """Equal minimum hashes that a linked pair has but for a chance of about 1e-6."""
    return max(1, int(count * (percent / 100 - _ENOUGH)))


def _confirm(pairs: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (id, rep) linked on their full sets, written to the shared folder.

    Texts of both sides are fetched by one join on the ids concerned, turned into sets
    and dealt out by representative; a representative with many partners is repeated
    for every ``_MEMBERS`` of them.
    """
    spark = docs.sparkSession
    pairs = settle(pairs.where("id != rep").distinct(), "near-pairs")
    parts = pairs.groupBy("rep").agg(F.ceil(F.count(F.lit(1)) / _MEMBERS).alias("parts"))
    dealt = pairs.join(parts, "rep").select("id", "rep", F.pmod(F.xxhash64("id"), "parts").alias("part"))
    own = parts.select(F.col("rep").alias("id"), "rep", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)).alias("part"))
    wanted = settle(dealt.unionByName(own), "near-wanted")
    wanted = wanted.where("part >= 0")  # a condition that lets the runtime filter apply
    texts = docs.join(wanted, docs["doc_id"] == wanted["id"]).select("rep", "part", "id", "text")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _sliced(batches):
            found = pa.array([shingle_set(t.as_py(), k).tobytes() for t in batch.column("text")], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("rep"), batch.column("part"), batch.column("id"), found], names=["rep", "part", "id", "set"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, centres = None, []
        for batch in batches:
            ids, reps = [], []
            for rep, part, i, packed in zip(*(batch.column(n) for n in ("rep", "part", "id", "set"))):
                rep, i, s = rep.as_py(), i.as_py(), np.frombuffer(packed.as_py(), np.uint64)
                if (rep, part.as_py()) != group:
                    group, centres = (rep, part.as_py()), []
                if i == rep:
                    centres.append(s)
                elif any(_linked(s, c, percent) for c in centres):
                    ids.append(i)
                    reps.append(rep)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(reps, pa.int64())], names=["id", "rep"])

    kind = T.StructType([T.StructField(n, T.LongType()) for n in ("rep", "part", "id")] + [T.StructField("set", T.BinaryType())])
    grouped = texts.mapInArrow(sets, kind).repartition("rep", "part").sortWithinPartitions("rep", "part", F.col("id") != F.col("rep"))
    linked = grouped.mapInArrow(compare, "id bigint, rep bigint")
    with _runtime_filter(spark):
        return settle(linked, "near-links")


class _runtime_filter:
    """Lets the planner drop texts that no pair asks for before they are shuffled."""

    _NAME = "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold"

    def __init__(self, spark):
        self._conf = spark.conf

    def __enter__(self):
        self._before = self._conf.get(self._NAME, None)
        self._conf.set(self._NAME, "1MB")

    def __exit__(self, *_):
        self._conf.unset(self._NAME) if self._before is None else self._conf.set(self._NAME, self._before)


def _linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def _relabel(labels: DataFrame | None, links: DataFrame) -> DataFrame:
    """Labels (id, label) after adding links; ids without links have no row."""
    if labels is not None and links.isEmpty():
        return labels
    if labels is None:
        return settle(components(links, "id", "rep"), "near-labels")
    at = lambda c: F.coalesce(F.col(f"{c}_label"), F.col(c))
    named = links.join(labels.select(F.col("id"), F.col("label").alias("id_label")), "id", "left").join(
        labels.select(F.col("id").alias("rep"), F.col("label").alias("rep_label")), "rep", "left"
    )
    merged = components(named.select(at("id").alias("id"), at("rep").alias("rep")), "id", "rep").select(
        F.col("id").alias("label"), F.col("label").alias("root")
    )
    old = labels.join(merged, "label", "left").select("id", F.coalesce("root", "label").alias("label"))
    new = merged.select(F.col("label").alias("id"), F.col("root").alias("label")).join(labels.select("id"), "id", "left_anti")
    return settle(old.unionByName(new), "near-labels")


def _with_label(rows: DataFrame, labels: DataFrame, column: str) -> DataFrame:
    named = labels.select(F.col("id").alias(column), F.col("label").alias("__l"))
    return rows.join(named, column, "left").withColumn(f"{column}_label", F.coalesce("__l", column)).drop("__l")


def _sketches(ids: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """(id, sketch): the low bytes of ``_SKETCH`` minimum hashes, for the documents ``ids``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _sliced(batches):
            found = [min_hashes(shingle_set(t.as_py(), k), _SKETCH).astype(np.uint8).tobytes() for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(found, pa.binary())], names=["id", "sketch"])

    wanted = settle(ids.distinct(), "near-mixed").where("id IS NOT NULL AND id = id")
    texts = docs.join(wanted, docs["doc_id"] == wanted["id"]).select("id", "text")
    with _runtime_filter(docs.sparkSession):
        return settle(texts.mapInArrow(run, "id bigint, sketch binary"), "near-sketches")


def _across(members: DataFrame, labels: DataFrame, classes: DataFrame, docs: DataFrame, k: int, percent: int, m: int) -> DataFrame:
    """Plausible pairs (id, rep) of different components that share a table, each pair once.

    Members of a table are cut into blocks of about ``_BLOCK``; a task compares two
    blocks in memory. A pair is looked at in the first table that it shares only, and
    passed on if set sizes and a long sketch allow a link.
    """
    rows = _with_label(members.select("key", "table", "id"), labels, "id")
    mixed = rows.groupBy("key").agg(
        F.min("id_label").alias("lo"), F.max("id_label").alias("hi"), F.ceil(F.count(F.lit(1)) / _BLOCK).alias("blocks")
    )
    rows = settle(rows.join(mixed.where("lo != hi").select("key", "blocks"), "key"), "near-across")
    sketches = _sketches(rows.select("id"), docs, k)
    rows = rows.join(classes.select("id", "n", "halves").join(sketches, "id"), "id")
    block = F.pmod(F.xxhash64("id"), "blocks")
    other = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1))
    rows = rows.withColumn("block", block).withColumn("other", other)
    rows = rows.withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other"))
    dealt = rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    share = percent / 100
    need = int(_SKETCH * (share - _ALPHA * math.sqrt(share * (1 - share) / _SKETCH)))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held, out = None, [], []

        def close():
            ids, label, n, block = (np.array([h[c] for h in held], np.int64) for c in range(4))
            if label.min() == label.max():
                return
            table = held[0][4]
            halves = np.array([h[5] for h in held], np.int64)
            sketch = np.frombuffer(b"".join(h[6] for h in held), np.uint8).reshape(len(held), -1)
            for x in range(len(held) - 1):
                ok = (label[x + 1 :] != label[x]) & (ids[x + 1 :] != ids[x])
                if group[1] != group[2]:
                    ok &= block[x + 1 :] != block[x]
                small, big = np.minimum(n[x + 1 :], n[x]), np.maximum(n[x + 1 :], n[x])
                at = np.flatnonzero(ok & (small * 100 >= big * percent)) + x + 1
                if not len(at):
                    continue
                same = halves[at] == halves[x]
                at = at[same[:, :m].argmax(1) * m + same[:, m:].argmax(1) == table]
                at = at[(sketch[at] == sketch[x]).sum(1) >= need] if len(at) else at
                out.extend((max(int(ids[x]), int(ids[y])), min(int(ids[x]), int(ids[y]))) for y in at)

        def flush():
            return pa.RecordBatch.from_arrays([pa.array([o[c] for o in out], pa.int64()) for c in (0, 1)], names=["id", "rep"])

        for batch in _sliced(batches):
            columns = [batch.column(c).to_pylist() for c in ("key", "i", "j", "id", "id_label", "n", "block", "table", "halves", "sketch")]
            for key, i, j, *row in zip(*columns):
                if (key, i, j) != group:
                    if held:
                        close()
                    group, held = (key, i, j), []
                    if len(out) > 10_000:
                        yield flush()
                        out = []
                held.append(row)
        if held:
            close()
        yield flush()

    return dealt.mapInArrow(compare, "id bigint, rep bigint")


def near_duplicates(docs: DataFrame, k: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row per row of ``docs`` (doc_id, text).

    Texts are linked if 100 * intersection >= ``percent`` * union of their sets of
    ``k``-word shingles; component_id is the smallest doc_id reachable over links, and
    kept marks doc_id = component_id. Texts without words (null, empty, white space)
    are linked with nothing. Rows of equal doc_id are one document: what one is linked
    with, all are. Rows without doc_id take no part: their component_id and kept are
    null. Other columns are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    m = collections(percent)
    count = 2 * m * _ROWS
    signed = settle(_signatures(docs, k, m), "near-signed")
    known = signed.where("n > 0 AND doc_id IS NOT NULL")
    classes = known.groupBy("h1", "h2", "n").agg(
        F.min("doc_id").alias("id"), F.first("halves").alias("halves"), F.first("low").alias("low")
    )
    classes = settle(classes, "near-classes")
    members = _members(classes, m)
    stars = members.where("id != rep").groupBy("id", "rep").agg(F.count(F.lit(1)).alias("c"))
    stars = settle(stars, "near-stars")
    best = stars.groupBy("id").agg(F.max(F.struct("c", (-F.col("rep")).alias("r"))).alias("b")).select("id", (-F.col("b.r")).alias("rep"))
    labels = _relabel(None, _confirm(_plausible(best, classes, percent, count), docs, k, percent))
    apart = _with_label(_with_label(stars.select("id", "rep"), labels, "id"), labels, "rep").where("id_label != rep_label")
    labels = _relabel(labels, _confirm(_plausible(apart.select("id", "rep"), classes, percent, count), docs, k, percent))
    labels = _relabel(labels, _confirm(_across(members, labels, classes, docs, k, percent, m), docs, k, percent))
    by_class = classes.select("h1", "h2", F.col("n").alias("cn"), "id")
    rows = signed.select("doc_id", "n", "h1", "h2")
    hit = (rows["h1"] == by_class["h1"]) & (rows["h2"] == by_class["h2"]) & (rows["n"] == by_class["cn"])
    rows = settle(rows.join(by_class, hit, "left").select("doc_id", "n", "id"), "near-rows")
    both = rows.where("doc_id IS NOT NULL AND id IS NOT NULL").select("doc_id", "id").distinct()
    several = both.groupBy("doc_id").agg(F.min("id").alias("rep"), F.max("id").alias("hi")).where("rep != hi")
    labels = _relabel(labels, settle(both.join(several, "doc_id").select("id", "rep"), "near-same"))
    rows = rows.join(labels, "id", "left").select("doc_id", "n", F.coalesce("label", "id", "doc_id").alias("c"))
    rows = rows.withColumn("c", F.when(F.col("doc_id").isNotNull(), F.col("c")))
    return rows.select(
        "doc_id", F.col("n").alias("n_shingles"), F.col("c").alias("component_id"), (F.col("doc_id") == F.col("c")).alias("kept")
    )


def drop_near_copies(docs: DataFrame, k: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """Pipeline stage form: one document of each group stays, all columns kept.

    Where doc_id is unique and never null it names the rows, and the smallest stays;
    else rows are numbered first and the row read first stays.
    """
    twice = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("c")).where("c > 1 OR doc_id IS NULL").limit(1).count()
    rows = numbered(docs, "near-docs") if twice else docs.withColumn(ROW, F.col("doc_id"))
    found = near_duplicates(rows.select(F.col(ROW).alias("doc_id"), "text"), k, percent)
    gone = settle(found.where("NOT kept").select(F.col("doc_id").alias(ROW)), "near-gone")
    return rows.join(gone, ROW, "left_anti").select(*docs.columns)
