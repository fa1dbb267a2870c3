"""Packing documents into sequences by shortest-pack-first over the length histogram.

Documents are cut into full pieces of the sequence length and one remainder. Packing needs
only how many pieces there are of each length: lengths are placed longest first, each time
into the pack with the most room, and packs that hold the same lengths are one pattern with
a count. Patterns are then joined back to pieces by rank: the r-th piece of a length takes
the r-th place that the patterns have for that length.
"""

from __future__ import annotations

import hashlib
import heapq
import os
import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyguard.llm.lookup import Slots, spread
from tallyguard.llm.order import positioned
from tallyguard.session import settle

CAPACITY = 4096
END = 2  # id put after every document
BATCH_CHARS = 8_000_000  # characters encoded together
CACHE_WORDS = 900_000  # words a worker keeps before it starts afresh
WORD_CHARS = 64  # longer words are encoded on their own
_JOINED = 2_000  # words encoded in one call
# the four that str.split() takes as white space and the tokenizer keeps as text
_SEPARATORS = re.compile("[\x1c-\x1f]")
# words of these letters, with at most one mark behind, are one or two pre-tokens
_SIMPLE = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,;:!?]?)")


# --- ids --------------------------------------------------------------------------
class _Ids:
    """Id sequences one after the other, by slot."""

    def __init__(self):
        self.flat, self.starts, self.counts = np.empty(0, np.uint32), np.empty(0, np.int64), np.empty(0, np.int64)

    def add(self, ids: np.ndarray, counts: np.ndarray) -> None:
        self.starts = np.concatenate([self.starts, len(self.flat) + np.cumsum(counts) - counts])
        self.flat, self.counts = np.concatenate([self.flat, ids]), np.concatenate([self.counts, counts])

    def stream(self, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the slots in order, and how many each has."""
        counts = self.counts[slots]
        return self.flat[spread(self.starts[slots], counts)], counts


class WordEncoder:
    """Ids of texts by a tokenizer that drops white space and marks word ends.

    Words met before are looked up; new ones are encoded together. Words that differ only
    in letter case or in a mark behind share the ids of their letters.
    """

    def __init__(self, spec: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._tok = Tokenizer.from_str(spec)
        self._tok.no_truncation()
        self._tok.no_padding()
        size = self._tok.get_vocab_size(True)
        self._ends = np.array([(self._tok.id_to_token(i) or "").endswith("</w>") for i in range(size)])
        self._lowers = self.whole("A").tolist() == self.whole("a").tolist()
        self._reset()

    def _reset(self) -> None:
        self._words, self._word_ids = Slots(), _Ids()
        self._cores, self._core_ids, self._chars = Slots(), _Ids(), 0

    def whole(self, text: str) -> np.ndarray:
        return self._encode([text])[0]

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self._tok.encode_batch_fast(texts, add_special_tokens=False)]

    def texts(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of whole texts."""
        if len(self._words) > CACHE_WORDS or self._chars > CACHE_WORDS * WORD_CHARS:
            self._reset()
        split = [None if _SEPARATORS.search(t) else t.split() for t in texts]
        sizes = [len(s) for s in split if s]
        words = chain.from_iterable(s for s in split if s)
        at = np.fromiter(map(self._words.__getitem__, words), np.int64, sum(sizes))
        self._learn(self._words.taken())
        ids, counts = self._word_ids.stream(at)
        ends, out, lo = np.concatenate([[0], np.cumsum(counts)]), [], 0
        for text, words in zip(texts, split):
            if words is None:
                out.append(self.whole(text))
            else:
                out.append(ids[ends[lo] : ends[lo + len(words)]])
                lo += len(words)
        return out

    def _learn(self, words: list[str]) -> None:
        parts, other = [], []
        for w in words:
            if w.isascii() and w.isalpha() and len(w) <= WORD_CHARS:  # most words; the pattern takes the rest
                parts.append((self._cores[w.lower() if self._lowers else w], -1))
                continue
            m = _SIMPLE.fullmatch(w) if len(w) <= WORD_CHARS else None
            if m:
                core, mark = m.groups()
                parts.append((self._cores[core.lower() if self._lowers else core], self._cores[mark] if mark else -1))
            else:
                parts.append(None)
                other.append(w)
        self._learn_cores(self._cores.taken())
        single = self._encode(other)
        # the words' ids come from two streams: letters with their marks, and words on their own
        slots = np.array([s for p in parts if p for s in p if s >= 0], np.int64)
        ids, counts = self._core_ids.stream(slots)
        marked = np.array([p[1] >= 0 for p in parts if p], bool)
        first = np.cumsum(np.concatenate([[0], 1 + marked[:-1]])) if len(marked) else np.empty(0, np.int64)
        sums = np.add.reduceat(counts, first) if len(marked) else np.empty(0, np.int64)
        lengths, simple = np.zeros(len(words), np.int64), np.array([p is not None for p in parts], bool)
        lengths[simple], lengths[~simple] = sums, [len(x) for x in single]
        out, starts = np.empty(int(lengths.sum()), np.uint32), np.cumsum(lengths) - lengths
        out[spread(starts[simple], lengths[simple])] = ids
        if single:
            out[spread(starts[~simple], lengths[~simple])] = np.concatenate(single)
        self._word_ids.add(out, lengths)
        self._chars += sum(map(len, words))

    def _learn_cores(self, cores: list[str]) -> None:
        """Each core is one pre-token, so it has one id that ends a word, its last."""
        parts = [cores[lo : lo + _JOINED] for lo in range(0, len(cores), _JOINED)]
        for part, ids in zip(parts, self._encode([" ".join(p) for p in parts])):
            ends = np.flatnonzero(self._ends[ids]) + 1
            if len(ends) == len(part) and ends[-1] == len(ids):
                self._core_ids.add(ids, np.diff(ends, prepend=0))
            else:
                lists = self._encode(part)
                self._core_ids.add(np.concatenate(lists), np.array([len(x) for x in lists], np.int64))


_ENCODERS: dict[str, WordEncoder] = {}


def _encoder(spec: str) -> WordEncoder:
    key = hashlib.sha256(spec.encode()).hexdigest()
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = WordEncoder(spec)
    return _ENCODERS[key]


_PIECES = "start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint"


def _cut(shared, end: int, capacity: int):
    def parts(batches):
        for batch in batches:
            texts, lo, chars = batch.column("text").to_pylist(), 0, 0
            for i, t in enumerate(texts):
                if chars and chars + len(t or "") > BATCH_CHARS:
                    yield batch, texts, lo, i
                    lo, chars = i, 0
                chars += len(t or "")
            if lo < len(texts):
                yield batch, texts, lo, len(texts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shared.value)
        for batch, texts, lo, hi in parts(batches):
            rows, start, length, crc, total = [], [], [], [], []
            for i, ids in enumerate(encoder.texts([t or "" for t in texts[lo:hi]]), lo):
                data = np.append(ids, np.uint32(end)).astype("<u4").tobytes()
                n = len(ids) + 1
                for at in range(0, n, capacity):
                    stop = min(n, at + capacity)
                    rows.append(i)
                    start.append(at)
                    length.append(stop - at)
                    crc.append(zlib.crc32(data[4 * at : 4 * stop]))
                    total.append(n)
            kept = batch.select(["_row"]).take(pa.array(rows, pa.int64()))
            made = [pa.array(v, pa.int64()) for v in (start, length, crc, total)]
            yield pa.RecordBatch.from_arrays([kept.column("_row"), *made], names=["_row", "start", "length", "ids_crc32", "doc_tokens"])

    return run


def cut_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """One row per piece: the columns of ``docs`` but ``text``, then start, length, ids_crc32, doc_tokens.

    A document is the tokenizer's ids of its whole text (null: empty) and ``end``; a piece is
    ``capacity`` of them or what is left. The file's content is broadcast. It must be a
    tokenizer that drops white space and marks word ends with ``</w>``; strings of special
    tokens inside texts count as the library has it by default.
    """
    spark = docs.sparkSession
    with open(tokenizer_path, encoding="utf-8") as f:
        shared = spark.sparkContext.broadcast(f.read())
    made = [c.split()[0] for c in _PIECES.split(", ")]
    kept = [c for c in docs.columns if c not in ("text", *made)]
    row = F.struct(F.lit(True).alias("_"), *[F.col(c) for c in kept]).alias("_row")
    rows = docs.select(row, "text")
    pieces = rows.mapInArrow(_cut(shared, end, capacity), f"_row {rows.schema['_row'].dataType.simpleString()}, {_PIECES}")
    return pieces.select(*[F.col("_row").getField(c).alias(c) for c in kept], *made)


# --- patterns ---------------------------------------------------------------------
def shortest_pack_first(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, list[int]]]:
    """(count, lengths) of the packs; ``histogram`` has the number of pieces per length.

    Lengths go longest first, each to the packs with the most room; where no pack has room,
    new packs are opened. Equal packs are handled together, so the work depends on the
    number of lengths and not on the number of pieces.
    """
    by_room: dict[int, list[tuple[int, tuple]]] = {}
    rooms: list[int] = []  # heap of -room

    def put(room: int, count: int, pack: tuple) -> None:
        if room not in by_room:
            by_room[room] = []
            heapq.heappush(rooms, -room)
        by_room[room].append((count, pack))

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        if not 0 < length <= capacity:
            raise ValueError(f"a piece of {length} does not fit a pack of {capacity}")
        while left:
            while rooms and not by_room[-rooms[0]]:
                del by_room[-heapq.heappop(rooms)]
            room = -rooms[0] if rooms else 0
            if room < length:
                put(capacity - length, left, (length, None))
                break
            count, pack = by_room[room].pop()
            used = min(count, left)
            if count > used:
                by_room[room].append((count - used, pack))
            put(room - length, used, (length, pack))
            left -= used
    out = []
    for room in sorted(by_room):
        for count, pack in by_room[room]:
            lengths = []
            while pack:
                lengths.append(pack[0])
                pack = pack[1]
            out.append((count, lengths[::-1]))
    return out


def places(packs: list[tuple[int, list[int]]]) -> np.ndarray:
    """Rows (length, first rank, first sequence, offset): where the ranks of a length go.

    Piece ``first rank + k`` of a length goes to sequence ``first sequence + k`` at ``offset``.
    """
    rows, taken, sequence = [], {}, 0
    for count, lengths in packs:
        offset = 0
        for length in lengths:
            rank = taken.get(length, 0)
            rows.append((length, rank, sequence, offset))
            taken[length] = rank + count
            offset += length
        sequence += count
    return np.array(sorted(rows), np.int64).reshape(-1, 4)


def _place(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, first, width = shared.value
        key = table[:, 0] * width + table[:, 1]
        for batch in batches:
            length, at = (batch.column(c).to_numpy().astype(np.int64) for c in ("length", "_at"))
            rank = at - first[length]
            row = table[np.searchsorted(key, length * width + rank, side="right") - 1]
            names = [c for c in batch.schema.names if c != "_at"]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in names], pa.array(row[:, 2] + rank - row[:, 1]), pa.array(row[:, 3])],
                names=[*names, "sequence_id", "offset"],
            )

    return run


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` (length and any others, narrow, read from files) with ``sequence_id`` and ``offset``.

    The histogram has at most ``capacity`` rows and is packed on the driver; its patterns are
    a table whose size depends on ``capacity`` alone, and are broadcast. Ranks come from one
    range-partitioned sort by length and all columns, so a length that many pieces have is
    not one task, and the outcome does not depend on partitioning. Columns ``sequence_id``
    and ``offset`` are replaced. No pieces give no rows.
    """
    spark = pieces.sparkSession
    pieces = pieces.drop("sequence_id", "offset")
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    table = places(shortest_pack_first(histogram, capacity))
    first, total = np.zeros(capacity + 1, np.int64), 0
    for length in sorted(histogram):
        first[length], total = total, total + histogram[length]
    shared = spark.sparkContext.broadcast((table, first, total + 1))
    order = [F.col("length"), *[F.col(c) for c, t in pieces.dtypes if "map<" not in t and c != "length"]]
    ranked, _ = positioned(pieces, order, "_at", "pack-ranks")
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema.fields]
    return ranked.mapInArrow(_place(shared), f"{', '.join(fields)}, sequence_id bigint, offset bigint")


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """Pieces of ``docs`` with the sequence and offset each goes to.

    Every text is encoded once; from then on only piece lengths and numbers move. Null and
    empty texts are one piece with ``end`` alone; repeated rows are packed as often as they
    occur; other columns pass through.
    """
    return pack(settle(cut_pieces(docs, tokenizer_path, capacity, end), "pack-pieces"), capacity)
