"""Cross-tokenizer alignment with an associative fragment monoid.

Two tokenizers cut the same bytes differently. Byte offsets where tokens of both end cut
the text into groups; an A token and a B token are linked where they share a group.

A fragment describes the tokens that end within one byte range of a text: an open prefix
(tokens up to the first common end), the closed groups between common ends, and an open
suffix (tokens after the last common end). Composing two neighbours closes one group, of
the left suffix and the right prefix; the operation is associative, so a tree reduction
over Spark tasks puts together the fragments of very long documents.

Both tokenizers are sure to cut before a single space between two characters that are not
white space (no token holds a space after another character), so a text is encoded in
segments that start at such a space. A worker encodes equal segments once.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyguard.llm.lookup import Slots, spread
from tallyguard.llm.order import located
from tallyguard.session import settle

CHUNK_BYTES = 32_768  # byte range of one fragment
FAN_IN = 16  # fragments composed by one step of the tree
BATCH_CHARS = 2_000_000  # characters of texts handled together
CACHE_SEGMENTS = 200_000  # segments a worker keeps before it starts afresh
FREQUENT_PAIRS = 200_000  # id pairs of the broadcast table
_JOINED = 2_000  # segments encoded in one call
_WIDE = 4_096  # groups with more links are counted by distinct ids
_SPACE = "▁"  # piece vocabularies write a space so; in a text it does not survive
_CUT = re.compile(r"(?<=\S) (?=\S)")


# --- tokenizers -------------------------------------------------------------------
class _Vocabulary:
    """Bytes of every id, as a list and as lengths."""

    def __init__(self, tokens: list[bytes]):
        self.bytes, self.size = tokens, len(tokens)
        self.lengths = np.array([len(t) for t in tokens], np.int64)

    def join(self, ids) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids))


def _byte_alphabet() -> dict[str, int]:
    """Characters that byte-level vocabularies use for the 256 bytes."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table, extra = {chr(b): b for b in plain}, 256
    for b in range(256):
        if b not in plain:
            table[chr(extra)], extra = b, extra + 1
    return table


class Tokenizers:
    """A (byte-level, from JSON text) and B (pieces with byte fallback, from model bytes)."""

    def __init__(self, spec_a: str, spec_b: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self._a = Tokenizer.from_str(spec_a)
        self._a.no_truncation()
        self._a.no_padding()
        self._a.encode_special_tokens = True
        self._b = sentencepiece.SentencePieceProcessor(model_proto=spec_b)
        alphabet = _byte_alphabet()
        names = [self._a.id_to_token(i) or "" for i in range(self._a.get_vocab_size(True))]
        self.a = _Vocabulary([bytes(alphabet[c] for c in n) if all(c in alphabet for c in n) else n.encode() for n in names])
        pieces = []
        for i in range(self._b.get_piece_size()):
            p = self._b.id_to_piece(i)
            pieces.append(bytes([int(p[3:-1], 16)]) if self._b.is_byte(i) else p.replace(_SPACE, " ").encode())
        self.b = _Vocabulary(pieces)
        if any(re.search(f"[^{_SPACE}]{_SPACE}", self._b.id_to_piece(i)) for i in range(self.b.size)):
            raise ValueError("a piece of the second vocabulary holds a space after another character")

    def encode(self, parts: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of space+part by A and of part by B, which adds the space itself."""
        a = self._a.encode_batch_fast([f" {p}" for p in parts], add_special_tokens=False)
        return [e.ids for e in a], self._b.encode(parts, num_threads=1)


_LOADED: dict[str, _Segments] = {}


def _known(specs: tuple[str, bytes]) -> _Segments:
    """The worker's tokenizers and the segments it has met."""
    key = hashlib.sha256(specs[0].encode() + specs[1]).hexdigest()
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = _Segments(Tokenizers(*specs))
    return _LOADED[key]


# --- fragments --------------------------------------------------------------------
@dataclass
class Fragment:
    """Tokens that end in one byte range; the identity is ``Fragment()``.

    Without a common end (``cut`` false) all tokens are in the prefix. ``pairs`` is a
    list of (keys, counts) arrays of the closed groups, ``key = a * size of B + b``.
    """

    cut: bool = False
    head_a: list[int] = field(default_factory=list)
    head_b: list[int] = field(default_factory=list)
    body: list[str] = field(default_factory=list)
    groups: int = 0
    links: int = 0
    closed_a: int = 0
    closed_b: int = 0
    pairs: list[tuple[np.ndarray, np.ndarray]] = field(default_factory=list)
    tail_a: list[int] = field(default_factory=list)
    tail_b: list[int] = field(default_factory=list)


def _close(a: list[int], b: list[int], size_b: int) -> Fragment:
    """One closed group, or nothing where both sides are empty."""
    if not a and not b:
        return Fragment(cut=True)
    ua, ca = np.unique(np.array(a, np.int64), return_counts=True)
    ub, cb = np.unique(np.array(b, np.int64), return_counts=True)
    keys, counts = (ua[:, None] * size_b + ub).ravel(), (ca[:, None] * cb).ravel()
    text = f"{','.join(map(str, a))}|{','.join(map(str, b))}"
    return Fragment(True, [], [], [text], 1, len(a) * len(b), len(a), len(b), [(keys, counts)])


def compose(x: Fragment, y: Fragment, size_b: int) -> Fragment:
    """The fragment of both ranges; associative."""
    if not y.cut:
        if not x.cut:
            return Fragment(False, x.head_a + y.head_a, x.head_b + y.head_b)
        return Fragment(
            True, x.head_a, x.head_b, x.body, x.groups, x.links, x.closed_a, x.closed_b, x.pairs,
            x.tail_a + y.head_a, x.tail_b + y.head_b,
        )
    if not x.cut:
        return Fragment(
            True, x.head_a + y.head_a, x.head_b + y.head_b, y.body, y.groups, y.links, y.closed_a, y.closed_b, y.pairs,
            y.tail_a, y.tail_b,
        )
    m = _close(x.tail_a + y.head_a, x.tail_b + y.head_b, size_b)
    return Fragment(
        True, x.head_a, x.head_b, x.body + m.body + y.body, x.groups + m.groups + y.groups,
        x.links + m.links + y.links, x.closed_a + m.closed_a + y.closed_a, x.closed_b + m.closed_b + y.closed_b,
        x.pairs + m.pairs + y.pairs, y.tail_a, y.tail_b,
    )


def _merged(pairs: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    if not pairs:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return _sum_by(np.concatenate([k for k, _ in pairs]), np.concatenate([n for _, n in pairs]))


def _sum_by(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return keys, counts
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(counts[order], first)


# --- segments and batches of texts --------------------------------------------------
_PER_SEGMENT = ("same", "length", "n_a", "n_b", "n_groups", "n_links", "first_a", "first_b", "n_keys", "first_key")
_FLAT = ("ids_a", "ids_b", "keys", "key_counts")


class _Segments:
    """Segments met by a worker, encoded and grouped once each.

    Per segment: whether it survives both tokenizers, bytes, tokens, groups, links, the
    text of its groups, and where its tokens and id pairs lie in the flat arrays.
    """

    def __init__(self, tok: Tokenizers):
        self.tok = tok
        self.reset()

    def reset(self) -> None:
        self.slots, self.texts, self._bytes = Slots(), [], 0
        for name in _PER_SEGMENT + _FLAT:
            setattr(self, name, np.empty(0, bool if name == "same" else np.int64))

    def read(self, texts: list[str]) -> _Texts:
        """The texts as segments; new segments are learned first."""
        if len(self.slots) > CACHE_SEGMENTS or self._bytes > 64 * CACHE_SEGMENTS:
            self.reset()
        split = [_CUT.split(t) for t in texts]
        counts = np.array([len(s) for s in split], np.int64)
        at = np.fromiter(map(self.slots.__getitem__, chain.from_iterable(split)), np.int64, int(counts.sum()))
        del split
        new = self.slots.taken()
        if new:
            self._learn(new)
        return _Texts(self, counts, at)

    def _learn(self, words: list[str]) -> None:
        size = len(words)
        length = np.array([len(w.encode()) + 1 for w in words], np.int64)
        order, same, ids_a, ids_b = self._encode(words)
        vocabulary_a, vocabulary_b = self.tok.a, self.tok.b
        ends_a, ends_b = np.cumsum(vocabulary_a.lengths[ids_a]), np.cumsum(vocabulary_b.lengths[ids_b])
        seg_ends = np.cumsum(length[order])
        common = np.intersect1d(ends_a, ends_b, assume_unique=True)
        last_a, last_b = np.searchsorted(ends_a, common) + 1, np.searchsorted(ends_b, common) + 1
        ga, gb = np.diff(last_a, prepend=0), np.diff(last_b, prepend=0)  # tokens per group
        sa, sb = last_a - ga, last_b - gb
        owner = np.searchsorted(seg_ends, common)  # place in ``order``
        n = len(order)

        def placed(values: np.ndarray) -> np.ndarray:
            out = np.zeros(size, np.int64)
            out[order] = values
            return out

        def per(weights) -> np.ndarray:
            return np.bincount(owner, weights, n).astype(np.int64) if n else np.empty(0, np.int64)

        def starts(counts: np.ndarray, flat: str) -> np.ndarray:
            return placed(len(getattr(self, flat)) + np.cumsum(counts[order]) - counts[order])

        found = {"same": same, "length": length, "n_a": placed(per(ga)), "n_b": placed(per(gb))}
        found |= {"n_groups": placed(per(np.ones(len(ga)))), "n_links": placed(per(ga * gb))}
        found |= {"first_a": starts(found["n_a"], "ids_a"), "first_b": starts(found["n_b"], "ids_b")}
        keys, key_counts, n_keys = self._pairs(n, owner, ids_a, ids_b, sa, sb, ga, gb)
        found["n_keys"] = placed(n_keys)
        found["first_key"] = starts(found["n_keys"], "keys")
        found |= {"ids_a": ids_a, "ids_b": ids_b, "keys": keys, "key_counts": key_counts}
        for name, values in found.items():
            setattr(self, name, np.concatenate([getattr(self, name), values]))
        ta, tb = list(map(str, ids_a.tolist())), list(map(str, ids_b.tolist()))
        groups = [
            f"{ta[i]}|{tb[j]}" if x == 1 and y == 1 else f"{','.join(ta[i : i + x])}|{','.join(tb[j : j + y])}"
            for i, j, x, y in zip(sa.tolist(), sb.tolist(), ga.tolist(), gb.tolist())
        ]
        texts, at = [""] * size, 0
        for i, k in zip(order.tolist(), found["n_groups"][order].tolist()):
            texts[i] = ";".join(groups[at : at + k])
            at += k
        self.texts += texts
        self._bytes += int(length.sum())

    def _encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(order, same, ids of A, ids of B): ids of the segments in ``order``, one after the other."""
        plain = [not (not w or w[0].isspace() or w[-1].isspace() or _SPACE in w) for w in words]
        together = [i for i, p in enumerate(plain) if p]
        parts = [together[i : i + _JOINED] for i in range(0, len(together), _JOINED)]
        joined = [" ".join(words[i] for i in p) for p in parts]
        same, order, ids_a, ids_b = np.ones(len(words), bool), [], [], []
        alone = [i for i, p in enumerate(plain) if not p]

        def survives(text: str, a: list[int], b: list[int]) -> bool:
            full = f" {text}".encode()
            return self.tok.a.join(a) == full and self.tok.b.join(b) == full

        for p, text, a, b in zip(parts, joined, *self.tok.encode(joined)):
            if survives(text, a, b):
                order += p
                ids_a.append(a)
                ids_b.append(b)
            else:
                alone += p
        for i, a, b in zip(alone, *self.tok.encode([words[i] for i in alone])):
            same[i] = survives(words[i], a, b)
            if same[i]:
                order.append(i)
                ids_a.append(a)
                ids_b.append(b)
        flat = lambda lists: np.fromiter(chain.from_iterable(lists), np.int64)
        return np.array(order, np.int64), same, flat(ids_a), flat(ids_b)

    def _pairs(self, n: int, owner, ids_a, ids_b, sa, sb, ga, gb) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Id pairs of the groups with their links, segment by segment, and how many each has."""
        links, size_b = ga * gb, self.tok.b.size
        some = np.flatnonzero(links <= _WIDE)
        of = np.repeat(some, links[some])
        nth = spread(np.zeros(len(some), np.int64), links[some])
        keys = [ids_a[sa[of] + nth // gb[of]] * size_b + ids_b[sb[of] + nth % gb[of]]]
        segs, counts = [owner[of]], [np.ones(len(of), np.int64)]
        for g in np.flatnonzero(links > _WIDE):
            wide = _close(ids_a[sa[g] : sa[g] + ga[g]].tolist(), ids_b[sb[g] : sb[g] + gb[g]].tolist(), size_b)
            keys.append(wide.pairs[0][0])
            counts.append(wide.pairs[0][1])
            segs.append(np.full(len(keys[-1]), owner[g]))
        keys, counts, segs = np.concatenate(keys), np.concatenate(counts), np.concatenate(segs)
        by = np.argsort(segs, kind="stable")
        return keys[by], counts[by], np.bincount(segs, minlength=n) if n else np.empty(0, np.int64)

    def run(self, segs: np.ndarray) -> Fragment:
        """The closed fragment of whole segments in a row."""
        if not len(segs):
            return Fragment()
        rows, n = spread(self.first_key[segs], self.n_keys[segs]), self.n_keys
        return Fragment(
            True, [], [], [self.texts[i] for i in segs.tolist()], int(self.n_groups[segs].sum()),
            int(self.n_links[segs].sum()), int(self.n_a[segs].sum()), int(self.n_b[segs].sum()),
            [_sum_by(self.keys[rows], self.key_counts[rows])] if n[segs].any() else [],
        )

    def pieces(self, seg: int, limits: list[int]) -> list[Fragment]:
        """A segment cut at byte offsets, one fragment per range; its start is a common end."""
        a = self.ids_a[self.first_a[seg] : self.first_a[seg] + self.n_a[seg]]
        b = self.ids_b[self.first_b[seg] : self.first_b[seg] + self.n_b[seg]]
        ends_a, ends_b = np.cumsum(self.tok.a.lengths[a]), np.cumsum(self.tok.b.lengths[b])
        out, lo = [], 0
        for hi in [*limits, int(self.length[seg])]:
            in_a, in_b = (ends_a > lo) & (ends_a <= hi), (ends_b > lo) & (ends_b <= hi)
            part = _fragment(a[in_a], ends_a[in_a], b[in_b], ends_b[in_b], self.tok.b.size)
            out.append(compose(Fragment(cut=True), part, self.tok.b.size) if not out else part)
            lo = hi
        return out


class _Texts:
    """Some texts as rows of segment numbers."""

    def __init__(self, segments: _Segments, counts: np.ndarray, at: np.ndarray):
        self.segments, self.counts, self.at = segments, counts, at
        self.starts = np.cumsum(counts) - counts

    def sums(self, per_segment: np.ndarray) -> np.ndarray:
        return np.add.reduceat(per_segment[self.at], self.starts) if len(self.at) else np.empty(0, np.int64)

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text number, key, count), ordered by text and key, each once."""
        s = self.segments
        text = np.repeat(np.arange(len(self.counts)), self.counts)
        used, times = np.unique(text * len(s.texts) + self.at, return_counts=True) if len(text) else (text, text)
        text, seg = used // max(len(s.texts), 1), used % max(len(s.texts), 1)
        n = s.n_keys[seg]
        rows = spread(s.first_key[seg], n)
        span = s.tok.a.size * s.tok.b.size
        both, counts = _sum_by(np.repeat(text, n) * span + s.keys[rows], s.key_counts[rows] * np.repeat(times, n))
        return both // span, both % span, counts


def _fragment(a, ends_a, b, ends_b, size_b: int) -> Fragment:
    """The fragment of tokens given by ids and end offsets, ascending."""
    common = np.intersect1d(ends_a, ends_b, assume_unique=True)
    out = Fragment()
    lo_a = lo_b = 0
    for end in common.tolist():
        hi_a, hi_b = int(np.searchsorted(ends_a, end)) + 1, int(np.searchsorted(ends_b, end)) + 1
        step = Fragment(True, a[lo_a:hi_a].tolist(), b[lo_b:hi_b].tolist())
        out, lo_a, lo_b = compose(out, step, size_b), hi_a, hi_b
    return compose(out, Fragment(False, a[lo_a:].tolist(), b[lo_b:].tolist()), size_b)


# --- Spark side -------------------------------------------------------------------
_ALIGNED = "n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups string, pair_keys array<bigint>, pair_counts array<bigint>"
_FRAGMENT = (
    "span bigint, part int, same boolean, cut boolean, head_a array<bigint>, head_b array<bigint>, tail_a array<bigint>, "
    "tail_b array<bigint>, body string, groups bigint, links bigint, closed_a bigint, closed_b bigint, "
    "pair_keys array<bigint>, pair_counts array<bigint>"
)


def _names(ddl: str) -> list[str]:
    return [c.split()[0] for c in ddl.split(", ")]


def _lists(values: list) -> pa.Array:
    return pa.array(values, pa.list_(pa.int64()))


def _batches(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[dict[str, list]]:
    """Rows as lists, cut so that the texts of one part have ``BATCH_CHARS`` at most (or are one)."""
    for batch in batches:
        rows = {c: batch.column(c).to_pylist() for c in columns}
        lo, chars = 0, 0
        for i, t in enumerate(rows["text"]):
            if chars and chars + len(t or "") > BATCH_CHARS:
                yield {c: v[lo:i] for c, v in rows.items()}
                lo, chars = i, 0
            chars += len(t or "")
        if lo < batch.num_rows:
            yield {c: v[lo:] for c, v in rows.items()}


def _align_short(keys: list[str], shared, digest: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _known(shared.value)
        for rows in _batches(batches, [*keys, "text"]):
            texts = rows["text"]
            n, some = len(texts), [i for i, t in enumerate(texts) if t]
            found = known.read([texts[i] for i in some])
            fine = found.sums((~known.same).astype(np.int64)) == 0
            text, key, count = found.pairs()
            held = fine[text]
            text, key, count = text[held], key[held], count[held]
            place = np.array(some, np.int64)
            sums = []
            for v in (known.n_a, known.n_b, known.n_groups, known.n_links):
                column = np.zeros(n, np.int64)
                column[place] = found.sums(v) * fine
                sums.append(pa.array(column))
            groups = [""] * n
            for i, lo, k, ok in zip(some, found.starts.tolist(), found.counts.tolist(), fine.tolist()):
                if ok:
                    joined = ";".join([known.texts[s] for s in found.at[lo : lo + k].tolist()])
                    groups[i] = hashlib.sha256(joined.encode()).hexdigest() if digest else joined
            sizes = np.bincount(place[text], minlength=n)
            ends = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
            pairs = [pa.ListArray.from_arrays(ends, pa.array(v)) for v in (key, count)]
            named = [pa.array(rows[k], pa.int64()) for k in keys]
            yield pa.RecordBatch.from_arrays(
                [*named, *sums, pa.array(groups), *pairs],
                names=[*keys, "n_a", "n_b", "n_groups", "n_links", "groups", "pair_keys", "pair_counts"],
            )

    return run


def cut_spans(text: str, chunk_bytes: int = CHUNK_BYTES) -> list[tuple[int, str]]:
    """(byte offset in space+text, part) of the spans of a text, one per byte range at most.

    A span starts at the first sure cut of its byte range and reaches to the next span; a
    text without such cuts is one span. Parts come without the space they start with.
    """
    data, cuts, at, chars = text.encode(), [], 0, 0
    while at + chunk_bytes < len(data):
        stop = at + chunk_bytes
        while stop < len(data) and data[stop] & 0xC0 == 0x80:
            stop += 1
        chars, at = chars + len(data[at:stop].decode()), stop
        found = _CUT.search(text, chars)
        if not found:
            break
        if not cuts or found.start() > cuts[-1]:
            cuts.append(found.start())
    out, lo, offset = [], 0, 0
    for cut in [*cuts, len(text)]:
        part = text[lo:cut]
        out.append((offset, part))
        lo, offset = cut + 1, offset + len(part.encode()) + 1
    return out


def _cut_long(keys: list[str], chunk_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                spans = cut_spans(batch.column("text")[i].as_py(), chunk_bytes)
                named = [pa.array([batch.column(k)[i].as_py()] * len(spans), pa.int64()) for k in keys]
                numbers = pa.array(range(len(spans)), pa.int64())
                offsets, parts = pa.array([o for o, _ in spans], pa.int64()), pa.array([p for _, p in spans], pa.string())
                yield pa.RecordBatch.from_arrays([*named, numbers, offsets, parts], names=[*keys, "span", "offset", "text"])

    return run


def _written(keys: list[str], rows: list[tuple]) -> pa.RecordBatch:
    """Fragments as one batch: (key values, span, part, same, fragment)."""
    f = [r[-1] for r in rows]
    pairs = [_merged(x.pairs) for x in f]
    columns = [pa.array([r[0][i] for r in rows], pa.int64()) for i in range(len(keys))]
    columns += [pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int32())]
    columns += [pa.array([bool(r[3]) for r in rows]), pa.array([x.cut for x in f])]
    columns += [_lists([getattr(x, c) for x in f]) for c in ("head_a", "head_b", "tail_a", "tail_b")]
    columns += [pa.array([";".join(x.body) for x in f], pa.string())]
    columns += [pa.array([getattr(x, c) for x in f], pa.int64()) for c in ("groups", "links", "closed_a", "closed_b")]
    columns += [_lists([k for k, _ in pairs]), _lists([n for _, n in pairs])]
    return pa.RecordBatch.from_arrays(columns, names=[*keys, *_names(_FRAGMENT)])


def _read(rows: dict[str, list], i: int) -> Fragment:
    pairs = [(np.array(rows["pair_keys"][i], np.int64), np.array(rows["pair_counts"][i], np.int64))]
    return Fragment(
        rows["cut"][i], rows["head_a"][i], rows["head_b"][i], [rows["body"][i]] if rows["groups"][i] else [],
        rows["groups"][i], rows["links"][i], rows["closed_a"][i], rows["closed_b"][i],
        pairs if rows["groups"][i] else [], rows["tail_a"][i], rows["tail_b"][i],
    )


def span_fragments(known: _Segments, segs: np.ndarray, offset: int, chunk_bytes: int) -> list[Fragment]:
    """Fragments of one span, cut where byte ranges of ``chunk_bytes`` of its text end."""
    size_b, ends = known.tok.b.size, offset + np.cumsum(known.length[segs])
    out, now, lo = [], Fragment(cut=True), 0
    limit = (offset // chunk_bytes + 1) * chunk_bytes
    while lo < len(segs):
        hi = int(np.searchsorted(ends, limit, side="right"))  # segments that end within the range
        now = compose(now, known.run(segs[lo:hi]), size_b)
        lo = hi
        if lo == len(segs):
            break
        start, stop = int(ends[lo] - known.length[segs[lo]]), int(ends[lo])
        limits = list(range(limit, stop, chunk_bytes))
        parts = known.pieces(int(segs[lo]), [x - start for x in limits if x > start])
        if start == limit:  # the range ends between two segments
            out, now = [*out, now], Fragment()
        now = compose(now, parts[0], size_b)
        for p in parts[1:]:
            out, now = [*out, now], p
        lo, limit = lo + 1, limits[-1] + chunk_bytes
    return [*out, now]


def _fragments(keys: list[str], shared, chunk_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _known(shared.value)
        for rows in _batches(batches, [*keys, "span", "offset", "text"]):
            found, out = known.read(rows["text"]), []
            for i, (lo, k) in enumerate(zip(found.starts.tolist(), found.counts.tolist())):
                segs = found.at[lo : lo + k]
                same = bool(known.same[segs].all())
                parts = span_fragments(known, segs, rows["offset"][i], chunk_bytes) if same else [Fragment()]
                name = [rows[c][i] for c in keys]
                out += [(name, rows["span"][i], j, same, p) for j, p in enumerate(parts)]
            yield _written(keys, out)

    return run


def _fold(keys: list[str], shared, digest: bool, last: bool):
    """Composes the fragments of one group in order; ``last`` finishes documents."""

    def run(table: pa.Table) -> pa.Table:
        size_b = shared.value[2]
        rows = table.sort_by([("span", "ascending"), ("part", "ascending")]).to_pydict()
        total, same = Fragment(), all(rows["same"])
        for i in range(len(rows["span"])):
            total = compose(total, _read(rows, i), size_b) if same else Fragment()
        name = [rows[k][0] for k in keys]
        if not last:
            return pa.Table.from_batches([_written(keys, [(name, rows["parent"][0], 0, same, total)])])
        text = ";".join(total.body)
        groups = hashlib.sha256(text.encode()).hexdigest() if digest and text else text
        sums = [total.closed_a, total.closed_b, total.groups, total.links]
        columns = [pa.array([v], pa.int64()) for v in [*name, *sums]] + [pa.array([groups])]
        columns += [_lists([v]) for v in _merged(total.pairs)]
        return pa.table(columns, names=[*keys, *_names(_ALIGNED)])

    return run


def group_tokens(
    docs: DataFrame, keys: list[str], path_a: str, path_b: str, digest: bool = False, chunk_bytes: int = CHUNK_BYTES
) -> tuple[DataFrame, int]:
    """Per row of ``docs`` (``keys``, text): token, group and link counts, groups and pairs; size of B.

    ``groups`` is ``a1,a2|b1;a3|b2,b3`` (with ``digest`` its SHA-256); ``pair_keys`` are
    the row's distinct linked id pairs as a * size of B + b, ``pair_counts`` their links.
    Texts that are null or empty, or that do not survive a tokenizer, have no tokens: zeros,
    an empty string, empty arrays. Texts of up to ``chunk_bytes`` bytes are one fragment;
    longer ones are cut into spans, encoded by different tasks and composed in a tree.
    """
    spark = docs.sparkSession
    with open(path_a, encoding="utf-8") as f:
        spec_a = f.read()
    with open(path_b, "rb") as f:
        spec_b = f.read()
    size_b = _known((spec_a, spec_b)).tok.b.size
    shared = spark.sparkContext.broadcast((spec_a, spec_b))
    small = spark.sparkContext.broadcast((None, None, size_b))
    named = ", ".join(f"{k} bigint" for k in keys)
    long_ = F.coalesce(F.octet_length("text"), F.lit(0)) > chunk_bytes
    rows = docs.select(*keys, "text")
    short = rows.where(~long_).mapInArrow(_align_short(keys, shared, digest), f"{named}, {_ALIGNED}")
    longest = rows.agg(F.max(F.octet_length("text"))).first()[0] or 0
    if longest <= chunk_bytes:
        return short, size_b
    spans = rows.where(long_).mapInArrow(_cut_long(keys, chunk_bytes), f"{named}, span bigint, offset bigint, text string")
    spans = spans.repartition(*keys, "span")
    parts = spans.mapInArrow(_fragments(keys, shared, chunk_bytes), f"{named}, {_FRAGMENT}")
    level = -(-longest // chunk_bytes)
    while level > FAN_IN:
        tier = parts.withColumn("parent", F.expr(f"span div {FAN_IN}"))
        parts = tier.groupBy(*keys, "parent").applyInArrow(_fold(keys, small, digest, False), f"{named}, {_FRAGMENT}")
        level = -(-level // FAN_IN)
    whole = parts.groupBy(*keys).applyInArrow(_fold(keys, small, digest, True), f"{named}, {_ALIGNED}")
    return short.unionByName(whole), size_b


def _tier_one(shared):
    """Best links and count sums by the broadcast pairs; the rest of the pairs as arrays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, docs, best = shared.value
        for batch in batches:
            lists = batch.column("pair_keys")
            keys, counts = (
                batch.column(c).flatten().to_numpy(zero_copy_only=False).astype(np.int64) for c in ("pair_keys", "pair_counts")
            )
            sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
            row = np.repeat(np.arange(batch.num_rows), sizes)
            at = np.minimum(np.searchsorted(known, keys), max(len(known) - 1, 0))
            hit = known[at] == keys if len(known) else np.zeros(len(keys), bool)
            sums = np.zeros((2, batch.num_rows), np.int64)
            np.add.at(sums[0], row[hit], (counts * best[at])[hit] if len(known) else 0)
            np.add.at(sums[1], row[hit], (counts * docs[at])[hit] if len(known) else 0)
            left = np.bincount(row[~hit], minlength=batch.num_rows)
            ends = pa.array(np.concatenate([[0], np.cumsum(left)]).astype(np.int32))
            rest = [pa.ListArray.from_arrays(ends, pa.array(v[~hit])) for v in (keys, counts)]
            kept = [batch.column(c) for c in batch.schema.names if c not in ("pair_keys", "pair_counts")]
            names = [c for c in batch.schema.names if c not in ("pair_keys", "pair_counts")]
            yield pa.RecordBatch.from_arrays(
                [*kept, pa.array(sums[0]), pa.array(sums[1]), *rest], names=[*names, "_best", "_sum", "_keys", "_counts"]
            )

    return run


def align(
    docs: DataFrame, path_a: str, path_b: str, digest: bool = False, chunk_bytes: int = CHUNK_BYTES,
    frequent: int = FREQUENT_PAIRS,
) -> DataFrame:
    """``docs`` without ``text``, with ``n_a``, ``n_b``, ``n_groups``, ``n_links``, ``groups``,
    ``n_best`` (links whose id pair is linked in as many documents as the best pair of its
    A id) and ``count_sum`` (over links, the documents that hold the pair linked).

    Files at ``path_a`` and ``path_b`` are broadcast (their size is that of a vocabulary).
    Document counts of the id pairs are one aggregation with map-side sums. The
    ``frequent`` commonest pairs are looked up in a broadcast table of that many rows; the
    rest, none of which is common, is joined by shuffle. Rows are named by their place in
    the input, so null and repeated ids and clashing column names do no harm; columns of
    the result's names are replaced. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    made = ["n_a", "n_b", "n_groups", "n_links", "groups", "n_best", "count_sum"]
    rows, keys = located(docs, "align-docs")
    aligned, size_b = group_tokens(rows, keys, path_a, path_b, digest, chunk_bytes)
    aligned = settle(aligned, "align-groups")
    seen = aligned.select(F.explode("pair_keys").alias("k")).groupBy("k").agg(F.count(F.lit(1)).alias("docs"))
    seen = settle(seen, "align-pairs")
    top = seen.groupBy(F.expr(f"k div {size_b}").alias("a")).agg(F.max("docs").alias("top"))
    pairs = seen.withColumn("a", F.expr(f"k div {size_b}")).join(top, "a")
    pairs = settle(pairs.select("k", "docs", (F.col("docs") == F.col("top")).cast("bigint").alias("best")), "align-best")
    known = pairs.orderBy(F.col("docs").desc(), "k").limit(frequent).toPandas().sort_values("k")
    table = spark.sparkContext.broadcast(tuple(known[c].to_numpy(np.int64) for c in ("k", "docs", "best")))
    kept = [*keys, "n_a", "n_b", "n_groups", "n_links", "groups"]
    schema = f"{', '.join(f'{k} bigint' for k in keys)}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups string, " \
        "_best bigint, _sum bigint, _keys array<bigint>, _counts array<bigint>"
    judged = settle(aligned.select(*kept, "pair_keys", "pair_counts").mapInArrow(_tier_one(table), schema), "align-judged")
    rest = judged.select(*keys, F.explode(F.arrays_zip("_keys", "_counts")).alias("p"))
    rest = rest.select(*keys, F.col("p._keys").alias("k"), F.col("p._counts").alias("n")).join(pairs, "k")
    rest = rest.groupBy(*keys).agg(F.sum(F.col("n") * F.col("best")).alias("_b2"), F.sum(F.col("n") * F.col("docs")).alias("_s2"))
    total = lambda a, b: F.col(a) + F.coalesce(F.col(b), F.lit(0))
    out = judged.drop("_keys", "_counts").join(rest, keys, "left")
    out = out.select(*kept, total("_best", "_b2").alias("n_best"), total("_sum", "_s2").alias("count_sum"))
    return rows.drop("text", *made).join(out, keys).drop(*keys)
