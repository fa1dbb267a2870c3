"""Packing: ids against the tokenizer, packs against plain rules."""

import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tallyguard.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = [
    None, "", " ", "\n\t", "a", "Hello, World!", "don't we'll", "x\x1cy a\x1fb", "naïve Ünïcode É é ß ẞ ﬁ", "漢字 かな 🙂",
    "<|startoftext|> a<|endoftext|>b <|ENDOFTEXT|>", "word " * 5000, "a" * 9000, "1,250.75 3rd", "ὈΔΥΣΣΕΎΣ ΣΑΣ",
    "same", "same", "x y  z　w\x85v", "ab. cd, ef; gh: ij! kl?", "a.b 'sAbc ÷ ×",
]


@pytest.mark.parametrize("capacity", [4096, 7])
def test_packed_ids(spark, capacity):
    rows = [(i if i % 6 else None, t, [i]) for i, t in enumerate(ODD)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, length array<int>")
    got = packing.pack_documents(docs.withColumnRenamed("length", "extra"), PATH, capacity).collect()
    tok = Tokenizer.from_file(PATH)
    want = Counter()
    for doc_id, text, extra in rows:
        ids = [*tok.encode(text or "", add_special_tokens=False).ids, 2]
        for at in range(0, len(ids), capacity):
            part = ids[at : at + capacity]
            want[(doc_id, extra[0], at, len(part), zlib.crc32(np.array(part, "<u4").tobytes()), len(ids))] += 1
    assert Counter((r["doc_id"], r["extra"][0], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in got) == want
    check_sequences(got, capacity)


def check_sequences(rows, capacity):
    sequences = defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    assert sorted(sequences) == list(range(len(sequences)))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 50), st.integers(1, 40), max_size=50))
def test_packs_use_every_piece(histogram):
    packs = packing.shortest_pack_first(histogram, 50)
    used = Counter()
    for count, lengths in packs:
        assert count > 0 and sum(lengths) <= 50
        for n in lengths:
            used[n] += count
    assert used == Counter(histogram)
    rows = packing.places(packs)
    assert len({(r[0], r[1]) for r in rows.tolist()}) == len(rows)


def test_padding_is_little():
    drawn = np.random.default_rng(3)
    lengths = np.minimum(drawn.lognormal(5.5, 1.0, 50_000).astype(int) + 1, 4096)
    packs = packing.shortest_pack_first(Counter(lengths.tolist()))
    assert lengths.sum() / (sum(c for c, _ in packs) * 4096) > 0.985
    assert len(packs) < 10_000


def test_words_keep_their_ids():
    encoder = packing._encoder(open(PATH, encoding="utf-8").read())
    tok = Tokenizer.from_file(PATH)
    texts = [t or "" for t in ODD] + [f"again {t or ''}" for t in ODD]
    for _ in range(2):  # first met, then looked up
        for got, want in zip(encoder.texts(texts), texts):
            assert got.tolist() == tok.encode(want, add_special_tokens=False).ids


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    assert packing.pack_documents(docs, PATH).collect() == []
