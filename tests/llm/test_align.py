"""Cross-tokenizer alignment against whole-text encoding, and the laws of its fragments."""

import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from tallyguard.llm import align

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = [
    None, "", " ", "\n", "a", "  two  spaces ", "tab\tand\nline \n ends", "trailing ", "naïve café 漢字かな 🙂🙂 x",
    "<|endoftext|> </s> <s> [INST]", "under▁score ▁ x", "a" * 3000, "é" * 2000 + " end", "x\x1cy \x85 z w  　q",
    "same text twice", "same text twice", "0123456789" * 400, "don't can't I'll we've", "́ á", "nul\x00 byte",
]


@pytest.fixture(scope="module")
def tok():
    return align.Tokenizers(open(A, encoding="utf-8").read(), open(B, "rb").read())


def plain(text, tok):
    """Groups of one text by the contract: ids of both sides per group."""
    if not text:
        return []
    (a,), (b,) = tok.encode([text])
    full = f" {text}".encode()
    if tok.a.join(a) != full or tok.b.join(b) != full:
        return []
    ends_a, ends_b = np.cumsum(tok.a.lengths[a]).tolist(), np.cumsum(tok.b.lengths[b]).tolist()
    cuts, out = sorted(set(ends_a) & set(ends_b)), []
    for lo, hi in zip([0, *cuts], cuts):
        out.append(([i for i, e in zip(a, ends_a) if lo < e <= hi], [i for i, e in zip(b, ends_b) if lo < e <= hi]))
    return out


def expected(texts, tok):
    groups = [plain(t, tok) for t in texts]
    links = [Counter((x, y) for a, b in g for x in a for y in b) for g in groups]
    docs = Counter(p for c in links for p in c)
    top = Counter()
    for (x, _), n in docs.items():
        top[x] = max(top[x], n)
    out = []
    for g, c in zip(groups, links):
        shown = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in g)
        best = sum(n for p, n in c.items() if docs[p] == top[p[0]])
        out.append(
            (sum(len(a) for a, _ in g), sum(len(b) for _, b in g), len(g), sum(c.values()), shown, best, sum(n * docs[p] for p, n in c.items()))
        )
    return out


@pytest.mark.parametrize("chunk, frequent", [(align.CHUNK_BYTES, align.FREQUENT_PAIRS), (40, 50), (7, 0)])
def test_align_equals_whole_text_encoding(spark, tok, chunk, frequent):
    drawn = random.Random(5)
    words = ["the", "Payment,", "risk.\n", "zwölf", "x" * 90, "漢字漢字漢字", "(a)", "1,250.75", "re-", "'s", "\t", "end  "]
    texts = ODD + [" ".join(drawn.choice(words) for _ in range(drawn.randint(1, 60))) for _ in range(30)]
    rows = [(i if i % 7 else None, t, "kept") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, n_a string")
    got = align.align(docs, A, B, chunk_bytes=chunk, frequent=frequent)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups", "n_best", "count_sum"]
    want = [(r[0], *e) for r, e in zip(rows, expected(texts, tok))]
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(want, key=key)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    assert align.align(docs, A, B).collect() == []


def shown(f):
    keys, counts = align._merged(f.pairs)
    return (f.cut, f.head_a, f.head_b, f.body, f.groups, f.links, f.closed_a, f.closed_b, keys.tolist(), counts.tolist(), f.tail_a, f.tail_b)


def test_fragments_are_a_monoid(tok):
    drawn = random.Random(9)
    for text in ["Unbelievable naïveté: zwölf Boxkämpfer 漢字かな交じり文 antidisestablishmentarianism", "a" * 200, "é漢" * 40]:
        (a,), (b,) = tok.encode([text])
        a, b = np.array(a), np.array(b)
        ends_a, ends_b = np.cumsum(tok.a.lengths[a]), np.cumsum(tok.b.lengths[b])
        whole = align._fragment(a, ends_a, b, ends_b, tok.b.size)
        for _ in range(20):
            cuts = sorted(drawn.sample(range(1, int(ends_a[-1])), 4))
            parts = []
            for lo, hi in zip([0, *cuts], [*cuts, int(ends_a[-1])]):
                x, y = (ends_a > lo) & (ends_a <= hi), (ends_b > lo) & (ends_b <= hi)
                parts.append(align._fragment(a[x], ends_a[x], b[y], ends_b[y], tok.b.size))
            parts.insert(drawn.randint(0, 5), align.Fragment())
            while len(parts) > 1:  # any order of pairs
                i = drawn.randrange(len(parts) - 1)
                parts[i : i + 2] = [align.compose(parts[i], parts[i + 1], tok.b.size)]
            assert shown(parts[0]) == shown(whole)


def test_spans_cover_the_text():
    text = "  lead " + "word " * 50 + "漢字" * 100 + " a b  c\n d " + "z" * 500 + " tail "
    for chunk in (1, 5, 64, 10_000):
        spans = align.cut_spans(text, chunk)
        assert " ".join(p for _, p in spans) == text
        at = 0
        for offset, part in spans:
            assert offset == at
            at += len(part.encode()) + 1
