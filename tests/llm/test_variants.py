"""Spelling variants against brute force."""

import random
import re
import zlib
from collections import Counter

import pytest

from tallyguard.llm import variants


def one_edit(word, words, alphabet):
    out = set()
    for i in range(len(word) + 1):
        out |= {word[:i] + c + word[i:] for c in alphabet}
        if i < len(word):
            out.add(word[:i] + word[i + 1 :])
            out |= {word[:i] + c + word[i + 1 :] for c in alphabet}
    return sorted((out - {word}) & words)


def expected(counts, ratio=10):
    alphabet, words = sorted({c for w in counts for c in w}), set(counts)
    near = {w: one_edit(w, words, alphabet) for w in words}
    form = {}
    for w, found in near.items():
        best = min(found, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best and counts[best] >= ratio * counts[w] else None
    rows = set()
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        rows.add((w, form[w], root, counts[w], len(near[w]), counts[form[w]] if form[w] else None))
    return rows


def plain_counts(rows):
    seen = Counter()
    for doc_id, text in rows:
        lower = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
        for run in re.findall("[A-Za-zÀ-ÿ]+", lower):
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                i = h % len(run)
                run = run[:i] + run[i + 1 :]
            seen[run] += 1
    return {w: n for w, n in seen.items() if len(w) >= 7 and n >= 2}


def test_variant_groups(spark):
    drawn = random.Random(4)
    stems = ["analytics", "Überweisung", "aaaaaaaa", "transaction", "señorita", "×÷×÷×÷×", "ÉTÉÉTÉÉ", "payments"]
    rows = [(None, None), (1, ""), (2, "short words only"), (None, "Nullids Nullids nullidx")]
    for i in range(400):
        words = []
        for _ in range(30):
            w = drawn.choice(stems)
            for _ in range(drawn.choice([0, 0, 0, 0, 1, 1, 2])):
                j, c = drawn.randrange(len(w)), drawn.choice("abéx")
                w = drawn.choice([w[:j] + c + w[j:], w[:j] + w[j + 1 :], w[:j] + c + w[j + 1 :]])
            words.append(w)
        rows.append((i, drawn.choice([" ", ", ", "1"]).join(words)))
    rows += rows[-3:]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id bigint, text string, word string")
    got = variants.variant_groups(docs)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    counts = plain_counts(rows)
    assert len(counts) > 500
    assert Counter(map(tuple, got.collect())) == Counter(expected(counts))


@pytest.mark.parametrize("trie_chars", [64, 9, 3])
def test_both_paths_agree(spark, trie_chars):
    drawn = random.Random(8)
    counts = {}
    for _ in range(600):
        w = "".join(drawn.choice("abé") for _ in range(drawn.randint(4, 12)))
        counts[w] = drawn.randint(1, 500)
    words = variants.settle(spark.createDataFrame(list(counts.items()), "word string, n bigint"), "test-words")
    got = variants.group_variants(words, trie_chars=trie_chars)
    assert Counter(map(tuple, got.collect())) == Counter(expected(counts))


def test_very_long_words(spark):
    long = "ab" * 20_000
    counts = {"a" * n: n for n in range(60, 72)}
    counts |= {long: 50, long[:-1]: 3, long[:777] + "z" + long[778:]: 4, "b" + long: 5, "é" * 65: 9}
    words = variants.settle(spark.createDataFrame(list(counts.items()), "word string, n bigint"), "test-words")
    got = {r["word"]: (r["form"], r["n_near"]) for r in variants.group_variants(words).collect()}
    assert len(got) == len(counts)
    assert got[long] == (None, 3) and got[long[:-1]] == (long, 1) and got["b" + long] == (long, 1)
    assert [got["a" * n][1] for n in (60, 61, 64, 65, 71)] == [1, 2, 2, 2, 1]
    assert got["é" * 65] == (None, 0)


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, None)], "doc_id bigint, text string")
    assert variants.variant_groups(docs).collect() == []
    assert variants.variant_groups(docs.limit(0)).collect() == []
