"""Operators of the training-data pipeline: brute force, planted cases and odd inputs."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyguard.llm import chat, decontam, lzfinger, mixing, neardup, quality, sharding, tokens, toxicity, urllists
from tallyguard.llm.components import components
from tallyguard.session import settle

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, shard int, copies int, rank int, id string"


def odd_docs(spark):
    """Null columns, empty and blank texts, ties, repeated rows, a long text, clashing names."""
    rows = [
        (1, "one two three four five six seven", "en", "b", 5, 9, 9, 1, "x"),
        (1, "one two three four five six seven", "en", "b", 5, 9, 9, 1, "x"),
        (2, None, None, None, None, None, None, None, None),
        (3, "", "en", "", 0, 1, 1, 1, ""),
        (4, " \n\t ", "en", "a", 4, 1, 1, 1, "y"),
        (None, "no id here but words", "en", None, 4, 1, 1, 1, "z"),
        (5, "word " * 60_000, "en", "a", 300_000, 1, 1, 1, "w"),
        (6, "ü" * 5_000, "de", "ß", 5_000, 1, 1, 1, "v"),
        (7, "This.", "en", "b", 5, 1, 1, 1, "u"),
    ]
    return spark.createDataFrame(rows, DOCS)


def table(spark, path):
    return spark.read.parquet(f"/root/testdata/sf0.001/{path}.parquet")


# mixing


def brute_targets(sizes):
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, left, open_ = {}, 1.5 * sum(sizes.values()), set(order)
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] >= 2 * sizes[s]}
        if not full:
            return target | {s: level * weight[s] for s in open_}
        for s in full:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
        open_ -= full
    return target


def test_mix_meets_targets(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice(["a", "b", "c", "d", None]), int(rng.lognormvariate(5, 1.2))) for i in range(4_000)]
    df = settle(spark.createDataFrame(rows, "doc_id bigint, source string, size bigint"), "t")
    mix = mixing.cube_mix(df, chunk_rows=200).collect()
    again = mixing.cube_mix(df.repartition(7), chunk_rows=200).collect()
    assert sorted((r.doc_id, r.copies) for r in mix) == sorted((r.doc_id, r.copies) for r in again)
    sizes = {}
    for _, s, n in rows:
        sizes[s] = sizes.get(s, 0) + n
    want = brute_targets(sizes)
    taken = dict.fromkeys(sizes, 0)
    for r in mix:
        taken[r.source] += r.size * r.copies
        assert 0 <= r.copies <= 2
        assert r.target == pytest.approx(want[r.source]) and r.source_size == sizes[r.source]
    assert len(mix) == len(rows)
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 0.02 * want[s]


def test_flight_keeps_sums():
    rng = np.random.default_rng(1)
    size = [float(x) for x in rng.integers(0, 500, 300)]
    pi = [float(x) for x in rng.random(300)]
    out = mixing.flight(list(pi), size, rng)
    assert sum(0 < p < 1 for p in out) <= 2
    assert sum(out) == pytest.approx(sum(pi))
    assert np.dot(out, size) == pytest.approx(np.dot(pi, size))
    assert all(p in (0.0, 1.0) for p in mixing.decide(list(pi), [7.0] * 300, rng, True))


def test_flight_keeps_probabilities():
    rng = np.random.default_rng(5)
    pi = [0.2, 0.5, 0.7, 0.4, 0.9, 0.3]
    got = np.mean([mixing.decide(list(pi), [1, 5, 9, 2, 4, 7], rng, True) for _ in range(6_000)], axis=0)
    assert np.abs(got - pi).max() < 0.03


@pytest.mark.parametrize("units, words, count", [(120, 0.02, 0.02), (1_000, 0.001, 0.01), (4_000, 0.001, 0.005)])
def test_landing_keeps_words_count_and_means(units, words, count):
    """95th percentiles over skewed sizes, and the mean inclusion of all and of the shorter units."""
    rng, off_words, off_count, mean, short = np.random.default_rng(2), [], [], [], []
    for _ in range(300 if units < 1_000 else 30):
        size = np.maximum(1, np.round(rng.lognormal(5, 1.5, units)))
        x = np.array(mixing.decide([0.37] * units, size.tolist(), rng, True))
        off_words.append(abs((x * size).sum() / (0.37 * size.sum()) - 1))
        off_count.append(abs(x.sum() / (0.37 * units) - 1))
        mean.append(x.mean())
        short.append(x[np.argsort(size)[: units * 3 // 4]].mean())
    assert np.quantile(off_words, 0.95) < words and np.quantile(off_count, 0.95) < count
    assert abs(np.mean(mean) - 0.37) < 0.02 and abs(np.mean(short) - 0.37) < 0.02


def test_mix_clashing_names(spark):
    rows = [(i, "a", 5 + i % 3, 1, "x", 7) for i in range(100)]
    df = settle(spark.createDataFrame(rows, "doc_id bigint, source string, size bigint, rows bigint, target string, copies int"), "t")
    mix = mixing.cube_mix(df)
    assert mix.columns == ["doc_id", "source", "size", "rows", "source_size", "target", "copies"]
    assert sum(r["rows"] for r in mix.collect()) == 100


def test_mix_odd_and_empty(spark):
    docs = odd_docs(spark)
    out = mixing.mix_documents(docs)
    assert out.columns == docs.columns
    assert all(r.n_chars != 9 for r in out.collect())
    assert mixing.mix_documents(docs.limit(0)).count() == 0


# sharding


def test_shards(spark):
    docs = table(spark, "documents")
    out = sharding.shard_documents(docs).collect()
    assert sorted(r.doc_id for r in out) == sorted(r.doc_id for r in docs.select("doc_id").collect())
    per = {}
    for r in out:
        per.setdefault(r.shard, []).append(r.slot)
    assert set(per) == set(range(24)) and max(map(len, per.values())) - min(map(len, per.values())) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in per.values())


def test_shards_match_the_mixture(spark):
    rows = [(i, "big" if i % 3 else "small") for i in range(3_000)]
    out = sharding.shard_documents(spark.createDataFrame(rows, "doc_id bigint, source string"), shards=10).collect()
    for s in range(10):
        assert abs(sum(r.source == "small" for r in out if r.shard == s) - 100) <= 2


def test_shards_odd_and_empty(spark):
    docs = odd_docs(spark)
    out = sharding.shard_documents(docs)
    assert out.count() == docs.count() and set(docs.columns) == set(out.columns) - {"slot"}
    assert sharding.shard_documents(docs.limit(0)).count() == 0


# token counts


def test_token_counts(spark):
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    hard = ["a<|endoftext|>b <|startoftext|>", "x\x1cy z\x1f", "ΑΣ ΣΑΣ İ", "'sam !'s it's", "é ́a", "中文 test² 12 3", " a b", "q" * 300]
    docs = odd_docs(spark).select("doc_id", "text").union(spark.createDataFrame([(100 + i, t) for i, t in enumerate(hard)], "doc_id bigint, text string"))
    docs = docs.union(table(spark, "documents").select("doc_id", "text"))
    got = tokens.count_tokens(docs, path).collect()
    tok = Tokenizer.from_file(path)
    for r in got:
        assert r.n_tokens == len(tok.encode(r.text or "", add_special_tokens=False).ids)
        assert r.n_bytes == len((r.text or "").encode()) and r.over_limit == (r.n_tokens > 2048)
    assert tokens.count_tokens(docs.limit(0), path).count() == 0


def test_word_cache_starts_afresh(monkeypatch):
    class Tok:
        def encode(self, w, add_special_tokens):
            return type("E", (), {"ids": list(w)})

    monkeypatch.setattr(tokens, "CACHE_WORDS", 3)
    lengths = tokens._Lengths({"ab": 2}, Tok())
    assert tokens.count_words("ab c d e f gg", lengths) == 8
    lengths.trim()
    assert dict(lengths) == {"ab": 2}


# fingerprints


def brute_edits(docs):
    ordered = sorted(docs, key=lambda d: -d[0])
    out = {}
    for (i, t), (_, following) in zip(ordered, ordered[1:] + ordered[:1]):
        half = len(t) // 2
        out[i] = t[: len(t) - half] + following[:half]
    return out


def test_edited_neighbours(spark):
    docs = table(spark, "documents").select("doc_id", "text")
    rows = [(r.doc_id, r.text) for r in docs.collect()] + [(1_000, ""), (1_001, "é"), (-5, "x" * 9_000)]
    got = {r.doc_id: r for r in lzfinger.edited_neighbours(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    want, text = brute_edits(rows), dict(rows)
    assert set(got) == set(want)
    for i, edited in want.items():
        r = got[i]
        assert r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest() and r.n_chars == len(text[i])
        assert r.fingerprint == lzfinger.fingerprint(text[i]) and r.edited_fingerprint == lzfinger.fingerprint(edited)
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1


def test_likeness_estimates_jaccard():
    rng = random.Random(2)
    words = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 8))) for _ in range(800)]
    a = " ".join(rng.choices(words, k=3_000))
    b = a[: len(a) // 2] + " ".join(rng.choices(words, k=1_500))
    pa, pb = set(lzfinger.phrases(a)), set(lzfinger.phrases(b))
    kept = 1_000
    est = lzfinger.likeness(*[lzfinger.signature(t, lzfinger.Parse().feed(t).ends, kept) for t in (a, b)], kept)
    assert est == pytest.approx(len(pa & pb) / len(pa | pb), abs=0.06)
    assert lzfinger.likeness(lzfinger.decode(""), lzfinger.decode("")) == 1.0


def test_fingerprints_odd_and_empty(spark):
    got = lzfinger.edited_neighbours(odd_docs(spark)).collect()
    assert len(got) == 9 and sum(r.doc_id is None for r in got) == 1
    assert {r.fingerprint for r in got if not r.n_chars} == {""}
    assert lzfinger.edited_neighbours(odd_docs(spark).limit(0)).count() == 0
    alone = lzfinger.edited_neighbours(spark.createDataFrame([(3, "abcd")], "doc_id bigint, text string")).first()
    assert alone.edited_sha256 == hashlib.sha256(b"abab").hexdigest()


# chat


@pytest.mark.parametrize("text", ["", "\\", "\\\\", "<s>", "[\\INST]", "<s</s>\\<s>", "a\\</s>[INST][/INST]\\\\", "plain"])
def test_escape_round_trip(text):
    out = chat.escape(text)
    assert chat.unescape(out) == text and not any(c in out for c in chat.CONTROLS)


def test_spans():
    turns = [("system", "be </s> kind"), ("user", "hi"), ("assistant", "yo [INST]"), ("assistant", "")]
    out, spans, rewrote = chat.locate(turns, chat.inst_template)
    assert rewrote is None and "".join(out[s.start : s.end] for s in spans) == out
    assert [chat.unescape(out[s.text_start : s.text_end]) for s in spans] == [t for _, t in turns]


def test_rewriting_template_is_found():
    def last_only(turns):
        return "".join(f"<{r}>{t if k + 1 == len(turns) else '-'}</{r}>" for k, (r, t) in enumerate(turns))

    turns = [("user", "aa"), ("assistant", "bb"), ("user", "cc")]
    out, spans, rewrote = chat.locate(turns, last_only)
    assert rewrote == 1 and spans[1].text_start is None
    assert out[spans[2].text_start : spans[2].text_end] == "cc"


def test_chat_odd_and_empty(spark):
    schema = "conv_id bigint, turn bigint, role string, text string, formatted string"
    rows = [(1, 1, "assistant", "b", "x"), (1, 0, "user", None, "x"), (1, 1, "assistant", "b", "x"), (None, None, None, "n", None), (2, 0, "assistant", "é" * 70_000, "")]
    read = chat.read_back(chat.format_conversations(spark.createDataFrame(rows, schema)))
    got = {r.conv_id: r for r in read.collect()}
    assert [(t.role, t.text) for t in got[1].turns] == [("user", ""), ("assistant", "b"), ("assistant", "b")]
    assert got[1].loss_text == "bb" and got[2].loss_text == "é" * 70_000 and got[None].loss_text == ""
    assert chat.format_conversations(spark.createDataFrame([], schema)).count() == 0


# near duplicates


def brute_components(rows, k, percent):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[j : j + k]) for j in range(max(len(w) - k + 1, 1))} if w else set()
    ids, label = sorted(sets), {}
    for i in ids:
        label[i] = i
    changed = True
    links = [(a, b) for x, a in enumerate(ids) for b in ids[x + 1 :] if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    while changed:
        changed = False
        for a, b in links:
            m = min(label[a], label[b])
            if label[a] != m or label[b] != m:
                label[a] = label[b] = m
                changed = True
    return {i: (len(sets[i]), label[i]) for i in ids}


@pytest.mark.parametrize("k,percent", [(3, 85), (5, 80)])
def test_near_duplicates_equal_brute_force(spark, k, percent):
    rng = random.Random(k)
    rows = [(r.doc_id, r.text) for r in table(spark, "documents").select("doc_id", "text").collect()]
    words = [f"w{i}" for i in range(400)]
    base = rng.choices(words, k=120)
    for i in range(150):  # copies of one text with few to many changes
        copy = list(base)
        for _ in range(rng.randint(0, 9)):
            copy[rng.randrange(len(copy))] = rng.choice(words)
        rows.append((1_000 + i, " ".join(copy)))
    rows += [(2_000, ""), (2_001, None), (2_002, " \t"), (2_003, "A b"), (2_004, "a B"), (2_005, "a")]
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"), k, percent).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_components(rows, k, percent)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_near_duplicates_odd_and_empty(spark):
    docs = odd_docs(spark)
    out = neardup.drop_near_copies(docs)
    assert out.columns == docs.columns and out.count() == 8  # the repeated row goes
    assert neardup.drop_near_copies(docs.limit(0)).count() == 0
    lone = neardup.near_duplicates(docs).where("doc_id IS NULL").collect()
    assert [(r.component_id, r.kept) for r in lone] == [(None, None)]


def test_components(spark):
    links = [(9, 8), (8, 7), (7, 3), (20, 21), (5, 5), (30, 31), (31, 32), (32, 30)]
    got = {r.id: r.label for r in components(spark.createDataFrame(links, "a bigint, b bigint"), "a", "b").collect()}
    assert got == {9: 3, 8: 3, 7: 3, 3: 3, 20: 20, 21: 20, 30: 30, 31: 30, 32: 30}
    path = [(i, i + 1) for i in range(200)]
    got = components(spark.createDataFrame(path, "a bigint, b bigint"), "a", "b")
    assert got.where("label = 0").count() == 201


# decontamination


def test_reparameterised_questions(spark):
    q = "A train leaves the station of Springfield at 12.5 km per hour and meets Alice after 40 minutes of steady travel near the river bridge"
    same = q.replace("Springfield", "Shelbyville").replace("12.5", "17.25").replace("Alice", "Robert").replace("40", "55")
    broken = q.replace("Alice after", "Alice 9 after")
    twice = "Tom gave 7 apples to Tom and kept 7 pears while the others waited outside for Tom and counted 7 plums again"
    mixed = "Tom gave 7 apples to Ann and kept 9 pears while the others waited outside for Bob and counted 3 plums again"
    docs = [(1, f"Before it. {same} and more words follow"), (2, "nothing to see here at all in this text of plain words"), (3, q.upper()), (4, None), (5, ""), (6, mixed), (7, broken), (7, same)]
    items = spark.createDataFrame([(1, q), (2, twice), (3, None), (4, "short one")], "item_id bigint, text string")
    got = {(r.doc_id, r.item_id): r for r in decontam.contaminated(spark.createDataFrame(docs, "doc_id bigint, text string"), items).collect()}
    assert got[1, 1].changed_slots >= 3
    assert (1, 1) in got and (7, 1) in got and (2, 1) not in got
    assert (6, 2) not in got  # Tom and 7 stand for several values


def held(spark, docs, items):
    """(doc, item) pairs found, numbered from 0."""
    frames = [spark.createDataFrame(list(enumerate(x)), f"{name} bigint, text string") for name, x in (("doc_id", docs), ("item_id", items))]
    return {(r.doc_id, r.item_id) for r in decontam.contaminated(*frames).collect()}


def test_short_items_and_few_literals(spark):
    items = [
        "What is 12 times 7?",
        "Compute 12 + 7 * 3 - 4 / 2 + 18 - 5 and 3 * 9",
        "Did Anna, Ben, Carl, Dora and Emil meet Fred in Rome, Oslo, Paris and Bern?",
        "who wrote the novel about the whale",
    ]
    docs = [f"some words come first. {i} And some words come after it" for i in items] + ["who wrote the novel about the sea and what is 13 times 7"]
    assert held(spark, docs, items) == {(i, i) for i in range(4)}


def test_long_passage_of_a_longer_item(spark):
    words = [f"word{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(200)]
    item = " ".join(words)
    slots = " ".join(words[:20] + ["3", "Anna"] + words[20:100] + ["3"] + words[100:])
    docs = [" ".join(words[50:63]), " ".join(words[50:62]), "x " + " ".join(words[20:50]) + " y " + " ".join(words[120:130])]
    docs += ["x " + slots.replace(" 3 Anna", " 4 Berta")]  # 3 stands for 4 and for 3, the words between are one piece
    assert held(spark, docs[:3], [item]) == {(0, 0), (2, 0)}
    assert held(spark, docs[3:], [slots]) == {(0, 0)}


def test_copies_in_other_letter_case(spark):
    q = "A train leaves the station of Springfield at 12.5 km per hour and meets Alice after 40 minutes of steady travel near the river bridge"
    eight = "What makes old iron gates rust so quickly"
    docs = [q.lower(), q.upper(), q.title(), f"They asked him What{eight[4:]} in rain", f"then {eight.lower()} in rain"]
    assert held(spark, docs, [q, eight]) == {(0, 0), (1, 0), (2, 0), (3, 1), (4, 1)}


def test_decontamination_stage(spark):
    docs = odd_docs(spark)
    items = spark.createDataFrame([(1, "one two three four five six seven")], "item_id bigint, text string")
    out = decontam.drop_contaminated(docs, items)
    assert out.columns == docs.columns
    assert sorted(str(r.doc_id) for r in out.collect()) == sorted(["2", "3", "4", "None", "5", "6", "7"])
    assert decontam.drop_contaminated(docs.limit(0), items).count() == 0
    assert decontam.drop_contaminated(docs, items.limit(0)).count() == docs.count()


def test_item_side_in_blocks(spark, monkeypatch):
    docs, items = table(spark, "documents"), table(spark, "benchmark")
    whole = sorted(map(tuple, decontam.contaminated(docs, items).collect()))
    monkeypatch.setattr(decontam, "BROADCAST_WINDOWS", 300)
    assert sorted(map(tuple, decontam.contaminated(docs, items).collect())) == whole and whole


# url lists


def test_intervals_and_ties(spark):
    e = [("block", "domain", "x.com", "add", 10), ("block", "domain", "x.com", "add", 20), ("block", "domain", "x.com", "remove", 30)]
    e += [("block", "domain", "y.com", "remove", 5), ("block", "domain", "y.com", "add", 40), ("block", "domain", "y.com", "remove", 40)]
    e += [("allow", "prefix", "a.x.com/ok/", "add", 1), (None, "domain", "z", "add", 1), ("block", "domain", "x.com", "add", 10)]
    entries = spark.createDataFrame(e, "list string, kind string, pattern string, action string, t int").withColumn("dated_at", F.timestamp_seconds("t"))
    got = urllists.intervals(entries).selectExpr("pattern", "unix_seconds(valid_from) a", "unix_seconds(valid_to) b").collect()
    assert sorted(map(tuple, got)) == [("a.x.com/ok/", 1, None), ("x.com", 10, 30)]
    c = [(1, "http://a.x.com/bad", 10, "q"), (2, "http://a.x.com/bad", 30, "q"), (3, "https://a.x.com/ok/p", 15, "q"), (4, None, 15, "q"), (5, "nonsense", 15, "q"), (6, "http://x.com", None, "q"), (6, "http://X.com:80/", 29, "q")]
    caps = spark.createDataFrame(c, "page_id bigint, url string, t int, pattern string").withColumn("fetched_at", F.timestamp_seconds("t"))
    out = urllists.judge(caps, entries).collect()
    assert sorted((r.page_id, r.blocked) for r in out) == [(1, True), (2, False), (3, False), (4, False), (5, False), (6, False), (6, True)]
    assert urllists.judge(caps.limit(0), entries).count() == 0
    assert urllists.judge(caps, entries.limit(0)).where("blocked").count() == 0


# models


def test_quality_on_labels(spark):
    docs, labels = table(spark, "documents"), table(spark, "labels")
    model = quality.fit(docs)
    assert all(a > 0.5 for a in model["accuracy"].values())
    got = {r.doc_id: r.quality for r in quality.score(docs.select("doc_id", "text"), model).collect()}
    right = [(got[r.doc_id] >= 0.5) == (r.quality == 1) for r in labels.collect()]
    assert np.mean(right) > 0.95


def test_quality_odd_and_empty(spark):
    docs = odd_docs(spark)
    out = quality.keep_good(docs)
    assert out.columns == docs.columns
    assert not {2, 3, 4} & {r.doc_id for r in out.collect()}  # no words
    assert quality.keep_good(docs.limit(0)).count() == 0


def test_quality_keeps_one_bounded_table_of_words():
    """A worker holds a word once, with kind and shape, and 150,000 words at most."""
    words = [f"w{i:x}" for i in range(200_000)] + ["Word", "the", "x" * 65, "#"]
    codes = np.concatenate([quality._codes(words[lo : lo + 1_000]) for lo in range(0, len(words), 1_000)])
    assert len(quality._WORDS) <= 150_000 and "x" * 65 not in quality._WORDS
    assert (codes[-4:] & 3).tolist() == [1, 2, 0, 0]
    assert len({id(c) for c in quality._WORDS.values()}) == len(set(quality._WORDS.values()))
    assert codes.tolist() == quality._codes(words).tolist()


def test_toxicity_on_labels(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    half = labels.where("doc_id % 2 = 0")
    got = {r.doc_id: r for r in toxicity.score(docs.select("doc_id", "text"), toxicity.fit(docs, half)).collect()}
    held = labels.where("doc_id % 2 = 1 AND toxic IS NOT NULL").collect()
    wrong = sum((got[r.doc_id].p_toxic >= 0.5) != (r.toxic == 1) for r in held)
    assert wrong <= 0.06 * len(held)
    assert not any(got[r.doc_id].p_toxic >= 0.5 for r in held if r.toxic == 0)


def test_toxicity_odd_and_empty(spark):
    docs, labels = odd_docs(spark), spark.createDataFrame([(1, 1), (1, None), (99, 1), (None, 1)], "doc_id bigint, toxic int")
    model = toxicity.fit(docs, labels)
    assert toxicity.score(docs, model).count() == docs.count()
    none = toxicity.fit(docs, labels.limit(0))
    assert toxicity.score(docs.limit(0), none).count() == 0 and none["rows"] == 0


def test_quality_sample_is_bounded(spark):
    """A third of all rows have one text that is drawn; the sample stays near its bound."""
    rng = random.Random(6)
    words = ["the", "river", "ran", "over", "stones", "and", "trees", "$$$", "###", "HOT"]
    texts = [" ".join(rng.choice(words) for _ in range(12)) + f" {i}" for i in range(4_000)]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    drawn = df.where("pmod(xxhash64(11, text), 1073741824) < 107374182").first()["text"]
    df = settle(df.unionByName(spark.createDataFrame([(drawn,)] * 2_000, "text string")), "t")
    model = quality.fit(df, train_rows=600)
    assert 0.9 * 600 <= model["sample"] <= 1.1 * 600


def plain_lz78(text):
    seen, out, p = set(), [], ""
    for c in text:
        p += c
        if p not in seen:
            seen.add(p)
            out.append(p)
            p = ""
    return out


def test_lz_phrases_of_any_length():
    """Long repetitive texts are parsed as by plain LZ78: no phrase is cut short."""
    rng = random.Random(2)
    mixed = "".join(rng.choice("ab🙂") for _ in range(5_000))
    for text in ["a" * 100_000, "ab" * 20_000, mixed, "", "x", "naïve 漢字 " * 500]:
        assert lzfinger.phrases(text) == plain_lz78(text)
    assert len(lzfinger.phrases("a" * 3_000)) == 76 and len(lzfinger.phrases("a" * 100_000)) == 446
    near = lzfinger.likeness(*[lzfinger.decode(lzfinger.fingerprint("a" * n)) for n in (3_000, 100_000)])
    assert near < 0.5
    whole = lzfinger.Parse().feed(mixed).ends
    assert lzfinger.Parse().feed(mixed[:777]).copy().feed(mixed[777:]).ends == whole
