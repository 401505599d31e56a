"""The training-text operators against brute force on small inputs: nulls, empty and long texts, ties, repeats, clashes."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from benchweave.llm import (
    bpe,
    components,
    embedding_dedup,
    exact_dedup,
    language_id,
    license_scan,
    ngram_jaccard,
    packing,
    quality,
    substring_dedup,
    url_filters,
)
from benchweave.llm.lexicon import Lexicon, compile_words

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words_of(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 6))) for _ in range(n))


@pytest.fixture(scope="module")
def corpus(spark):
    """Copies, near copies, shared passages, runs, blanks, nulls, a repeated row and a null id."""
    rng = random.Random(3)
    passage = words_of(rng, 60)
    base = [words_of(rng, 150) for _ in range(8)]
    texts = [*base, base[0], base[0].replace(" ", "\n\t"), base[1] + " tail", "head " + base[1], "The " * 300, "a b " * 90, None, "", " \n\t ", "x", "é ß 日本"]
    texts += [words_of(rng, 40) + " " + passage + " " + words_of(rng, rng.randint(0, 40)) for _ in range(6)]
    texts += [words_of(rng, 3000), base[2] + " " + words_of(rng, 5), base[3].upper()]
    rows = [(i, t, "en", "s", 0) for i, t in enumerate(texts)]
    rows += [rows[0], (None, base[4], None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randint(0, 60), rng.randint(0, 60)) for _ in range(40)] + [(100 + i, 101 + i) for i in range(20)] + [(5, 5), (None, 3)]
    label = {n: n for e in edges if None not in e for n in e}
    changed = True
    while changed:
        changed = False
        for u, v in edges:
            if u is not None and v is not None and label[u] != label[v]:
                label[u] = label[v] = min(label[u], label[v])
                changed = True
    got = {r["node"]: r["component"] for r in components.connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    linked = {n for u, v in edges if None not in (u, v) and u != v for n in (u, v)}
    assert got == {n: label[n] for n in linked}
    assert components.connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


@pytest.mark.parametrize("span", [5, 35])
def test_substring(spark, corpus, span):
    rows = corpus.collect()
    seen = Counter()
    for r in rows:
        w = (r.text or "").encode().split()
        seen.update(tuple(w[i : i + span]) for i in range(len(w) - span + 1))
    want = Counter()
    for r in rows:
        w = (r.text or "").encode().split()
        gone = [False] * len(w)
        for i in range(len(w) - span + 1):
            if seen[tuple(w[i : i + span])] > 1:
                gone[i : i + span] = [True] * span
        want[r.doc_id, len(w), sum(gone), b" ".join(x for x, g in zip(w, gone, strict=True) if not g).decode()] += 1
    clashing = corpus.withColumn("n_words", F.lit("own"))
    got = substring_dedup.remove_repeats(clashing, span=span).select("doc_id", "n_words", "n_removed", "kept_text").collect()
    assert Counter(map(tuple, got)) == want
    assert substring_dedup.remove_repeats(empty(spark), span=span).count() == 0


def brute_jaccard(rows, n, num, den):
    sets = []
    for r in rows:
        w = bytes(c + 32 if 65 <= c <= 90 else c for c in (r.text or "").encode()).split()
        sets.append(frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else []))
    label = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and den * len(a & sets[j]) >= num * len(a | sets[j]):
                old, new = label[i], label[j]
                label = [new if x == old else x for x in label]
    least = defaultdict(list)
    for r, x in zip(rows, label, strict=True):
        least[x].append(r.doc_id)
    names = {x: min((i for i in ids if i is not None), default=None) for x, ids in least.items()}
    return Counter((r.doc_id, len(s), names[x]) for r, s, x in zip(rows, sets, label, strict=True))


@pytest.mark.parametrize("n,num", [(3, 90), (5, 80), (2, 50)])
def test_jaccard(spark, corpus, n, num):
    got = ngram_jaccard.jaccard_components(corpus, n=n, num=num).collect()
    assert Counter(map(tuple, got)) == brute_jaccard(corpus.collect(), n, num, 100)
    assert ngram_jaccard.jaccard_components(empty(spark)).count() == 0


def test_jaccard_across_tiles(spark, monkeypatch):
    """A group of near copies larger than a tile, and sets at the very threshold."""
    rng = random.Random(9)
    base = words_of(rng, 120).split()
    rows = []
    for i in range(40):
        w = list(base)
        for _ in range(i % 5):
            w[rng.randrange(len(w))] = f"q{rng.randint(0, 999)}"
        rows.append((i, " ".join(w), None, None, None))
    # 9 of 10 one-word shingles shared: exactly 0.9
    rows += [(100, "a1 a2 a3 a4 a5 a6 a7 a8 a9", None, None, None), (101, "a1 a2 a3 a4 a5 a6 a7 a8 a9 b1", None, None, None)]
    docs = spark.createDataFrame(rows, SCHEMA)
    monkeypatch.setattr(ngram_jaccard, "TILE_ROWS", 7)
    for n in (1, 3):
        assert Counter(map(tuple, ngram_jaccard.jaccard_components(docs, n=n, num=90).collect())) == brute_jaccard(docs.collect(), n, 90, 100)


def test_part_keys_meet():
    """Sets at the threshold always share a key, whatever their sizes."""
    rng = np.random.default_rng(5)
    for num in (80, 90):
        for _ in range(300):
            size = int(rng.integers(2, 400))
            drop = int(rng.integers(0, size // 4 + 1))
            a = np.unique(rng.integers(0, 2**63, size, dtype=np.uint64))
            b = a[drop:]
            if len(b) and 100 * len(b) >= num * len(a) and drop:
                assert np.intersect1d(ngram_jaccard.part_keys(a, num, 100), ngram_jaccard.part_keys(b, num, 100)).size


@pytest.mark.parametrize("num", [50, 60])
def test_part_keys_meet_far_bands(num):
    """Low similarities: subsets of every size that links still share a key, several bands apart too."""
    rng = np.random.default_rng(8)
    for size in range(2, 120):
        a = np.unique(rng.integers(0, 2**63, size, dtype=np.uint64))
        for small in range(-(-num * size // 100), size):
            assert np.intersect1d(ngram_jaccard.part_keys(a, num, 100), ngram_jaccard.part_keys(a[:small], num, 100)).size, (small, size)


def test_lexicon(tmp_path):
    rng = random.Random(2)
    words = list({words_of(rng, 1).encode() for _ in range(500)} | {b"", b"abc", b"abcd", bytes([255, 0])})
    outputs = [np.arange(i % 5, dtype="<u4").tobytes() for i in range(len(words))]
    path = tmp_path / "lexicon"
    path.write_bytes(compile_words(words, outputs))
    lexicon = Lexicon(str(path))
    ranks = lexicon.ranks([*words, b"zzz", b"ab"])
    assert [lexicon.output(r) for r in ranks[: len(words)]] == outputs
    assert ranks[len(words)] == -1
    assert len(lexicon.final) < sum(map(len, words))
    path.write_bytes(compile_words([], []))
    assert Lexicon(str(path)).ranks([b"a", b""]).tolist() == [-1, -1]


def test_bpe(spark, corpus):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(BYTE_BPE)
    odd = [(900 + i, t, None, None, None) for i, t in enumerate(["a  b \n\n c", "x<|endoftext|> y", "it's 'll\xa0 z", "ab" * 400, "\x1c! \x85", "日本語 １２ 🎉🎉!!"])]
    docs = corpus.union(spark.createDataFrame(odd, SCHEMA))
    got = bpe.encode_decode(docs, BYTE_BPE, words=50).collect()
    texts = docs.collect()
    assert len(got) == len(texts)
    want = Counter()
    for r in texts:
        ids = tokenizer.encode(r.text or "", add_special_tokens=False).ids
        decoded = tokenizer.decode(ids, skip_special_tokens=False)
        want[r.doc_id, len(ids), hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest(), tuple(ids), decoded] += 1
    assert Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256, tuple(r.ids), r.decoded) for r in got) == want
    assert bpe.encode_decode(empty(spark), BYTE_BPE).count() == 0


def test_merge_many():
    from tokenizers import Tokenizer

    rng, tokenizer, own = random.Random(3), Tokenizer.from_file(BYTE_BPE), bpe.ByteBpe(BYTE_BPE)
    words = ["".join(rng.choice("aaabtheoinr") for _ in range(rng.randint(1, 70))) for _ in range(3000)] + ["é", "a" * 48, "a" * 500]
    want = [np.array(e.ids, dtype="<u4").tobytes() for e in tokenizer.encode_batch(words, add_special_tokens=False)]
    assert own.merge_many([w.encode() for w in words]) == want
    assert [np.array(own.merge(w.encode()), dtype="<u4").tobytes() for w in words[:300]] == want[:300]


def test_exact(spark, corpus):
    rows = corpus.collect()
    digest = lambda t: hashlib.sha256(re.sub(r"[\x20\x09-\x0D]+", " ", t or "").encode()).hexdigest()
    groups = defaultdict(list)
    for r in rows:
        groups[digest(r.text)].append(r.doc_id)
    least = {s: min((i for i in ids if i is not None), default=None) for s, ids in groups.items()}
    got = exact_dedup.exact_groups(corpus).collect()
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == Counter((r.doc_id, least[digest(r.text)], len(groups[digest(r.text)]), digest(r.text)) for r in rows)
    kept = Counter(r.text_sha256 for r in got if r.kept)
    assert kept == Counter(dict.fromkeys(groups, 1))
    left = exact_dedup.drop_exact_copies(corpus).collect()
    assert Counter(digest(r.text) for r in left) == kept and all(r.doc_id == least[digest(r.text)] for r in left)
    assert exact_dedup.exact_groups(empty(spark)).count() == 0


def test_exact_is_native(spark, corpus):
    plan = exact_dedup.exact_groups(corpus)._jdf.queryExecution().toString()
    assert not any(word in plan for word in ("Python", "Arrow", "Pandas"))


def test_exact_small_filter(spark, corpus, monkeypatch):
    """A filter with far too few bits sends more rows to the exact count; the result stays."""
    want = Counter(map(tuple, exact_dedup.exact_groups(corpus).collect()))
    monkeypatch.setattr(exact_dedup, "MAX_BITS", 64)
    assert Counter(map(tuple, exact_dedup.exact_groups(corpus).collect())) == want


@pytest.mark.parametrize("block", [1024, 16])
def test_embeddings(spark, monkeypatch, block):
    monkeypatch.setattr(embedding_dedup, "BLOCK", block)
    monkeypatch.setattr(embedding_dedup, "PER_CELL", 20)
    rng = np.random.default_rng(4)
    centre = rng.normal(size=(6, 12))
    x = (centre[rng.integers(0, 6, 160)] + 0.12 * rng.normal(size=(160, 12))).astype(np.float32)
    rows = [(int(i), [float(v) for v in x[i]], int(i % 3)) for i in range(160)]
    rows += [(200, rows[0][1], 0), (201, rows[0][1], 0), (202, [2 * v for v in rows[0][1]], 0), rows[5]]
    odd = [(300, None, 1), (301, [0.0] * 12, 1), (302, [float("nan")] * 12, 1), (303, [float("inf")] + [1.0] * 11, 1), (304, [None] + [1.0] * 11, 1), (305, rows[0][1], None), (306, [], 1), (307, [1.0, 2.0], 0), (308, [1.0, 2.0], 0)]
    table = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, label int")
    links = {}
    unit = [np.array(v) / np.linalg.norm(v) for _, v, _ in rows]
    n = len(rows)
    match = [[j for j in range(n) if j != i and rows[i][2] == rows[j][2] and unit[i] @ unit[j] >= 0.98] for i in range(n)]
    label = [r[0] for r in rows]
    for _ in range(n):
        label = [min([label[i]] + [label[j] for j in match[i]]) for i in range(n)]
    links = Counter((rows[i][0], len(match[i]), label[i]) for i in range(n))
    links += Counter([(i, 0, i) for i, *_ in odd[:7]] + [(307, 1, 307), (308, 1, 307)])
    got = embedding_dedup.near_duplicates(table).collect()
    assert Counter((r.vec_id, r.n_links, r.component_id) for r in got) == links
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)
    assert embedding_dedup.near_duplicates(table.where("vec_id < 0")).count() == 0


def test_packing(spark, corpus):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(WORD_BPE)
    docs = corpus.union(spark.createDataFrame([(950, "It's <|endoftext|> ÉÉ 日本 İΣ!'s " * 900, None, None, None)], SCHEMA))
    pieces, rows = packing.pack(docs, WORD_BPE, capacity=512, group=10).collect(), docs.collect()
    want = Counter()
    for r in rows:
        ids = np.array([*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 2], dtype="<u4").tobytes()
        for at in range(0, len(ids), 2048):
            part = ids[at : at + 2048]
            want[r.doc_id, at // 4, len(part) // 4, zlib.crc32(part), len(ids) // 4] += 1
    assert Counter((p.doc_id, p.start, p.length, p.ids_crc32, p.doc_tokens) for p in pieces) == want
    sequences = defaultdict(list)
    for p in pieces:
        sequences[p.sequence_id].append((p.offset, p.length))
    for parts in sequences.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 512
    assert packing.pack(empty(spark), WORD_BPE).count() == 0


def test_first_fit_decreasing():
    rng = random.Random(8)
    lengths = sorted((rng.randint(1, 90) for _ in range(300)), reverse=True)
    room, want = [], []
    for n in lengths:
        place = next((i for i, r in enumerate(room) if r >= n), len(room))
        if place == len(room):
            room.append(100)
        want.append((place, 100 - room[place]))
        room[place] -= n
    assert packing.first_fit_decreasing(lengths, 100) == want


def test_language(spark):
    rng = random.Random(6)
    alphabets = {"aa": ["ka", "lo", "mi", "tu"], "bb": ["sch", "ung", "ei", "der"], "cc": ["eau", "oi", "tre", "que"]}
    rows = [(i, " ".join("".join(rng.choice(alphabets[lang]) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(5, 60))), lang, "s", 0) for i, lang in enumerate(list(alphabets) * 40)]
    docs = spark.createDataFrame(rows, SCHEMA)
    content = language_id.learn(docs.where("doc_id < 80"))
    assert sorted(content) == sorted(alphabets)
    odd = spark.createDataFrame([(1000, None, "aa", None, None), (1001, "", None, None, None), (1002, "12 !?", None, None, None)], SCHEMA)
    got = {r.doc_id: r for r in language_id.classify(docs.where("doc_id >= 80").union(odd).withColumn("score", F.lit("x")), content).collect()}
    assert sum(got[i].lang_pred == rows[i][2] for i in range(80, 120)) >= 39
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (1000, 1001, 1002))
    assert all(0 <= r.score <= 1 for r in got.values())
    nothing = language_id.classify(odd, language_id.learn(empty(spark))).collect()
    assert {r.lang_pred for r in nothing} == {"und"}


def test_language_learned(spark):
    """Languages of mostly copies and of only long texts are learned, from the smallest hashes among distinct texts."""
    copies = spark.range(200_000).select(F.lit("mi tu mi lo").alias("text"), F.lit("aa").alias("lang"))
    few = [(f"ka lo {i}", "aa") for i in range(40)] + [("sch ung " * 5000 + str(i), "bb") for i in range(3)] + [("", "cc"), (None, "cc"), ("oi", None)]
    docs = copies.union(spark.createDataFrame(few, "text string, lang string"))
    content = language_id.learn(docs)
    assert sorted(content) == ["aa", "bb"]
    assert Counter(content["aa"].decode().split("\n")) == Counter(["mi tu mi lo", *(t for t, lang in few if lang == "aa")])
    assert [len(t) for t in content["bb"].decode().split("\n")] == [language_id.LONGEST] * 3
    order = [r.text for r in docs.where("lang = 'aa'").distinct().orderBy(F.xxhash64(F.lit(5), "text")).collect()]
    assert language_id.learn(docs, sample=7)["aa"].decode().split("\n") == order[:7]


def test_language_of_long_texts(spark):
    """All of a long text counts, in whichever order two languages stand; blocks join up to the whole."""
    rng = random.Random(16)
    alphabets = {"aa": ["ka", "lo", "mi", "tu"], "bb": ["sch", "ung", "ei", "der"]}

    def text(lang, size):
        return " ".join("".join(rng.choice(alphabets[lang]) for _ in range(rng.randint(1, 4))) for _ in range(size // 7))

    train = spark.createDataFrame([(i, text(lang, 2000), lang, None, None) for i, lang in enumerate(list(alphabets) * 100)], SCHEMA)
    small, large = text("aa", 500_000), text("bb", 1_500_000)
    docs = spark.createDataFrame([(1, small + " " + large, None, None, None), (2, large + " " + small, None, None, None)], SCHEMA)
    got = language_id.classify(docs, language_id.learn(train)).collect()
    assert [r.lang_pred for r in got] == ["bb", "bb"]
    for raw in ("x" * 50_000, "日本é" * 20_000, "ab cd\n" * 9000, "", "x" * language_id.BLOCK_BYTES):
        blocks = language_id._blocks(raw.encode())
        assert "".join(b.decode() for b in blocks) == raw and max(map(len, blocks)) <= language_id.BLOCK_BYTES


def test_quality(spark):
    rng = random.Random(7)
    good = [(i, " ".join(words_of(rng, 30).capitalize().split()), 1) for i in range(120)]
    bad = [(200 + i, " ".join(w + rng.choice(["***", "!!"]) for w in words_of(rng, 30).upper().split()), 0) for i in range(120)]
    rows = spark.createDataFrame(good + bad, "doc_id long, text string, quality int")
    train = rows.where("doc_id % 4 <> 0")
    weights = quality.train(quality.draw_labelled(train, train.select("doc_id", "quality").union(spark.createDataFrame([(None, 1), (1, None)], "a long, b int"))))
    scored = quality.score(rows.where("doc_id % 4 = 0"), weights).collect()
    assert all((r.score >= 0.5) == (r.quality == 1) for r in scored)
    odd = quality.score(spark.createDataFrame([(1, None), (2, ""), (3, "x")], "doc_id long, text string"), weights).collect()
    assert odd[0].score == odd[1].score and all(0 <= r.score <= 1 for r in odd)
    none = quality.train(quality.draw_labelled(rows, spark.createDataFrame([], "doc_id long, quality int")))
    assert {r.score for r in quality.score(rows, none).collect()} == {0.5}


def test_urls(spark):
    rules = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]
    urls = ["http://A.Example.ORG/es/1?x", "https://example.org/en/12#t", "http://org", "http://x.org/", "http://notexample.org/es/", "ftp://m.com/fr/a://b", "x.com/de/", None, "", "http://m.com/de/1", "http://net/de/1", "://?", "http://m.com/DE/"]
    want = [
        ("a.example.org", "/es/1", "example.org/es/"),
        ("example.org", "/en/12", "example.org/en/1"),
        ("org", "", None),
        ("x.org", "/", "org/"),
        ("notexample.org", "/es/", "org/"),
        ("m.com", "/fr/a://b", "com/fr/"),
        ("", "", None),
        ("", "", None),
        ("", "", None),
        ("m.com", "/de/1", "com/de/"),
        ("net", "/de/1", None),
        ("", "", None),
        ("m.com", "/DE/", None),
    ]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("rule", F.lit(1))
    got = sorted(url_filters.judge(pages, rules).collect(), key=lambda r: r.page_id)
    assert [(r.host, r.path, r.rule) for r in got] == want
    decided = {text: what for what, text in rules}
    assert all(r.verdict == decided[r.rule] for r in got if r.rule) and {r.verdict for r in got} <= {"allow", "block"}
    assert got[10].verdict == "block"
    assert url_filters.judge(pages.limit(0), rules).count() == 0


def test_licences(spark):
    rows = [
        ("a/LICENSE", "Released under the MIT License."),
        ("a/b/x.txt", "plain words only here"),
        ("a/b/y.txt", "some text\n# Licensed under the Apache License, Version 2.0.\nmore text"),
        ("c/z.txt", "All rights were wronged in the end of the day"),
        ("d.txt", None),
        (None, "All rights reserved."),
        ("a/b/x.txt", "plain words only here"),
    ]
    files = spark.createDataFrame(rows, "path string, text string").withColumn("score", F.lit("own"))
    got = license_scan.inherit(license_scan.scan(files)).select("path", "own_licence", "licence", "licence_from").collect()
    assert Counter(map(tuple, got)) == Counter(
        [
            ("a/LICENSE", "MIT", "MIT", "a/LICENSE"),
            ("a/b/x.txt", None, "MIT", "a"),
            ("a/b/x.txt", None, "MIT", "a"),
            ("a/b/y.txt", "Apache-2.0", "Apache-2.0", "a/b/y.txt"),
            ("c/z.txt", None, None, None),
            ("d.txt", None, None, None),
            (None, "Proprietary", "Proprietary", None),
        ]
    )
    assert license_scan.inherit(license_scan.scan(files.limit(0))).count() == 0
    slim = license_scan.scan(files, keep_text=False)
    assert slim.columns == ["path", *license_scan.OUTPUTS] and sorted(map(str, slim.collect())) == sorted(map(str, license_scan.scan(files).drop("text").collect()))


def test_licences_within_texts(spark):
    """Notices in longer lines and paragraphs, over line breaks, SPDX forms, headers and whole licences."""
    rng = random.Random(12)
    around = [words_of(rng, 80), words_of(rng, 80)]
    full = {n: t for n, t in license_scan.TEMPLATES if len(t.split()) > 100}

    def wrapped(text):
        w = text.split()
        return "\n".join("# " + " ".join(w[i : i + 9]) for i in range(0, len(w), 9))

    cases = [
        ("Copyright 2020 Foo Inc. All rights reserved.", "Proprietary", 1),
        ("This software is released under the MIT License, see the file LICENSE for details", "MIT", 1),
        (f"{around[0]} Licensed under the Apache License, Version 2.0. {around[1]}", "Apache-2.0", 1),
        (f"{around[0]} released\nunder the MIT\nLicense. {around[1]}", "MIT", 3),
        (f"{around[0]}\n# SPDX-License-Identifier: GPL-2.0-or-later\n{around[1]}", "GPL-2.0", 1),
        (f"{around[0]} /* SPDX-License-Identifier: MIT */ {around[1]}", "MIT", 1),
        ("MIT License\n\nCopyright (c) 2020 Foo. All rights reserved.\n\n" + wrapped(full["MIT"]), "MIT", None),
        ("Copyright (c) 2020, Foo. All rights reserved.\n" + wrapped(full["BSD-2-Clause"]), "BSD-2-Clause", None),
        ("Copyright (c) 2020, Foo. All rights reserved.\n" + wrapped(full["BSD-3-Clause"]), "BSD-3-Clause", None),
        (wrapped(license_scan._GNU.format(what="program", name="General Public License", version="2")), "GPL-2.0", None),
        (around[0], None, 0),
        (f"{around[0]} mit der {around[1]} all the rights of the", None, 0),
    ]
    docs = spark.createDataFrame([(i, t) for i, (t, _, _) in enumerate(cases)], "doc_id long, text string").coalesce(1)
    got = sorted(license_scan.scan(docs).collect(), key=lambda r: r.doc_id)
    assert [r.own_licence for r in got] == [c[1] for c in cases]
    assert all(r.licence_lines == c[2] for r, c in zip(got, cases, strict=True) if c[2] is not None)


def test_licence_of_a_long_text(spark):
    """A licence on each of very many lines, and one line of very many words; products are held for a few units only."""
    lines = "MIT License.\n" * 40_000
    one = ("plain words and more of them " * 40_000) + "Licensed under the Apache License, Version 2.0. " + ("other words of all kinds " * 40_000)
    got = license_scan.scan(spark.createDataFrame([(0, lines), (1, one)], "doc_id long, text string")).orderBy("doc_id").collect()
    assert [(r.own_licence, r.licence_lines) for r in got] == [("MIT", 40_000), ("Apache-2.0", 1)]
    assert got[0].licence_share == 1 and got[1].licence_share < 0.001


def test_licences_in_conflict(spark):
    """Folders whose licence files disagree hand on nothing; files that mention a licence in passing are no licence files."""
    plain = "words of no licence at all"
    rows = [
        ("LICENSE", "Released under the MIT License."),
        ("a/COPYING", "Released under the MIT License."),
        ("a/LICENSE.txt", "# Licensed under the Apache License, Version 2.0."),
        ("a/b/x", plain),
        ("c/readme", "a long story of many plain words that goes on and on. Released under the GNU General Public License v3.0. and on and on it goes"),
        ("c/x", plain),
    ]
    got = license_scan.inherit(license_scan.scan(spark.createDataFrame(rows, "path string, text string"))).collect()
    found = {r.path: (r.licence, r.licence_from) for r in got}
    assert found["a/b/x"] == (None, None) and found["c/x"] == ("MIT", "")
    assert found["c/readme"][1] == "c/readme"


def test_exact_slices(spark, corpus):
    """The sliced filter lets few unique rows through, keeps every group, and hot texts need no task of their own."""
    unique = spark.range(4000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"))
    copies = spark.range(4000, 6000).select(F.col("id").alias("doc_id"), F.lit("the same").alias("text"))
    docs = unique.union(copies)
    rows, bits, slices = exact_dedup._sliced(docs, [F.col("doc_id").alias("id")], "text")
    assert slices == 1
    whole = Counter(map(tuple, exact_dedup.exact_groups(docs).collect()))
    before = exact_dedup.MAX_BITS
    exact_dedup.MAX_BITS = 1 << 14
    try:
        rows, bits, slices = exact_dedup._sliced(docs, [F.col("doc_id").alias("id")], "text")
        assert bits == 1 << 14 and slices == 4
        shuffled = exact_dedup._by_slice(rows, bits, slices, lambda tested: tested.where("__maybe and id < 4000"))
        assert shuffled.count() < 0.05 * 4000
        assert Counter(map(tuple, exact_dedup.exact_groups(docs).collect())) == whole
        left = exact_dedup.drop_exact_copies(docs)
        assert left.columns == docs.columns and sorted(r.doc_id for r in left.collect()) == list(range(4001))
    finally:
        exact_dedup.MAX_BITS = before


def test_stages_remove_only_their_own_tables(spark):
    """A lazy result of another operator can still be read after pipeline stages ran in the same session."""
    import corpus_pipeline

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    other = exact_dedup.exact_groups(docs)
    first = corpus_pipeline.exact_copies(spark, docs, "")
    kept = first.count()
    corpus_pipeline.pack_sequences(spark, docs, "")
    assert other.where("kept").count() == kept


def test_pipeline_small(spark):
    """Each filter takes effect on a small table and the last stage packs what is left."""
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    counts = []
    for name, step in corpus_pipeline.STAGES[:4]:
        out = step(spark, docs, sf)
        assert set(out.columns) == set(corpus_pipeline.COLUMNS), name
        rows = out.collect()
        counts.append(len(rows))
        docs = spark.createDataFrame(rows, SCHEMA)
    assert docs.count() == counts[-1] and counts == sorted(counts, reverse=True)
    assert corpus_pipeline.STAGES[-1][1](spark, docs, sf).select("doc_id").distinct().count() == counts[-1]
