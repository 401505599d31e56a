"""Word and range hashes on inputs built to collide modulo 2^64, and rows that only their content tells apart."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from benchweave.llm import ngram_jaccard, substring_dedup
from benchweave.llm.words import Words, sequence_hashes

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def thue_morse(n, zero, one):
    return [zero if bin(i).count("1") % 2 == 0 else one for i in range(n)]


def test_word_hashes():
    long = [("".join(thue_morse(n, "a", "b")), "".join(thue_morse(n, "b", "a"))) for n in (64, 256, 1024, 2048, 4096)]
    for a, b in long:
        words = Words(pa.array([f"{a} {b} {a}", a]))
        for h in (words.hashes, words.second):
            assert h[0] == h[2] == h[3] != h[1]
        assert (words.hashes != words.second).all()


def test_sequence_hashes():
    rng = random.Random(2)
    prime = (1 << 61) - 1
    for n in (512, 1024, 4096):
        x, y = (np.uint64(rng.randrange(1 << 64)) for _ in range(2))
        h = np.array(thue_morse(n, x, y) + thue_morse(n, y, x) + thue_morse(n, x, y), dtype=np.uint64)
        at = np.array([0, n, 2 * n])
        for base in (0, 1):
            got = sequence_hashes(h, at, at + n, base)
            assert got[0] == got[2] != got[1]
    extremes = np.array([0, prime, prime - 1, (1 << 64) - 1, 1, 0, prime, prime - 1], dtype=np.uint64)
    a, b = sequence_hashes(extremes, np.array([0, 5]), np.array([3, 8]))
    assert a == b


def brute_removed(texts, span):
    seen = Counter()
    split = [(t or "").split() for t in texts]
    for w in split:
        seen.update(tuple(w[i : i + span]) for i in range(len(w) - span + 1))
    out = []
    for w in split:
        gone = set()
        for i in range(len(w) - span + 1):
            if seen[tuple(w[i : i + span])] > 1:
                gone.update(range(i, i + span))
        out.append(len(gone))
    return out


def test_substring_with_colliding_words(spark):
    """Two texts of 41 words that differ in one long word share no window of 35; long sequences are told apart."""
    rng = random.Random(7)
    words = ["".join(rng.choice("cdefg") for _ in range(6)) for _ in range(41)]
    pair = ["".join(thue_morse(2048, *x)) for x in (("a", "b"), ("b", "a"))]
    texts = [" ".join([*words[:20], p, *words[21:]]) for p in pair]
    filler = ["".join(rng.choice("hijk") for _ in range(5)) for _ in range(60)]
    texts += [" ".join([*filler[:30], *thue_morse(1024, *x), *filler[30:]]) for x in (("x", "y"), ("y", "x"))]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r.n_removed for r in substring_dedup.remove_repeats(docs, span=35).collect()}
    want = brute_removed(texts, 35)
    assert want[:2] == [0, 0] and got == dict(enumerate(want))


def test_jaccard_with_colliding_words(spark):
    rng = random.Random(9)
    words = ["".join(rng.choice("cdefg") for _ in range(6)) for _ in range(41)]
    pair = ["".join(thue_morse(2048, *x)) for x in (("a", "b"), ("b", "a"))]
    texts = [*pair, *(" ".join([*words[:20], p, *words[21:]]) for p in pair)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in ngram_jaccard.jaccard_components(docs, n=3, num=90, den=100).collect()}
    assert got == {i: i for i in range(4)}  # 36 of 42 shingles are shared


@pytest.mark.parametrize("order", [1, -1])
def test_near_duplicates_by_row(spark, order):
    """Repeated and null ids: a clean text that shares its id stays, near copies with null ids leave one."""
    import corpus_pipeline

    rng = random.Random(4)
    texts = [" ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(80)) for _ in range(4)]
    near = [t + " tail" for t in texts]
    rows = [(1, texts[0]), (2, near[0]), (2, texts[1]), (None, texts[2]), (None, near[2]), (3, texts[3]), (3, texts[3]), (4, None), (5, ""), (6, "few words")]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows[::order]], SCHEMA)
    kept = Counter((r.doc_id, r.text) for r in corpus_pipeline.near_duplicates(spark, docs, "").collect())
    one_of = [k for k in ((None, texts[2]), (None, near[2])) if kept.pop(k, 0)]
    assert len(one_of) == 1
    assert kept == Counter([(1, texts[0]), (2, texts[1]), (3, texts[3]), (4, None), (5, ""), (6, "few words")])


def test_near_duplicates_of_nothing(spark):
    import corpus_pipeline

    assert corpus_pipeline.near_duplicates(spark, spark.createDataFrame([], SCHEMA), "").count() == 0
