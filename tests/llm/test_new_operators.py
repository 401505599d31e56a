"""SentencePiece coding, hard negatives and whitening against the libraries and brute force."""

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from benchweave.llm import hard_negatives, sentence_pieces, whitening

PIECE_BPE = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=PIECE_BPE)


def hostile(n):
    rng = random.Random(5)
    signs = " \n\t\r▁ab1eThe 日本é\x00\x85　ที😀<s>́…—.,;%&»“"
    return ["".join(rng.choice(signs) for _ in range(rng.randint(0, 40))) for _ in range(n)]


def test_chunks(library):
    """Chunk by chunk, ids and decoded texts equal the library's on whole texts."""
    pieces = sentence_pieces.Pieces(PIECE_BPE)
    for text in ["", None, " ", "  a  ", "\n\n", "a▁b", "<s> </s> <unk> <0x41>", *hostile(3000)]:
        ids = [i for own in pieces.ids(pieces.cut(text)) for i in own]
        assert ids == library.encode(text or "")
        raw = b"".join(pieces.id_bytes[i] for i in ids)
        assert pieces.without_prefix(raw.decode()) == library.decode(ids)


@pytest.mark.parametrize("block", [sentence_pieces.BLOCK, 300])
def test_sentence_pieces(spark, library, block):
    texts = [*hostile(300), None, "", "x", "the same text", "the same text", "word " * 50_000, "a" * 200_000, "ü\n" * 30_000]
    rows = [(i, t, 1, "k") for i, t in enumerate(texts)] + [(0, texts[0], 2, "k"), (None, "no id", 3, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, block int, chunks string").repartition(3)
    got = sentence_pieces.encode_decode(docs, PIECE_BPE, block_bytes=block, bucket_bytes=50_000).collect()
    want = []
    for key, text, *_ in rows:
        ids = library.encode(text or "")
        decoded = library.decode(ids)
        want.append((key, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest(), tuple(ids), decoded))
    assert Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256, tuple(r.ids), r.decoded) for r in got) == Counter(want)


def test_sentence_pieces_empty(spark):
    docs = spark.createDataFrame([], "doc_id string, text string")
    assert sentence_pieces.encode_decode(docs, PIECE_BPE, keep=False).collect() == []


def test_decode(spark, library):
    ids = library.encode("Some text, 日本 12")
    rows = [(1, ids), (2, []), (3, None), (4, [99_999]), (5, [None, 3]), (6, [264, 200, 264])]
    got = {r.k: r.decoded for r in sentence_pieces.decode(spark.createDataFrame(rows, "k int, ids array<int>"), PIECE_BPE).collect()}
    assert got == {1: "Some text, 日本 12", 2: "", 3: None, 4: None, 5: None, 6: library.decode([264, 200, 264])}


def brute_negatives(rows, positives, negatives, low, high):
    rows = list({(i, label, tuple(x)): flag for i, label, x, flag in rows}.items())
    out = Counter()
    for (i, label, x), flag in rows:
        if not flag:
            continue
        scored = [(sum(a * b for a, b in zip(x, y, strict=True)), j, other) for (j, other, y), _ in rows if j != i and len(y) == len(x)]
        near = sorted([(-s, j) for s, j, other in scored if other == label])[:positives]
        for minus, j in near:
            p = -minus
            far = sorted([(-s, m) for s, m, other in scored if other != label and low * p <= 100 * s <= high * p])[:negatives]
            out.update((i, j, n + 1, m, p, -s) for n, (s, m) in enumerate(far))
    return out


@pytest.mark.parametrize("group,scale", [(32_768, 256), (40, 256), (40, 1 << 26), (40, 1)])
def test_negatives(spark, monkeypatch, group, scale):
    """Several trees and waves, ties (coarse scales), repeated rows and ids, lengths, and products beyond doubles."""
    monkeypatch.setattr(hard_negatives, "GROUP", group)
    monkeypatch.setattr(hard_negatives, "LEAF", 8)
    monkeypatch.setattr(hard_negatives, "FANOUT", 3)
    rng = np.random.default_rng(2)
    centre = rng.normal(size=(5, 6))
    x = centre[rng.integers(0, 5, 900)] + 0.5 * rng.normal(size=(900, 6))
    rows = [(i, int(i % 4), np.floor(scale * x[i]).astype(int).tolist(), i % 9 == 0) for i in range(900)]
    rows += [rows[0], rows[18], (9, 2, rows[5][2], True), (2000, 1, rows[0][2], True), (2001, 7, rows[0][2], True), (2002, 1, [1, 2], True), (2003, 2, [2, 2], False), (2004, 1, [1, 3], False), (2005, 1, [], True)]
    odd = [(None, 1, [1] * 6, True), (3000, None, [1] * 6, True), (3001, 1, None, True), (3002, 1, [None] + [1] * 5, False), (3003, 1, [1] * 6, None)]
    points = spark.createDataFrame([(*r, "extra") for r in rows + odd], "id long, label long, x array<long>, anchor boolean, score string")
    got = hard_negatives.mine(points)
    assert Counter(map(tuple, got.collect())) == brute_negatives(rows, 5, 3, 50, 95)
    assert hard_negatives.mine(points.where("id > 2000000")).count() == 0
    assert hard_negatives.mine(points.where("not anchor")).count() == 0


def test_boxes_prune(monkeypatch):
    """On clustered rows the search opens few pages, and those it leaves out hold nothing better."""
    rng = np.random.default_rng(1)
    x = np.floor(256 * (np.repeat(rng.normal(size=(64, 3)) * 4, 128, axis=0) + 0.05 * rng.normal(size=(64 * 128, 3)))).astype(np.int64)
    order = hard_negatives.packing_order(x, np.zeros(len(x), dtype=np.int64))
    tree = hard_negatives.Tree(order.astype(np.int64), np.zeros(len(x), dtype=np.int64), x[order])
    opened = set()
    spy = type("Spy", (list,), {"__getitem__": lambda own, i: (opened.add(i), list.__getitem__(own, i))[1]})
    monkeypatch.setattr(tree, "pages", spy(tree.pages))
    q = x[7]
    found = tree.search(7, 0, q, [{"key": 0, "low": None, "high": None, "score": None, "id": None}], True, 5)
    want = sorted([(-int(s), int(i)) for i, s in enumerate(x @ q) if i != 7])[:5]
    assert sorted((-s, i) for _, s, i in found) == want
    assert len(opened) < len(tree.levels[0][0]) / 2


def test_pages():
    """Pages follow label borders when at least half full, and hold at most LEAF rows."""
    labels = np.sort(np.random.default_rng(0).choice([1, 2, 3, *range(100, 160)], p=[0.3, 0.3, 0.1, *[0.3 / 60] * 60], size=3000))
    cuts = hard_negatives.page_cuts(labels).tolist()
    sizes = np.diff([*cuts, len(labels)])
    assert cuts[0] == 0 and sizes.min() > 0 and sizes.max() <= hard_negatives.LEAF
    assert sum(labels[c] == labels[c - 1] for c in cuts[1:] if labels[c] < 3) <= 3000 * 0.6 / hard_negatives.LEAF
    assert hard_negatives.page_cuts(np.zeros(1)).tolist() == [0]


def test_quantised(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [0.5, -0.001], 3), (2, None, 1), (3, [nan, 1.0], 1), (4, [inf, 1.0], 1), (5, [None, 1.0], 1), (6, [], None)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = hard_negatives.quantised(table, F.col("vec_id") % 2 == 0, F.col("label")).collect()
    assert sorted((r.id, r.label, r.x, r.anchor) for r in got if r.label) == [(1, 3, [128, -1], False)]
    assert hard_negatives.mine(spark.createDataFrame(got, "id long, label long, x array<long>, anchor boolean")).count() == 0


@pytest.mark.parametrize("d", [1, 2, 7, 64])
@pytest.mark.parametrize("kind", ["plain", "graded", "singular", "equal"])
def test_eigen(d, kind):
    rng = np.random.default_rng(d)
    x = rng.normal(size=(3 * d + 5, d))
    x = {"plain": x, "graded": x * np.logspace(0, -3, d), "singular": np.hstack([x[:, :1]] * d) if d > 1 else x, "equal": np.repeat(np.eye(d), 2, axis=0)}[kind]
    a = np.cov(x.T, bias=True).reshape(d, d)
    e, v = whitening.eigen(a)
    want = np.linalg.eigvalsh(a)[::-1]
    assert np.allclose(e, want, rtol=0, atol=1e-13 * max(abs(want[0]), 1e-300))
    assert np.abs(v.T @ v - np.eye(d)).max() < 1e-13
    assert np.abs(a @ v - v * e).max() <= 1e-13 * max(abs(want[0]), 1e-300)


def test_polar_sign():
    rng = np.random.default_rng(0)
    q = np.linalg.qr(rng.normal(size=(30, 30)))[0]
    e = np.concatenate([np.logspace(-9, 2, 15), -np.logspace(-9, 2, 15)])
    u = whitening.polar_sign((q * e) @ q.T)
    assert np.abs(u - (q * np.sign(e)) @ q.T).max() < 1e-6


def brute_whitened(rows, components):
    x = np.array([np.floor(64 * np.array(v, dtype=np.float64)).astype(np.int64) + 1_000_000 for _, v in rows])
    n, s = len(x), x.sum(axis=0)
    y = (n * x - s) / n
    v = y.T @ y / n
    e, u = np.linalg.eigh(v)
    e, u = e[::-1][:components], u[:, ::-1][:, :components]
    return n, ((n * x - s) ** 2).sum(axis=1), y @ u / np.sqrt(e), e / np.trace(v)


def test_whitening(spark):
    rng = np.random.default_rng(3)
    x = (rng.normal(size=(400, 40)) @ rng.normal(size=(40, 40)) / 8).astype(np.float32)
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x)]
    rows += [rows[0], (1, rows[2][1]), (None, rows[3][1])]
    odd = [(900, None), (901, [float("nan")] * 40), (902, [float("inf")] * 40), (903, [None] + [1.0] * 39), (904, []), (905, [1.0, 2.0])]
    table = spark.createDataFrame([(*r, 1, 2) for r in rows + odd], "vec_id long, embedding array<float>, n int, x int").repartition(5)
    got = whitening.whiten(table).collect()
    n, deviation, whitened, explained = brute_whitened(rows, 32)
    assert len(got) == len(rows) * 32 and {r.n for r in got} == {n} and {r.component for r in got} == set(range(1, 33))
    assert {r.identity_error for r in got}.pop() < 1e-10
    by_row = {}
    for r in got:
        by_row.setdefault((r.vec_id, int(r.deviation)), Counter())[r.component] += 1
    assert {k: max(c.values()) for k, c in by_row.items()} == Counter((i, int(d)) for (i, _), d in zip(rows, deviation, strict=True))
    mine = {(r.vec_id, int(r.deviation), r.component): r for r in got}
    for c in range(32):
        own = np.array([mine[i, int(d), c + 1].whitened for (i, _), d in zip(rows, deviation, strict=True)])
        sign = np.sign(own @ whitened[:, c])
        assert np.abs(sign * own - whitened[:, c]).max() < 1e-8
        assert abs(mine[0, int(deviation[0]), c + 1].explained / explained[c] - 1) < 1e-10


def test_whitening_edges(spark):
    schema = "vec_id long, embedding array<double>"
    assert whitening.whiten(spark.createDataFrame([], schema)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], schema)).count() == 0  # nothing varies
    flat = whitening.whiten(spark.createDataFrame([(1, [1.0, 5.0]), (2, [2.0, 5.0]), (3, [6.0, 5.0])], schema)).collect()
    assert {r.component for r in flat} == {1} and abs(flat[0].explained - 1) < 1e-12
    wide = whitening.whiten(spark.createDataFrame([(1, [1e15]), (2, [-1e15]), (3, [0.0])], schema)).collect()
    assert sorted(int(r.deviation) for r in wide) == sorted([0, (3 * 64 * 10**15) ** 2, (3 * 64 * 10**15) ** 2])
    assert np.allclose(sorted(r.whitened for r in wide), [-np.sqrt(1.5), 0, np.sqrt(1.5)])
