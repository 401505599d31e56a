"""Byte-level BPE encoding and decoding with a lexicon of frequent words.

Method: the words (pre-tokens) that occur most over the whole input are encoded once and compiled into a minimal acyclic
transducer (``lexicon.py``), which is written to the shared folder, fetched by every executor and memory-mapped there.
Tasks look words up in it and merge all others exactly, by rank. How many words the lexicon holds (``LEXICON_WORDS``)
changes the speed only. Ids equal those of the tokenizer file's own library, special tokens included.

Null text is empty: no ids, empty decoded text. Texts of any length are encoded whole. Repeated rows give equal results.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import os
import re
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from benchweave.llm.lexicon import Lexicon, compile_words
from benchweave.llm.staging import ship
from benchweave.llm.words import text_slices

LEXICON_WORDS = 30_000
CACHE = 400_000
WORD_CACHE = 400_000
FLUSH = 300_000
_PRETOKEN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
# A pre-token never runs from a non-blank into a blank, so blanks with the non-blanks after them can be treated alone.
_UNIT = re.compile(r"[ \t-\r]*[^ \t-\r]+|[ \t-\r]+")
_ODD_BLANK = re.compile(r"[\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
_LONG = 48


def _byte_symbols() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies: printable Latin-1 stands for itself, the rest from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


def read_spec(path: str) -> dict:
    with open(path, encoding="utf-8") as f:
        return json.load(f)


class ByteBpe:
    """A byte-level BPE vocabulary: exact merging by rank, and decoding."""

    def __init__(self, path: str):
        spec, symbols = read_spec(path), _byte_symbols()
        vocab = {bytes(symbols[c] for c in token): i for token, i in spec["model"]["vocab"].items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.first = [vocab[bytes([b])] for b in range(256)]
        self.ranks, self.made = {}, []
        for rank, (a, b) in enumerate(spec["model"]["merges"]):
            left, right = bytes(symbols[c] for c in a), bytes(symbols[c] for c in b)
            self.ranks[vocab[left], vocab[right]] = rank
            self.made.append(vocab[left + right])
        self.none = len(self.made)
        pairs = np.array([a << 32 | b for a, b in self.ranks], dtype=np.int64)
        order = np.argsort(pairs)
        self.pair_keys, self.pair_ranks = pairs[order], np.array(list(self.ranks.values()), dtype=np.int64)[order]
        self.first_ids, self.made_ids = np.array(self.first, dtype=np.int64), np.array(self.made, dtype=np.int64)
        self.text = {i: t for t, i in vocab.items()} | {i: t.encode() for t, i in self.special.items()}
        self.split = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None

    def merge(self, word: bytes) -> list[int]:
        parts = [self.first[b] for b in word]
        if len(parts) > _LONG:
            return self._merge_long(parts)
        none = len(self.made)
        while len(parts) > 1:
            found = list(map(self.ranks.get, zip(parts, parts[1:], strict=False), repeat(none)))
            best = min(found)
            if best == none:
                break
            at = found.index(best)
            parts[at : at + 2] = [self.made[best]]
        return parts

    def _merge_long(self, parts: list[int]) -> list[int]:
        """The same merges with a heap, for words of any length."""
        after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
        heap = [(self.ranks[p], i) for i, p in enumerate(zip(parts, parts[1:], strict=False)) if p in self.ranks]
        heapq.heapify(heap)
        end = len(parts)
        while heap:
            rank, i = heapq.heappop(heap)
            j = after[i] if parts[i] is not None else end
            if j >= end or self.ranks.get((parts[i], parts[j])) != rank:
                continue
            parts[i], parts[j] = self.made[rank], None
            after[i] = after[j]
            if after[i] < end:
                before[after[i]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b < end and (r := self.ranks.get((parts[a], parts[b]))) is not None:
                    heapq.heappush(heap, (r, a))
        return [p for p in parts if p is not None]

    def _rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == key, self.pair_ranks[at], self.none)

    def merge_many(self, words: list[bytes]) -> list[bytes]:
        """``merge`` of many words side by side, as id bytes: each round merges every word's lowest-ranked pair."""
        long = [i for i, w in enumerate(words) if len(w) > _LONG or not w]
        out: list[bytes] = [b""] * len(words)
        for i in long:
            out[i] = np.array(self.merge(words[i]), dtype="<u4").tobytes()
        short = [i for i, w in enumerate(words) if 0 < len(w) <= _LONG]
        if not short:
            return out
        sizes = np.array([len(words[i]) for i in short])
        word = np.repeat(np.arange(len(short)), sizes)
        ids = self.first_ids[np.frombuffer(b"".join([words[i] for i in short]), dtype=np.uint8)]
        rank = np.full(len(ids), self.none)
        inner = np.flatnonzero(word[:-1] == word[1:])
        rank[inner] = self._rank_of(ids[inner], ids[inner + 1])
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(ids):
            start = np.flatnonzero(np.diff(word, prepend=-1))
            least = np.repeat(np.minimum.reduceat(rank, start), np.diff(np.append(start, len(ids))))
            ended = least == self.none
            if ended.any():
                done.append((word[ended], ids[ended]))
                word, ids, rank, least = word[~ended], ids[~ended], rank[~ended], least[~ended]
            at = np.flatnonzero(rank == least)
            if not len(at):
                break
            at = at[np.diff(word[at], prepend=-1) > 0]  # the leftmost one of each word
            ids[at] = self.made_ids[rank[at]]
            keep = np.ones(len(ids), dtype=bool)
            keep[at + 1] = False
            at -= np.arange(len(at))
            word, ids, rank = word[keep], ids[keep], rank[keep]
            for left in (at, at[at > 0] - 1):
                same = np.append(word[:-1] == word[1:], False)[left]
                rank[left] = self.none
                left = left[same]
                rank[left] = self._rank_of(ids[left], ids[left + 1])
        word, ids = np.concatenate([w for w, _ in done]), np.concatenate([i for _, i in done])
        order = np.argsort(word, kind="stable")
        raw = ids[order].astype("<u4").tobytes()
        cuts = (4 * np.searchsorted(word[order], np.arange(len(short) + 1))).tolist()
        for i, a, b in zip(short, cuts[:-1], cuts[1:], strict=True):
            out[i] = raw[a:b]
        return out

    def pretokens(self, unit: str) -> list[str]:
        return _PRETOKEN.findall(unit)

    def units(self, text: str) -> list[str]:
        return _UNIT.findall(text) if not _ODD_BLANK.search(text) else [text]

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.text.__getitem__, np.frombuffer(ids, dtype="<u4").tolist())).decode("utf-8", errors="replace")


class Encoder:
    """Texts to id bytes: a bounded cache in front of the lexicon, exact merging behind it."""

    def __init__(self, bpe: ByteBpe, lexicon: Lexicon | None = None):
        self.bpe, self.lexicon, self.cache = bpe, lexicon, {}

    def _learn(self, units: set[str]) -> None:
        parts = {u: self.bpe.pretokens(u) for u in units}
        words = [w.encode() for w in set().union(*parts.values())]
        ranks = self.lexicon.ranks(words) if self.lexicon and words else np.full(len(words), -1)
        ids = {w.decode(): self.lexicon.output(r) for w, r in zip(words, ranks.tolist(), strict=True) if r >= 0}
        unseen = [w for w, r in zip(words, ranks.tolist(), strict=True) if r < 0]
        ids.update(zip([w.decode() for w in unseen], self.bpe.merge_many(unseen), strict=True))
        for unit, own in parts.items():
            self.cache[unit] = b"".join([ids[w] for w in own])

    def encode(self, texts: list[str | None]) -> list[bytes]:
        pieces: list[list] = []
        for text in texts:
            own = []
            if text:
                for part in self.bpe.split.split(text) if any(s in text for s in self.bpe.special) else [text]:
                    own += [self.bpe.special[part]] if part in self.bpe.special else self.bpe.units(part)
            pieces.append(own)
        if len(self.cache) > CACHE:
            self.cache.clear()
        new = {u for own in pieces for u in own if u not in self.cache and isinstance(u, str)}
        if new:
            self._learn(new)
        for i in self.bpe.special.values():
            self.cache[i] = int(i).to_bytes(4, "little")
        return [b"".join(map(self.cache.__getitem__, own)) for own in pieces]


def _count_words(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, units = ByteBpe(path), Counter()

        def flush() -> pa.RecordBatch:
            words: Counter = Counter()
            for unit, n in units.items():
                for word in bpe.pretokens(unit):
                    words[word] += n
            units.clear()
            return pa.RecordBatch.from_arrays([pa.array(list(words), pa.string()), pa.array(list(words.values()), pa.int64())], ["word", "n"])

        for batch in batches:
            for text in batch.column("text"):
                units.update(bpe.units(text.as_py() or ""))
                if len(units) > FLUSH:
                    yield flush()
        yield flush()

    return run


def frequent_words(docs: DataFrame, path: str, text: str = "text", limit: int = LEXICON_WORDS) -> list[bytes]:
    """The pre-tokens that occur most over all texts; at most ``limit`` of up to ``_LONG`` bytes reach the driver."""
    counts = docs.select(F.col(text).alias("text")).mapInArrow(_count_words(path), "word string, n long")
    total = counts.where(F.octet_length("word") <= _LONG).groupBy("word").agg(F.sum("n").alias("n"))
    return [r["word"].encode() for r in total.orderBy(F.desc("n"), "word").limit(limit).collect()]


_WORKERS: dict[tuple, Encoder] = {}


def _encoder(path: str, lexicon: str) -> Encoder:
    """One encoder per Python worker, kept between tasks."""
    if (path, lexicon) not in _WORKERS:
        _WORKERS.clear()
        _WORKERS[path, lexicon] = Encoder(ByteBpe(path), Lexicon(SparkFiles.get(lexicon)))
    return _WORKERS[path, lexicon]


def encode_decode(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", words: int = LEXICON_WORDS, keep: bool = True) -> DataFrame:
    """``(key, n_tokens, ids_sha256, decoded_sha256)`` and, with ``keep``, ``ids`` (array) and ``decoded`` (text)."""
    bpe = ByteBpe(path)
    chosen = frequent_words(docs, path, text, words)
    outputs = [np.array(bpe.merge(w), dtype="<u4").tobytes() for w in chosen]
    name = ship(docs.sparkSession, compile_words(chosen, outputs), "lexicon")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path, name)
        for batch in batches:
            texts = batch.column("text")
            for a, b in text_slices(texts):
                ids = encoder.encode(texts.slice(a, b - a).to_pylist())
                decoded = [encoder.bpe.decode(i) for i in ids]
                digests = [[hashlib.sha256(x).hexdigest() for x in xs] for xs in (ids, (d.encode() for d in decoded))]
                columns = [batch.column("id").slice(a, b - a), pa.array([len(i) // 4 for i in ids], pa.int64()), *map(pa.array, digests)]
                if keep:
                    columns += [pa.array([np.frombuffer(i, dtype="<u4").astype(np.int32) for i in ids], pa.list_(pa.int32())), pa.array(decoded, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, ["id", "n_tokens", "ids_sha256", "decoded_sha256", *(["ids", "decoded"] if keep else [])])

    schema = f"id {dict(docs.dtypes)[key]}, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>, decoded string" if keep else "")
    return docs.select(F.col(key).alias("id"), F.col(text).alias("text")).mapInArrow(run, schema).withColumnRenamed("id", key)


class WordBpe:
    """A lower-casing BPE vocabulary whose last symbol of a word carries an end mark; blanks only separate.

    The tokenizer encodes each distinct piece (a run of letters, a digit, a run of other signs) once per worker and many
    at a time; the end marks tell whose ids are whose. Words are put together from pieces. Words with special tokens,
    other than Latin letters, or not in composed form go to the tokenizer whole.
    """

    _ASCII = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9]+")
    _LATIN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
    _OTHER = re.compile("[^\x00-\x84\x86-\x9f\xa1-\u012f\u0131-\u024f]|<\\|")
    _TOGETHER = 256

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        spec = read_spec(path)["model"]
        self.ends = np.zeros(max(spec["vocab"].values()) + 1, dtype=bool)
        self.ends[[i for t, i in spec["vocab"].items() if t.endswith(spec["end_of_word_suffix"])]] = True
        # A task has one core; the library's threads would only contend for it.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.words, self.pieces = {}, {}

    def _learn(self, pieces: list[str]) -> None:
        chunks = [pieces[i : i + self._TOGETHER] for i in range(0, len(pieces), self._TOGETHER)]
        for chunk, found in zip(chunks, self.tokenizer.encode_batch_fast([" ".join(c) for c in chunks], add_special_tokens=False), strict=True):
            ids = np.array(found.ids, dtype="<u4")
            cuts = np.append(0, 4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
            raw = ids.tobytes()
            for piece, a, b in zip(chunk, cuts[:-1], cuts[1:], strict=True):
                self.pieces[piece] = raw[a:b]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Id bytes of whole texts; the caches are bounded."""
        if len(self.words) > WORD_CACHE:
            self.words.clear()
        if len(self.pieces) > WORD_CACHE:
            self.pieces.clear()
        words = [(t or "").encode().split() for t in texts]
        new, cut = set().union(*words).difference(self.words), {}
        for word in new:
            text = word.decode()
            if self._OTHER.search(text):
                self.words[word] = np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
            else:
                cut[word] = (self._ASCII if text.isascii() else self._LATIN).findall(text.lower())
        self._learn(list(set().union(*cut.values()).difference(self.pieces)))
        for word, own in cut.items():
            self.words[word] = b"".join([self.pieces[p] for p in own])
        return [b"".join(map(self.words.__getitem__, own)) for own in words]
