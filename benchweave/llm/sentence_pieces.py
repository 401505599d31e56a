"""SentencePiece encoding and decoding through a table of distinct chunks.

Method: no piece of the model holds a blank mark after another character, so merges never cross the start of a marked
word. Texts are cut there (and beside characters that no piece joins to their neighbours), every distinct chunk of the
whole input is segmented once, and its ids are joined back by position:

1. Tasks cut whole texts into blocks of about ``BLOCK`` bytes. A block is one row: for every position the number of the
   chunk that stands there (small ones for frequent chunks), and its distinct chunks, dealt to buckets by hash. The number of buckets follows the input's
   size, so that a bucket's distinct chunks fit a task.
2. Each bucket gathers its chunks from all blocks and segments every distinct one once. A chunk comes at most once a
   block, so that very frequent words weigh no more than others.
3. Ids return to their block, in the order in which the chunks came, and are placed by position.

Null and empty texts have no ids and decode to the empty text. Texts of any length are encoded whole. Repeated rows and
repeated or null keys give one result row each. An empty table gives an empty result. Columns other than the key and the
text are ignored, so that their names cannot clash.
"""

from __future__ import annotations

import hashlib
import re
import string
import zlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from benchweave.llm.staging import pieces_for, stage
from benchweave.llm.words import text_slices

MARK = "▁"
BLOCK = 16 << 20
PER_BUCKET = 32 << 20
_NORMAL, _USER_DEFINED, _BYTE, _BPE = 1, 4, 6, 2
_HEAD = ("keys", "counts", "places", "spans")


class Pieces:
    """A SentencePiece model whose pieces cannot cross blank marks: cutting into chunks, ids of chunks, and back."""

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        with open(path, "rb") as f:
            model = sentencepiece_model_pb2.ModelProto.FromString(f.read())
        rules, trained = model.normalizer_spec, model.trainer_spec
        plain = [p.piece for p in model.pieces if p.type == _NORMAL]
        crossing = [p for p in plain if MARK in p.lstrip(MARK)]
        if crossing or trained.model_type != _BPE or not trained.byte_fallback or any(p.type == _USER_DEFINED for p in model.pieces):
            raise ValueError("the chunk table needs BPE pieces with byte fallback that do not cross blank marks")
        if rules.precompiled_charsmap or rules.remove_extra_whitespaces or not rules.escape_whitespaces:
            raise ValueError("the chunk table needs a model without normalisation")
        self.prefix = MARK if rules.add_dummy_prefix else ""
        joined = set("".join(p for p in plain if len(p) > 1))
        alone = {c for c in map(chr, range(128)) if c not in joined and c != " "}
        # Signs, and what pieces join to them, are cut from letters where no piece joins the two.
        beside = {(a, b) for p in plain for a, b in zip(p, p[1:], strict=False) if a != MARK != b}
        signs, grown = set(), set(string.punctuation) - alone
        while grown:
            signs |= grown
            grown = {c for pair in beside if not signs.isdisjoint(pair) for c in pair} - signs
        if any(c.isalpha() for c in signs):
            signs = set()
        own, mixed = ("".join(map(re.escape, sorted(x))) for x in (alone, signs))
        kinds = [f"{MARK}*[^{MARK}{own}{mixed}]+", *([f"{MARK}*[{mixed}]+"] if mixed else []), f"{MARK}+", *([f"[{own}]"] if own else [])]
        self._chunk = re.compile("|".join(kinds))
        rules.add_dummy_prefix = False  # chunks carry their marks
        self.processor = sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())
        self.size = len(model.pieces)
        self.id_type = np.dtype("<u2" if self.size <= 1 << 16 else "<u4")
        self.id_texts = [str(i) for i in range(self.size)]
        # What ids of a text decode to: blanks for marks, and the bytes of characters without a piece.
        self.id_bytes = [bytes([int(p.piece[3:5], 16)]) if p.type == _BYTE else p.piece.replace(MARK, " ").encode() for p in model.pieces]

    def cut(self, text: str | None) -> list[str]:
        return self._chunk.findall(self.prefix + text.replace(" ", MARK)) if text else []

    def ids(self, chunks: list[str]) -> list[list[int]]:
        return self.processor.encode(chunks, num_threads=1)

    def decode(self, ids: list[list[int]]) -> list[str]:
        return self.processor.decode(ids, num_threads=1) if ids else []

    def without_prefix(self, decoded: str) -> str:
        return decoded[1:] if self.prefix and decoded.startswith(" ") else decoded


_WORKERS: dict[str, Pieces] = {}


def _pieces(path: str) -> Pieces:
    """One model per Python worker, kept between tasks."""
    if path not in _WORKERS:
        _WORKERS.clear()
        _WORKERS[path] = Pieces(path)
    return _WORKERS[path]


def _planes(codes: np.ndarray) -> bytes:
    """All low bytes, then all second bytes and so on, which compresses better than number by number."""
    return np.ascontiguousarray(codes.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def _from_planes(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, dtype=np.uint8).reshape(4, -1).T).view("<u4").reshape(-1)


def _cut_blocks(path: str, block_bytes: int, buckets: int, key_type: pa.DataType):
    part_type = pa.list_(pa.struct([("bucket", pa.int32()), ("chunks", pa.binary())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, pack = _pieces(path), zstandard.ZstdCompressor(level=3)
        # Numbers are unique in the staged table, which holds one attempt of every task.
        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            keys, texts = batch.column("id"), batch.column("text")
            for a, b in text_slices(texts, block_bytes):
                number: dict[str, int] = defaultdict()
                number.default_factory = number.__len__
                counts, places = [], []
                for text in texts.slice(a, b - a):
                    chunks = pieces.cut(text.as_py())
                    counts.append(len(chunks))
                    places.append(np.fromiter(map(number.__getitem__, chunks), dtype="<u4", count=len(chunks)))
                whole = np.concatenate(places)
                # The more frequent, the smaller the new number: by powers of two, then by bucket and text.
                power = np.frexp(np.bincount(whole, minlength=len(number)))[1].tolist()
                order = sorted((-power[i], zlib.crc32(c.encode()) % buckets, c) for c, i in number.items())
                again = np.empty(len(order), dtype="<u4")
                again[[number[c] for *_, c in order]] = np.arange(len(order), dtype="<u4")
                dealt, spans = defaultdict(list), []
                for (_, bucket), run_of in groupby(order, key=lambda o: o[:2]):
                    own = [c for *_, c in run_of]
                    dealt[bucket] += own
                    spans.append((bucket, len(own)))
                columns = [
                    pa.array([block], pa.int64()),
                    pa.ListArray.from_arrays(pa.array([0, b - a], pa.int32()), keys.slice(a, b - a)).cast(pa.list_(key_type)),
                    pa.array([counts], pa.list_(pa.int32())),
                    pa.array([pack.compress(_planes(again[whole]))], pa.binary()),
                    pa.array([pack.compress(np.array(spans, dtype="<u4").tobytes())], pa.binary()),
                    # A chunk holds marks in place of blanks, so that a blank can stand between chunks.
                    pa.array([[{"bucket": k, "chunks": pack.compress(" ".join(dealt[k]).encode())} for k in sorted(dealt)]], part_type),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["block", *_HEAD, "parts"])
                block += 1

    return run


def _segment(path: str):
    """Rows come sorted by bucket; each bucket's distinct chunks are segmented when they are first met."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, pack, unpack = _pieces(path), zstandard.ZstdCompressor(level=3), zstandard.ZstdDecompressor()
        current, known = None, {}
        for batch in batches:
            for block, bucket, joined in zip(*(batch.column(n).to_pylist() for n in ("block", "bucket", "chunks")), strict=True):
                if bucket != current:
                    current, known = bucket, {}
                chunks = unpack.decompress(joined).decode().split(" ")
                new = [c for c in chunks if c not in known]
                known.update(zip(new, [np.array(i, dtype=pieces.id_type).tobytes() for i in pieces.ids(new)], strict=True))
                ids = [known[c] for c in chunks]
                sizes = np.fromiter(map(len, ids), dtype="<u4", count=len(ids)) // pieces.id_type.itemsize
                columns = [pa.array([block], pa.int64()), pa.array([bucket], pa.int32()), *(pa.array([pack.compress(x)], pa.binary()) for x in (sizes.tobytes(), b"".join(ids)))]
                yield pa.RecordBatch.from_arrays(columns, ["block", "bucket", "sizes", "ids"])

    return run


def _place(path: str, key_type: pa.DataType, keep: bool):
    names = ["id", "n_tokens", "ids_sha256", "decoded_sha256", *(["ids", "decoded"] if keep else [])]
    types = [key_type, pa.int64(), pa.string(), pa.string(), *([pa.list_(pa.int32()), pa.string()] if keep else [])]

    def finish(pieces: Pieces, head: dict, sizes: dict[int, np.ndarray], ids: dict[int, np.ndarray]) -> pa.RecordBatch:
        unpack = zstandard.ZstdDecompressor()
        spans = np.frombuffer(unpack.decompress(head["spans"]), dtype="<u4").reshape(-1, 2).tolist()
        # Buckets hold their chunks in the order of the block's numbers, span by span.
        done, parts, lists = dict.fromkeys(sizes, (0, 0)), [], []
        for bucket, n in spans:
            at, ids_at = done[bucket]
            own = sizes[bucket][at : at + n]
            parts.append(own)
            lists.append(ids[bucket][ids_at : ids_at + own.sum()])
            done[bucket] = (at + n, ids_at + int(own.sum()))
        sizes_of = np.concatenate([*parts, np.zeros(0, dtype=np.int64)])
        flat = np.concatenate([*lists, np.zeros(0, dtype=pieces.id_type)]).tolist()
        cuts = np.concatenate([[0], np.cumsum(sizes_of)]).tolist()
        texts, raw = list(map(pieces.id_texts.__getitem__, flat)), list(map(pieces.id_bytes.__getitem__, flat))
        listed_of = [",".join(texts[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        decoded_of = [b"".join(raw[a:b]).decode("utf-8", errors="replace") for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        places = _from_planes(unpack.decompress(head["places"]))
        columns: list[list] = [[] for _ in names]
        start = 0
        for key, n in zip(head["keys"], head["counts"], strict=True):
            at = places[start : start + n]
            start += n
            order = at.tolist()
            listed = ",".join(map(listed_of.__getitem__, order))
            decoded = pieces.without_prefix("".join(map(decoded_of.__getitem__, order)))
            row = [key, int(sizes_of[at].sum()), *(hashlib.sha256(t.encode()).hexdigest() for t in (listed, decoded))]
            if keep:
                row += [list(map(int, listed.split(","))) if n else [], decoded]
            for column, value in zip(columns, row, strict=True):
                column.append(value)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, unpack = _pieces(path), zstandard.ZstdDecompressor()
        head, sizes, ids = None, {}, {}
        for batch in batches:
            for i, bucket in enumerate(batch.column("bucket").to_pylist()):
                if bucket < 0:  # a block's own row comes before its parts
                    if head is not None:
                        yield finish(pieces, head, sizes, ids)
                    head, sizes, ids = {n: batch.column(n)[i].as_py() for n in _HEAD}, {}, {}
                else:
                    sizes[bucket] = np.frombuffer(unpack.decompress(batch.column("sizes")[i].as_py()), dtype="<u4").astype(np.int64)
                    ids[bucket] = np.frombuffer(unpack.decompress(batch.column("ids")[i].as_py()), dtype=pieces.id_type)
        if head is not None:
            yield finish(pieces, head, sizes, ids)

    return run


def encode_decode(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", keep: bool = True, block_bytes: int = BLOCK, bucket_bytes: int = PER_BUCKET) -> DataFrame:
    """``(key, n_tokens, ids_sha256, decoded_sha256)`` and, with ``keep``, ``ids`` (array) and ``decoded`` (text).

    ``ids_sha256`` digests the decimal ids joined by commas, ``decoded_sha256`` the decoded text in UTF-8.
    """
    Pieces(path)  # an unfit model fails here and not in the tasks
    rows = docs.select(F.col(key).alias("id"), F.col(text).alias("text"))
    key_name = dict(rows.dtypes)["id"]
    key_type = rows.select("id").limit(0).toArrow().schema.field("id").type
    buckets = pieces_for(rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"], bucket_bytes)
    schema = f"block long, keys array<{key_name}>, counts array<int>, places binary, spans binary, parts array<struct<bucket:int,chunks:binary>>"
    blocks = stage(rows.mapInArrow(_cut_blocks(path, block_bytes, buckets, key_type), schema), "chunk-blocks")
    parts = blocks.select("block", F.explode("parts").alias("part")).select("block", "part.*")
    found = parts.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(_segment(path), "block long, bucket int, sizes binary, ids binary")
    heads = blocks.select("block", F.lit(-1).alias("bucket"), *_HEAD)
    width = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    gathered = heads.unionByName(found, allowMissingColumns=True).repartition(width, "block").sortWithinPartitions("block", "bucket")
    result = f"id {key_name}, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>, decoded string" if keep else "")
    return gathered.mapInArrow(_place(path, key_type, keep), result).withColumnRenamed("id", key)


def decode(encoded: DataFrame, path: str, ids: str = "ids", output: str = "decoded") -> DataFrame:
    """``encoded`` with the text of each id list; null lists, and lists with a null or unknown id, decode to null."""
    schema = encoded.withColumn(output, F.lit(None).cast("string")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _pieces(path)
        for batch in batches:
            lists = batch.column(ids).to_pylist()
            good = [i for i, own in enumerate(lists) if own is not None and all(x is not None and 0 <= x < pieces.size for x in own)]
            texts: list[str | None] = [None] * len(lists)
            for i, surface in zip(good, pieces.decode([lists[i] for i in good]), strict=True):
                texts[i] = pieces.without_prefix(surface)
            columns = dict(zip(batch.schema.names, batch.columns, strict=True)) | {output: pa.array(texts, pa.string())}
            yield pa.RecordBatch.from_arrays([columns[n] for n in schema.names], schema.names)

    return encoded.mapInArrow(run, schema)
