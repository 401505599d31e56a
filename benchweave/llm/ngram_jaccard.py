"""N-gram Jaccard join: link texts whose word-shingle sets reach a similarity, and name each text's component.

Method: size-banded tiles with hashed bitmap signatures.

1. Texts with equal shingle sets become one set (a count per 64-bit set digest), whatever their number.
2. Sizes fall into geometric bands; a set also visits every higher band in which a partner is possible. In its band every
   set is cut by hash into ``k`` parts, ``k`` above the largest symmetric difference that two linked sets of the band can
   have, so linked sets agree in one whole part. A part that is empty only counts where a set has too many of those for
   the argument to hold. Parts with the same holders are looked at once.
3. The holders of a part meet in tiles of bounded size, each pair of tiles in a task. The bit counts of two signatures'
   difference bound the overlap from above; pairs that pass make candidate clusters, of which a spanning forest is kept.
4. A cluster is compared in such tiles again, now with the texts: pairs that pass the bound are decided by intersecting
   the sorted arrays. Pairs already connected are not compared again, and at most one link per merge leaves a task, so a
   group of n near copies never emits n² rows. No holder, pair or cluster is capped.

``n_shingles`` is the size of a text's set; a text with fewer words than ``n`` has its whole word sequence as the only
shingle. Null text, and text without words, has an empty set and links with nothing. Repeated rows link with each other.
A null id never becomes a component's name while another id exists. Other columns of the input are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from benchweave.llm.components import connected_components
from benchweave.llm.staging import discard, row_key, stage
from benchweave.llm.words import Words, mix, range_hashes, text_slices

BAND = 1.5
TILE_ROWS = 1024
TILE_SHINGLES = 1 << 20
BITS = 2048
LEAST_BITS = 512


def shingle_sets(words: Words, n: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of every text."""
    counts, offsets = words.counts, words.offsets
    starts = np.arange(len(words.hashes))
    rows = words.rows()
    left = offsets[1:][rows] - starts
    whole = (counts[rows] < n) & (starts == offsets[:-1][rows])
    keep = (left >= n) | whole
    starts, rows = starts[keep], rows[keep]
    hashes = range_hashes(words.hashes, starts, np.minimum(starts + n, offsets[1:][rows]))
    cuts = np.searchsorted(rows, np.arange(len(counts) + 1))
    return [np.unique(hashes[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def largest_difference(total: int, num: int, den: int) -> int:
    """The largest symmetric difference of two sets of ``total`` elements together whose similarity is num/den or more."""
    # den * i >= num * u with u = (total + d) / 2 and i = (total - d) / 2
    return (den - num) * total // (den + num)


def bands_of(size: int, num: int, den: int) -> list[int]:
    band = int(math.log(size) / math.log(BAND))
    while round(BAND ** (band + 1)) <= size:
        band += 1
    while round(BAND**band) > size:
        band -= 1
    # A partner may hold up to size * den / num elements.
    last = band
    while round(BAND ** (last + 1)) * num <= size * den:
        last += 1
    return list(range(band, last + 1))


def part_keys(members: np.ndarray, num: int, den: int) -> np.ndarray:
    out = []
    for band in bands_of(len(members), num, den):
        low, top = round(BAND**band), round(BAND ** (band + 1)) - 1
        most = largest_difference(2 * top, num, den)
        if not most:
            continue  # linked sets of this size are equal sets
        k = most + 1 + math.ceil(2 * most * math.exp(-low / most))
        part = ((members >> np.uint64(32)) * np.uint64(k)) >> np.uint64(32)
        at = np.flatnonzero(np.diff(part, prepend=part[0] + np.uint64(1)))
        at[0] = 0
        sums = np.add.reduceat(mix(members), at)
        tag = np.uint64((band << 32) + 1)
        keys = mix(sums ^ (part[at] * np.uint64(0x9FB21C651E98DF25) + tag))
        if k - len(at) >= k - most:
            empty = np.setdiff1d(np.arange(k, dtype=np.uint64), part[at])
            keys = np.concatenate([keys, mix(empty * np.uint64(0x9FB21C651E98DF25) + tag)])
        out.append(keys)
    return np.concatenate(out) if out else np.zeros(0, dtype=np.uint64)


def _signature(members: np.ndarray) -> bytes:
    """A bitmap with a power of two of bits, at least one per member."""
    bits = max(LEAST_BITS, 1 << (len(members) - 1).bit_length()) if len(members) else LEAST_BITS
    flags = np.zeros(bits, dtype=bool)
    flags[(members % np.uint64(bits)).astype(np.int64)] = True
    return np.packbits(flags, bitorder="little").tobytes()


def _folded(signature: bytes, size: int) -> np.ndarray:
    """The bitmap that half (a quarter, ...) as many bits would have given."""
    out = np.frombuffer(signature, dtype=np.uint64)
    return np.bitwise_or.reduce(out.reshape(-1, size // 8), axis=0)


def _describe(n: int, num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text")
            for a, b in text_slices(texts):
                sets = shingle_sets(Words(texts.slice(a, b - a), lower=True), n)
                digest = [int(np.bitwise_xor.reduce(mix(s * np.uint64(0xD6E8FEB86659FD93)))) ^ len(s) for s in sets]
                ids = np.array(digest, dtype=np.uint64).view(np.int64)
                keys = [part_keys(s, num, den) if len(s) else np.zeros(0, dtype=np.uint64) for s in sets]
                ends = np.concatenate([[0], np.cumsum([len(k) for k in keys])]).astype(np.int32)
                flat = np.concatenate(keys) if keys else np.zeros(0, dtype=np.uint64)
                sizes = pa.array([len(s) for s in sets], pa.int64())
                columns = [batch.column("id").slice(a, b - a), batch.column("row_id").slice(a, b - a), sizes, pa.array(ids), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.view(np.int64)))]
                marks = pa.array([_signature(s) for s in sets], pa.binary())
                yield pa.RecordBatch.from_arrays([*columns, marks], ["id", "row_id", "n_shingles", "set_id", "keys", "signature"])

    return run


def _bound(signature: np.ndarray, sizes: np.ndarray, i: int, others: np.ndarray, num: int, den: int) -> np.ndarray:
    """Those of ``others`` whose signature leaves a similarity of num/den with set ``i`` possible."""
    differ = np.bitwise_count(signature[others] ^ signature[i]).sum(axis=1, dtype=np.int64)
    return others[differ * (den + num) <= (den - num) * (sizes[others] + sizes[i])]


def possible_links(sizes: np.ndarray, signatures: list[bytes], tile: np.ndarray, num: int, den: int) -> list[tuple[int, int]]:
    """A spanning forest of the pairs that size and signature do not rule out."""
    order = np.argsort(sizes, kind="stable")
    sizes, tile = sizes[order], tile[order]
    width = min(map(len, signatures))
    signature = np.stack([_folded(signatures[i], width) for i in order])
    label, out = np.arange(len(sizes)), []
    mixed = tile.min() != tile.max()
    for i in range(len(sizes) - 1):
        others = np.arange(i + 1, int(np.searchsorted(sizes, sizes[i] * den // num, side="right")))
        others = others[label[others] != label[i]]
        if mixed:
            others = others[tile[others] != tile[i]]
        near = _bound(signature, sizes, i, others, num, den)
        if len(near):
            _, one = np.unique(label[near], return_index=True)
            out += [(int(order[i]), int(order[j])) for j in near[one]]
            label[np.isin(label, label[near])] = label[i]
    return out


def links_in_tile(sets: list[np.ndarray], tile: np.ndarray, num: int, den: int) -> list[tuple[int, int]]:
    """Links that connect all linked sets of this tile pair; within one tile all pairs count, across two only mixed ones."""
    order = np.array(sorted(range(len(sets)), key=lambda i: len(sets[i])))
    sets, tile = [sets[i] for i in order], tile[order]
    sizes = np.array([len(s) for s in sets])
    bits = np.zeros((len(sets), BITS), dtype=bool)
    bits[np.repeat(np.arange(len(sets)), sizes), np.concatenate(sets) % np.uint64(BITS)] = True
    signature = np.packbits(bits, axis=1).view(np.uint64)
    mixed = len(np.unique(tile)) > 1
    label, out = np.arange(len(sets)), []
    for i in range(len(sets) - 1):
        stop = int(np.searchsorted(sizes, sizes[i] * den // num, side="right"))
        others = np.arange(i + 1, stop)
        others = others[label[others] != label[i]]
        if mixed:
            others = others[tile[others] != tile[i]]
        if not len(others):
            continue
        for j in _bound(signature, sizes, i, others, num, den):
            if label[j] == label[i]:
                continue
            at = np.minimum(np.searchsorted(sets[j], sets[i]), sizes[j] - 1)
            both = int((sets[j][at] == sets[i]).sum())
            if den * both >= num * (sizes[i] + sizes[j] - both):
                label[label == label[j]] = label[i]
                out.append((int(order[i]), int(order[j])))
    return out


def _by_group(keys: tuple[str, ...], values: tuple[str, ...], finish):
    """Batches sorted by ``keys`` to the links that ``finish`` finds among the rows of each key; one key is held at a time."""

    def emit(links: list[tuple[int, int]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], ["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows = None, []
        for batch in batches:
            links = []
            for got in zip(*(batch.column(c).to_pylist() for c in (*keys, *values)), strict=True):
                if got[: len(keys)] != key:
                    links += finish(rows) if len(rows) > 1 else []
                    key, rows = got[: len(keys)], []
                rows.append(got[len(keys) :])
            yield emit(links)
        yield emit(finish(rows) if len(rows) > 1 else [])

    return run


def _possible(num: int, den: int):
    def finish(rows: list[tuple]) -> list[tuple[int, int]]:
        found = possible_links(np.array([r[2] for r in rows]), [r[3] for r in rows], np.array([r[1] for r in rows]), num, den)
        return [(rows[i][0], rows[j][0]) for i, j in found]

    return _by_group(("part", "a", "b"), ("row", "tile", "size", "signature"), finish)


def _compare(n: int, num: int, den: int):
    def finish(rows: list[tuple]) -> list[tuple[int, int]]:
        rows = list({r[0]: r for r in rows}.values())  # one text per set, should its row be repeated
        sets = []
        texts = pa.array([r[2] for r in rows], pa.string())
        for a, b in text_slices(texts):
            sets += shingle_sets(Words(texts.slice(a, b - a), lower=True), n)
        return [(rows[i][0], rows[j][0]) for i, j in links_in_tile(sets, np.array([r[1] for r in rows]), num, den)]

    return _by_group(("cluster", "a", "b"), ("row", "tile", "text"), finish)


def _tiles(df: DataFrame, key: str, width: int) -> DataFrame:
    """Rows with ``tiles``, the number of their key's tiles, dealt to every pair of tiles that theirs takes part in."""
    placed = df.withColumn("tile", F.expr("cast(pmod(xxhash64(row, 7), tiles) AS int)")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    paired = placed.withColumns({"a": F.least("tile", "other"), "b": F.greatest("tile", "other")}).drop("other", "tiles")
    return paired.repartition(width, key, "a", "b").sortWithinPartitions(key, "a", "b")


def jaccard_components(docs: DataFrame, key: str = "doc_id", text: str = "text", n: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """``(key, n_shingles, component_id)``, one row per input row; texts link when similarity is num/den or more."""
    width = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    source = docs.select(F.col(key).alias("id"), F.col(text).alias("text")).withColumn("row_id", row_key("id", "text"))
    schema = f"id {dict(docs.dtypes)[key]}, row_id long, n_shingles long, set_id long, keys array<long>, signature binary"
    described = stage(source.mapInArrow(_describe(n, num, den), schema).withColumn("row", F.monotonically_increasing_id()), "described")
    rows = stage(described.select("id", "row_id", "n_shingles", "set_id", "row"), "rows")
    full = rows.where("n_shingles > 0")
    sets = stage(full.groupBy("set_id").agg(F.min("id").alias("least"), F.min("row").alias("row"), F.first("n_shingles").alias("size")), "sets")
    keyed = stage(described.select("row", "keys", "signature").join(sets.select("row", "size"), "row"), "keyed")
    discard(described)

    parts = keyed.select("row", F.explode("keys").alias("part"))
    shared = parts.groupBy("part").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    holders = stage(parts.join(shared, "part"), "holders")
    alike = holders.groupBy("part", "n").agg(F.bit_xor(F.xxhash64("row")).alias("print"))
    once = alike.groupBy("n", "print").agg(F.min("part").alias("part")).select("part")
    signed = holders.join(once, "part").withColumn("tiles", F.ceil(F.col("n") / TILE_ROWS).cast("int")).join(keyed.select("row", "size", "signature"), "row")
    near = stage(_tiles(signed.drop("n"), "part", width).mapInArrow(_possible(num, den), "u long, v long"), "near")
    discard(holders, keyed)
    clusters = stage(connected_components(near).withColumnRenamed("node", "row"), "clusters")

    members = clusters.join(sets.select("row", "size"), "row").join(full.select("row", "row_id"), "row")
    weight = members.groupBy("component").agg(F.greatest(F.ceil(F.count(F.lit(1)) / TILE_ROWS), F.ceil(F.sum("size") / TILE_SHINGLES)).cast("int").alias("tiles"))
    placed = members.join(weight, "component").select("row_id", "row", F.col("component").alias("cluster"), "tiles")
    texts = source.select("row_id", "text")
    if not rows.groupBy("row_id").count().where("count > 1").isEmpty():
        texts = texts.dropDuplicates(["row_id"])
    tiles = _tiles(placed.join(texts, "row_id").drop("row_id"), "cluster", width)
    links = connected_components(stage(tiles.mapInArrow(_compare(n, num, den), "u long, v long"), "links"))
    rooted = sets.join(links.withColumnRenamed("node", "row"), "row", "left").select("set_id", "least", F.coalesce("component", "row").alias("root"))
    names = rooted.join(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("set_id", "component_id")
    linked = full.join(names, "set_id").select("id", "n_shingles", F.coalesce("component_id", "id").alias("component_id"))
    lone = rows.where("n_shingles = 0").select("id", "n_shingles", F.col("id").alias("component_id"))
    return linked.union(lone).withColumnRenamed("id", key)
