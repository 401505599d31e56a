"""Embedding near-dedup: link vectors of one label whose cosine reaches a threshold; one representative per group stays.

Method: spherical k-means assigns vectors to cells, blocked cosine products compare within cells.

1. Equal vectors of a label become one vector with a multiplicity, however many there are.
2. Centres come from spherical k-means on at most ``SAMPLE`` vectors chosen by hash (only the centres depend on it).
3. A vector lives in its nearest centre's cell and also visits every cell in which a partner could live. That test is exact:
   a partner y within the angle of x can be nearer to centre j than to x's own centre h only if
   ``x·c_h - x·c_j <= |c_h - c_j| sin(angle)``. Hence every vector meets all its partners in its own cell.
4. Cells are cut in blocks of bounded size, residents against all others, one task per pair of blocks. Cosines are double
   precision. A task returns a count per resident and a spanning forest of its links, never the pairs.

Vectors that are null, empty, all zero, or hold null or non-finite components, and vectors without a label, link with
nothing. Vectors of different length never link. Repeated rows and repeated ids are separate vectors. ``component_id`` is
the smallest id of the group; null ids only name a group that has no other.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from benchweave.llm.components import connected_components
from benchweave.llm.staging import stage

SAMPLE = 8192
PER_CELL = 8192
MOST_CELLS = 512
BLOCK = 1024


def spherical_kmeans(x: np.ndarray, cells: int, rounds: int = 12) -> np.ndarray:
    """Unit centres; the first ones are spread over the (hash-ordered) sample."""
    centres = x[np.linspace(0, len(x) - 1, cells).astype(int)].copy()
    for _ in range(rounds):
        home = np.argmax(x @ centres.T, axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, home, x)
        size = np.linalg.norm(sums, axis=1)
        centres[size > 0] = sums[size > 0] / size[size > 0, None]
    return centres


def _unit(values: list) -> np.ndarray:
    x = np.array(values, dtype=np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)  # squares of very small or large components stay in range
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _place(centres: dict[int, np.ndarray], threshold: float):
    sine = math.sqrt(max(0.0, 1 - threshold**2))
    gaps = {d: np.linalg.norm(c[:, None] - c[None], axis=2) for d, c in centres.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column("vector").to_pylist()
            sizes = np.array([len(v) for v in vectors])
            for d in np.unique(sizes):
                at = np.flatnonzero(sizes == d)
                c = centres.get(int(d))
                if c is None:
                    home, cell, row = np.ones(len(at), dtype=bool), np.zeros(len(at), dtype=np.int64), at
                else:
                    near = _unit([vectors[i] for i in at]) @ c.T
                    own = np.argmax(near, axis=1)
                    best = near[np.arange(len(at)), own]
                    k, cell = np.nonzero(best[:, None] - near <= gaps[int(d)][own] * sine + 1e-9)
                    home, row = own[k] == cell, at[k]
                taken = batch.take(pa.array(row))
                yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(cell.astype(np.int32)), pa.array(home)], [*taken.schema.names, "cell", "home"])

    return run


def _forest(match: np.ndarray) -> np.ndarray:
    """For a residents x others matrix of links, a component label for all residents and then all others."""
    n = len(match)
    mine, theirs = np.arange(n), np.full(match.shape[1], n)
    while True:
        theirs = np.minimum(theirs, np.where(match, mine[:, None], n).min(axis=0, initial=n))
        now = np.minimum(mine, np.where(match, theirs[None], n).min(axis=1, initial=n))
        if (now == mine).all():
            return np.concatenate([mine, theirs])
        mine = now


def _multiply(threshold: float):
    names = ("label", "size", "cell", "resident_block", "other_block", "resident", "uid", "copies", "vector")

    def finish(rows: list[tuple]) -> list[tuple]:
        residents, others = [r for r in rows if r[0]], [r for r in rows if not r[0]]
        if not residents or not others:
            return []
        x, y = _unit([r[3] for r in residents]), _unit([r[3] for r in others])
        ids, other_ids = np.array([r[1] for r in residents]), np.array([r[1] for r in others])
        match = (x @ y.T >= threshold) & (ids[:, None] != other_ids[None])
        links = match @ np.array([r[2] for r in others], dtype=np.int64)
        if not links.any():
            return []
        root = _forest(match)
        out = [(int(u), int(k), int(ids[r])) for u, k, r in zip(ids, links, root, strict=False) if k]
        return out + [(int(u), 0, int(ids[r])) for u, r in zip(other_ids, root[len(ids) :], strict=True) if r < len(ids)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def emit(out):
            return pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], pa.int64()) for k in range(3)], ["u", "links", "v"])

        key, rows = None, []
        for batch in batches:
            out = []
            for r in zip(*(batch.column(n).to_pylist() for n in names), strict=True):
                if r[:5] != key:
                    out += finish(rows)
                    key, rows = r[:5], []
                rows.append(r[5:])
            yield emit(out)
        yield emit(finish(rows))

    return run


def near_duplicates(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", threshold: float = 0.98) -> DataFrame:
    """``(key, n_links, component_id, kept)``, one row per input row."""
    rows = vectors.select(F.col(key).alias("id"), F.col(label).alias("label"), F.col(vector).alias("vector"))
    # A null component or vector makes the test null, and null counts as false.
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    fit = F.coalesce(finite & F.exists("vector", lambda x: x != 0) & F.col("label").isNotNull(), F.lit(False))
    keyed = rows.withColumn("uid", F.when(fit, F.xxhash64(F.size("vector"), "label", "vector")))
    valid = keyed.where("uid is not null")
    distinct = stage(valid.groupBy("uid").agg(F.count(F.lit(1)).alias("copies"), F.min("id").alias("least"), F.first("label").alias("label"), F.first("vector").alias("vector")).withColumn("size", F.size("vector")), "vectors")

    centres = {}
    for size, n in sorted((r["size"], r["count"]) for r in distinct.groupBy("size").count().collect()):
        sample = distinct.where(F.col("size") == size).orderBy("uid").limit(SAMPLE).select("vector").collect()
        cells = min(MOST_CELLS, math.ceil(n / PER_CELL), len(sample))
        centres[size] = spherical_kmeans(_unit([r["vector"] for r in sample]), cells)

    schema = f"uid long, copies long, label {dict(rows.dtypes)['label']}, vector {dict(rows.dtypes)['vector']}, size int, cell int, home boolean"
    placed = stage(distinct.select("uid", "copies", "label", "vector", "size").mapInArrow(_place(centres, threshold), schema), "placed")
    where = ["label", "size", "cell"]
    blocks = placed.groupBy(*where).agg(F.ceil(F.sum(F.col("home").cast("int")) / BLOCK).cast("int").alias("nb"), F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("no")).where("nb > 0")
    met = placed.join(blocks, where)
    own, other = F.expr("cast(pmod(xxhash64(uid, 1), nb) AS int)"), F.expr("cast(pmod(xxhash64(uid, 2), no) AS int)")
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    residents = met.where("home").select(*where, own.alias("resident_block"), spread("no").alias("other_block"), F.lit(True).alias("resident"), "uid", "copies", "vector")
    others = met.select(*where, spread("nb").alias("resident_block"), other.alias("other_block"), F.lit(False).alias("resident"), "uid", "copies", "vector")
    keys = [*where, "resident_block", "other_block"]
    width = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pairs = residents.union(others).repartition(width, *keys).sortWithinPartitions(*keys)
    found = stage(pairs.mapInArrow(_multiply(threshold), "u long, links long, v long"), "links")

    counts = found.groupBy("u").agg(F.sum("links").alias("links")).withColumnRenamed("u", "uid")
    groups = connected_components(found.select("u", "v")).withColumnRenamed("node", "uid")
    named = distinct.select("uid", "copies", "least").join(groups, "uid", "left").withColumn("root", F.coalesce("component", "uid"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    result = named.join(least, "root").join(counts, "uid", "left").select("uid", "component_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    linked = valid.select("id", "uid").join(result, "uid").select("id", "n_links", F.coalesce("component_id", "id").alias("component_id"))
    lone = keyed.where("uid is null").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    every = linked.union(lone)
    return every.select(F.col("id").alias(key), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))
