"""Hard-negative mining by inner products over STR-packed R-trees.

Method: sort-tile-recursive packing, minimum bounding boxes, best-first search.

1. Rows are range-partitioned by (vector length, label, slab of one coordinate, a second coordinate), which is the upper
   level of the packing; the labels take part as one more coordinate. Each partition becomes trees of at most ``GROUP``
   rows, packed by the coordinates that vary most in them, with boxes of minimum and maximum per coordinate and label.
2. A box gives an interval for the inner product with an anchor, coordinate by coordinate. The search takes boxes from a
   queue by their upper ends. It leaves out boxes of the wrong labels, boxes outside the score window, and boxes strictly
   below the k-th best score so far; equal scores are visited, as ids decide between them.
3. Anchors visit trees in waves. Every wave covers about 16 times as many trees as those before it, and its k-th scores
   are the bounds of the next, so that trees far from an anchor return few rows. Results are exact: every tree is either
   searched or excluded by its boxes.

Only the choice of the packing coordinates and slab borders uses a sample (``SAMPLE`` rows chosen by hash); all rows are
indexed and the result does not depend on it. Scores are exact integers; they must fit a long.

Rows with a null id, label, vector or component, or a non-finite component, take no part; so do rows that an anchor flag
leaves null. Vectors of different length never meet. Rows that are repeated in full count once; rows that share an id are
never partners of each other. Ties go to the smaller id. An empty table, or one without anchors, gives an empty result.
Other columns are ignored.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from benchweave.llm.staging import discard, pieces_for, stage

SAMPLE = 8192
GROUP = 32_768
LEAF = 128
FANOUT = 16
ANCHORS_PER_TASK = 8192
MOST_SLABS = 256
_TREE = ["group", "size", "ids", "labels", "vectors", "wide"]
_QUERY = ["anchor", "uid", "label", "vector", "windows"]


def _tiles(x: np.ndarray, rows: np.ndarray, axes: list[int], pages: int) -> list[np.ndarray]:
    """Sort-tile-recursive: sort by the first axis, cut into even slabs, and go on in each with the next axis."""
    if pages <= 1 or not axes:
        return [rows]
    slabs = math.ceil(pages ** (1 / len(axes)))
    rows = rows[np.argsort(x[rows, axes[0]], kind="stable")]
    step = math.ceil(pages / slabs)  # pages a slab, so that all but the last are full
    out = []
    for start in range(0, pages, step):
        out += _tiles(x, rows[start * LEAF : (start + step) * LEAF], axes[1:], min(step, pages - start))
    return out


def packing_order(x: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """The order of rows in which each run of ``LEAF`` rows is one page: by label, then tiles of the widest coordinates."""
    rows = np.argsort(labels, kind="stable")
    axes = np.argsort(-x.var(axis=0), kind="stable")[:3].tolist()
    out = []
    for run in np.split(rows, np.flatnonzero(np.diff(labels[rows])) + 1):
        out += _tiles(x, run, axes, math.ceil(len(run) / LEAF))
    return np.concatenate(out)


def page_cuts(labels: np.ndarray) -> np.ndarray:
    """Where pages begin: after ``LEAF`` rows, and at a new label once a page is half full."""
    cuts, start = [0], 0
    for end in [*(np.flatnonzero(np.diff(labels)) + 1).tolist(), len(labels)]:
        while end - start > LEAF:
            start += LEAF
            cuts.append(start)
        if end < len(labels) and end - start >= LEAF / 2:
            start = end
            cuts.append(start)
    return np.array(cuts)


class Tree:
    """A packed tree: rows in page order and the boxes of all levels, the root last."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, x: np.ndarray):
        self.ids, self.labels, self.x = ids, labels, x
        self.most = max(int(x.max(initial=0)), -int(x.min(initial=0)))
        cuts = page_cuts(labels)
        self.pages = list(zip(cuts.tolist(), [*cuts[1:].tolist(), len(ids)], strict=True))
        level = [np.minimum.reduceat(x, cuts), np.maximum.reduceat(x, cuts), np.minimum.reduceat(labels, cuts), np.maximum.reduceat(labels, cuts)]
        self.levels = [level]
        while len(level[0]) > 1:
            cuts = np.arange(0, len(level[0]), FANOUT)
            level = [f.reduceat(v, cuts) for f, v in zip((np.minimum, np.maximum) * 2, level, strict=True)]
            self.levels.append(level)
        self.as_type: dict[str, tuple] = {}

    def typed(self, kind: str) -> tuple:
        """Rows and boxes in a number type whose products with the anchor are exact."""
        if kind not in self.as_type:
            self.as_type[kind] = (self.x.astype(kind), [(lv[0].astype(kind), lv[1].astype(kind)) for lv in self.levels])
        return self.as_type[kind]

    def search(self, own_id: int, label: int, q: np.ndarray, windows: list[dict], same: bool, k: int) -> list[tuple[int, int, int]]:
        """For each window its best ``k`` rows as (window key, score, id), unless known rows of other trees are better.

        A window has ``low`` and ``high`` (inclusive, None is open) and the k-th best row known so far, ``score`` and
        ``id`` (None while there are fewer than k).
        """
        bound = self.most * max(int(q.max(initial=0)), -int(q.min(initial=0))) * max(len(q), 1)
        kind = "float64" if bound < 1 << 53 else "int64" if bound < 1 << 62 else "object"
        x, boxes = self.typed(kind)
        q = q.astype(kind)
        up, down = np.maximum(q, 0), np.minimum(q, 0)
        best: list[list[tuple[int, int]]] = [[] for _ in windows]  # heaps of (score, -id), worst first
        floors = [max([v for v in (w["low"], w["score"]) if v is not None], default=-math.inf) for w in windows]
        highs = [math.inf if w["high"] is None else w["high"] for w in windows]
        top = len(self.levels) - 1
        heap: list[tuple] = []

        def push(level: int, a: int, b: int) -> None:
            lo, hi = boxes[level]
            first, last = self.levels[level][2][a:b], self.levels[level][3][a:b]
            fit = (first <= label) & (label <= last) if same else (first != label) | (last != label)
            upper, lower = hi[a:b] @ up + lo[a:b] @ down, lo[a:b] @ up + hi[a:b] @ down
            for i in np.flatnonzero(fit & (upper >= min(floors)) & (lower <= max(highs))).tolist():
                heapq.heappush(heap, (-upper[i], level, a + i, lower[i]))

        push(top, 0, len(self.levels[top][0]))
        while heap:
            upper, level, node, lower = heapq.heappop(heap)
            upper = -upper
            if upper < min(floors):
                break
            if not any(lower <= high and min(upper, high) >= floor for high, floor in zip(highs, floors, strict=True)):
                continue
            if level:
                push(level - 1, node * FANOUT, min((node + 1) * FANOUT, len(self.levels[level - 1][0])))
                continue
            at = slice(*self.pages[node])
            scores = x[at] @ q
            fit = (self.labels[at] == label) if same else (self.labels[at] != label)
            fit = fit & (self.ids[at] != own_id) & (scores >= min(floors)) & (scores <= max(highs))
            for i in np.flatnonzero(fit).tolist():
                score, other = int(scores[i]), int(self.ids[at][i])
                for j, window in enumerate(windows):
                    if not floors[j] <= score <= highs[j]:
                        continue
                    if window["score"] is not None and (score, -other) <= (window["score"], -window["id"]):
                        continue
                    entry = (score, -other)
                    if len(best[j]) < k:
                        heapq.heappush(best[j], entry)
                    elif entry > best[j][0]:
                        heapq.heapreplace(best[j], entry)
                    if len(best[j]) == k:
                        floors[j] = max(floors[j], best[j][0][0])
        return [(window["key"], score, -other) for window, own in zip(windows, best, strict=True) for score, other in own]


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One partition's rows, sorted by vector length and label, to trees of at most ``GROUP`` rows of one length."""
    part, made, held = TaskContext.get().partitionId(), 0, []

    def finish() -> pa.RecordBatch:
        nonlocal made, held
        ids, labels, flags = (np.concatenate([h[i] for h in held]) for i in range(3))
        x = np.concatenate([h[3] for h in held])
        order = packing_order(x, labels) if x.shape[1] else np.arange(len(ids))
        wide = bool(x.size) and max(int(x.max()), -int(x.min())) >= 1 << 31
        rows = [
            pa.array([part], pa.int32()),
            pa.array([made], pa.int32()),
            pa.array([x.shape[1]], pa.int32()),
            pa.array([ids[order].astype("<i8").tobytes()]),
            pa.array([labels[order].astype("<i8").tobytes()]),
            pa.array([x[order].astype("<i8" if wide else "<i4").tobytes()]),
            pa.array([wide]),
            pa.array([np.unique(labels).tolist()], pa.list_(pa.int64())),
            pa.array([[{"id": i, "label": label, "vector": v} for i, label, v in zip(ids[flags].tolist(), labels[flags].tolist(), x[flags].tolist(), strict=True)]], _ANCHORS),
        ]
        made, held = made + 1, []
        return pa.RecordBatch.from_arrays(rows, ["part", "piece", "size", "ids", "labels", "vectors", "wide", "distinct_labels", "anchors"])

    for batch in batches:
        sizes = batch.column("size").to_numpy()
        for run in np.split(np.arange(len(sizes)), np.flatnonzero(np.diff(sizes)) + 1):
            start = 0
            while start < len(run):
                if held and (held[0][3].shape[1] != sizes[run[0]] or sum(len(h[0]) for h in held) >= GROUP):
                    yield finish()
                room = GROUP - sum(len(h[0]) for h in held)
                own = batch.slice(int(run[start]), min(room, len(run) - start))
                x = own.column("x").flatten().to_numpy(zero_copy_only=False).reshape(own.num_rows, int(sizes[run[0]]))
                held.append((own.column("id").to_numpy(), own.column("label").to_numpy(), own.column("anchor").to_numpy(zero_copy_only=False).astype(bool), x))
                start += own.num_rows
    if held:
        yield finish()


_ANCHORS = pa.list_(pa.struct([("id", pa.int64()), ("label", pa.int64()), ("vector", pa.list_(pa.int64()))]))
_TREE_SCHEMA = (
    "part int, piece int, size int, ids binary, labels binary, vectors binary, wide boolean, distinct_labels array<long>, anchors array<struct<id:long,label:long,vector:array<long>>>"
)


def _search(same: bool, k: int):
    """Rows come sorted by group and slice, each tree before its anchors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, held = None, None
        for batch in batches:
            out: list[tuple] = []
            groups = list(zip(batch.column("group").to_pylist(), batch.column("slice").to_pylist(), strict=True))
            is_tree = batch.column("anchor").is_null().to_pylist()
            for i, where in enumerate(groups):
                if is_tree[i]:
                    row = {n: batch.column(n)[i].as_py() for n in _TREE}
                    ids, labels = np.frombuffer(row["ids"], dtype="<i8"), np.frombuffer(row["labels"], dtype="<i8")
                    x = np.frombuffer(row["vectors"], dtype="<i8" if row["wide"] else "<i4").astype(np.int64)
                    tree, held = Tree(ids, labels, x.reshape(len(ids), row["size"])), where
                elif where == held:
                    query = {n: batch.column(n)[i].as_py() for n in _QUERY}
                    if len(query["vector"]) == tree.x.shape[1]:
                        found = tree.search(query["anchor"], query["label"], np.array(query["vector"], dtype=np.int64), query["windows"], same, k)
                        out += [(query["anchor"], query["uid"], *f) for f in found]
            yield pa.RecordBatch.from_arrays([pa.array([o[c] for o in out], pa.int64()) for c in range(5)], ["anchor", "uid", "key", "score", "id"])

    return run


def build_trees(points: DataFrame) -> tuple[DataFrame, int]:
    """Stage the packed trees of ``points`` (id, label, x, anchor); with them the number of group numbers in use."""
    sized = points.dropDuplicates(["id", "label", "x"]).withColumn("size", F.size("x")).withColumn("uid", F.xxhash64("id", "label", "x"))
    staged = stage(sized, "negatives-rows")
    totals = staged.agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct("label").alias("labels")).first()
    sample = staged.orderBy("uid").limit(SAMPLE).select("x").toArrow().column("x").to_pylist()
    lengths = [len(v) for v in sample]
    common = max(set(lengths), key=lengths.count) if lengths else 0
    x = np.array([v for v in sample if len(v) == common], dtype=np.float64).reshape(lengths.count(common), common)
    axes = np.argsort(-x.var(axis=0), kind="stable")[:2].tolist() if x.size else []
    parts = pieces_for(totals["n"], GROUP)
    slabs = min(MOST_SLABS, math.ceil(math.sqrt(parts / max(totals["labels"], 1))))
    keys: list[Column] = [F.col("size"), F.col("label")]
    if axes and slabs > 1:
        borders = np.quantile(x[:, axes[0]], np.arange(1, slabs) / slabs).tolist()
        keys.append(F.size(F.filter(F.array(*map(F.lit, borders)), lambda border: border <= F.get("x", F.lit(axes[0])))))
    if axes:
        keys.append(F.get("x", F.lit(axes[-1])))
    ordered = staged.repartitionByRange(parts, *keys, "uid").sortWithinPartitions(*keys, "uid")
    trees = stage(ordered.select("id", "label", "x", "anchor", "size").mapInArrow(_pack, _TREE_SCHEMA), "negatives-trees")
    spread = trees.agg(F.max("part").alias("parts"), F.max("piece").alias("pieces")).first()
    discard(staged)
    if spread["parts"] is None:
        return trees.withColumn("group", F.lit(0).cast("long")), 0
    return trees.withColumn("group", F.col("part").cast("long") * (spread["pieces"] + 1) + F.col("piece")), (spread["parts"] + 1) * (spread["pieces"] + 1)


def _waves(groups: int) -> int:
    return 1 if groups <= 1 else 2 + int(math.log2(groups - 1) // 4)


def _best(trees: DataFrame, groups: int, queries: DataFrame, same: bool, k: int, label: str) -> DataFrame:
    """``(anchor, uid, key, score, id)``: the best ``k`` rows of every window of every anchor, over all trees.

    ``queries`` holds anchor, uid, home (its own tree), label, vector and ``bounds``: structs (key, low, high).
    """
    spark = trees.sparkSession
    slices = pieces_for(queries.count(), ANCHORS_PER_TASK)
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    if same:
        held = trees.select("size", F.explode("distinct_labels").alias("label"), "group")
        met = queries.withColumn("size", F.size("vector")).join(held, ["size", "label"]).drop("size")
        turn = F.when(F.col("group") == F.col("home"), 0).otherwise(F.pmod(F.xxhash64("group", "home"), F.lit(max(groups - 1, 1))) + 1)
    else:
        met = queries.withColumn("group", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))))
        turn = F.pmod(F.xxhash64("group", "home"), F.lit(groups))
    wave = F.when(turn < 1, 0).otherwise(F.least(F.floor(F.log2(turn) / 4) + 1, F.lit(_waves(groups) - 1)))
    slice_of = F.pmod(F.col("uid"), F.lit(slices)).cast("int")
    best = None
    for number in range(_waves(groups)):
        asked = met.where(wave == number)
        asked = asked.select("group", slice_of.alias("slice"), "anchor", "uid", "label", "vector", "bounds")
        none = F.lit(None).cast("long")
        if best is None:
            windows = F.transform("bounds", lambda b: F.struct(b["key"].alias("key"), b["low"].alias("low"), b["high"].alias("high"), none.alias("score"), none.alias("id")))
            asked = asked.withColumn("windows", windows)
        else:
            # The k-th best row so far, where there are k: the lowest score, and among equals the highest id.
            worst = best.groupBy("anchor", "uid", "key").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("score", (-F.col("id")).alias("minus"))).alias("worst")).where(F.col("n") == k)
            known = worst.groupBy("anchor", "uid").agg(F.map_from_entries(F.collect_list(F.struct("key", "worst"))).alias("known"))
            asked = asked.join(known, ["anchor", "uid"], "left")

            def window(b: Column) -> Column:
                kth = F.try_element_at("known", b["key"])
                return F.struct(b["key"].alias("key"), b["low"].alias("low"), b["high"].alias("high"), kth["score"].alias("score"), (-kth["minus"]).alias("id"))

            asked = asked.withColumn("windows", F.transform("bounds", window))
        placed = trees.select(*_TREE).withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))
        rows = placed.unionByName(asked.drop("bounds"), allowMissingColumns=True)
        rows = rows.repartition(width, "group", "slice").sortWithinPartitions("group", "slice", F.col("anchor").asc_nulls_first())
        found = rows.mapInArrow(_search(same, k), "anchor long, uid long, key long, score long, id long")
        every = found if best is None else found.unionByName(best)
        rank = F.row_number().over(Window.partitionBy("anchor", "uid", "key").orderBy(F.desc("score"), "id"))
        before, best = best, stage(every.withColumn("rank", rank).where(F.col("rank") <= k), f"negatives-{label}")
        best = _without_rank(best)
        if before is not None:
            discard(before)
    return best


def _without_rank(ranked: DataFrame) -> DataFrame:
    out = ranked.drop("rank")
    out._staged_at = ranked._staged_at
    return out


def mine(points: DataFrame, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95) -> DataFrame:
    """Hard negatives of the flagged rows of ``points`` (id long, label long, x array<long>, anchor boolean).

    ``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)``: for each anchor its first
    ``positives`` other rows of the same label by score, and for each of these the first ``negatives`` rows of another
    label with ``low * positive_score <= 100 * negative_score <= high * positive_score``.
    """
    usable = points.select("id", "label", "x", "anchor").where("id IS NOT NULL AND label IS NOT NULL AND x IS NOT NULL AND anchor IS NOT NULL AND forall(x, c -> c IS NOT NULL)")
    trees, groups = build_trees(usable)
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if not groups:
        return points.sparkSession.createDataFrame([], schema)
    anchors = trees.select(F.col("group").alias("home"), F.explode("anchors").alias("a")).select("home", F.col("a.id").alias("anchor"), "a.label", "a.vector")
    anchors = stage(anchors.withColumn("uid", F.xxhash64("anchor", "label", "vector")), "negatives-anchors")
    none = F.lit(None).cast("long")
    every = F.array(F.struct(F.lit(0).cast("long").alias("key"), none.alias("low"), none.alias("high")))
    near = _best(trees, groups, anchors.withColumn("bounds", every), True, positives, "positives")
    near = near.select("anchor", "uid", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    # Windows of equal scores are one window. Whole numbers: low*p <= 100*s <= high*p, the ends rounded inwards.
    bounds = near.select("anchor", "uid", F.col("positive_score").alias("key")).distinct()
    least, most = F.expr(f"-floor(-{low} * CAST(key AS DECIMAL(20,0)) / 100)"), F.expr(f"floor({high} * CAST(key AS DECIMAL(20,0)) / 100)")
    bounds = bounds.withColumn("low", least.cast("long")).withColumn("high", most.cast("long")).where("low <= high")
    grouped = bounds.groupBy("anchor", "uid").agg(F.collect_list(F.struct("key", "low", "high")).alias("bounds"))
    asked = stage(anchors.join(grouped, ["anchor", "uid"]), "negatives-windows")
    far = _best(trees, groups, asked, False, negatives, "negatives")
    rank = F.row_number().over(Window.partitionBy("anchor", "uid", "key").orderBy(F.desc("score"), "id"))
    far = far.select("anchor", "uid", F.col("key").alias("positive_score"), rank.alias("rank"), F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    return near.join(far, ["anchor", "uid", "positive_score"]).select(
        F.col("anchor").alias("anchor_id"), "positive_id", "rank", "negative_id", "positive_score", "negative_score"
    )


def quantised(vectors: DataFrame, anchor: Column, label: Column, key: str = "vec_id", vector: str = "embedding", scale: int = 256) -> DataFrame:
    """``points`` for ``mine``: components floor(scale * c), from the vectors whose components are all finite."""
    v = F.col(vector).cast("array<double>")
    finite = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    x = F.transform(v, lambda c: F.floor(c * scale).cast("long"))
    rows = vectors.where(F.coalesce(finite, F.lit(False)))
    return rows.select(F.col(key).cast("long").alias("id"), label.cast("long").alias("label"), x.alias("x"), F.coalesce(anchor, F.lit(False)).alias("anchor"))
