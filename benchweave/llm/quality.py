"""Quality classifier: logistic regression on hashed word n-grams, trained by follow-the-regularised-leader updates.

Features are hashed n-grams of two word sequences: the words in lower case (one and two words) and their shapes (one to
three): case, digits, punctuation, length class, and whether the word repeats the one before. A text's value for a
feature is its share of the text's n-grams of that kind, so a score is one sparse dot product, gathered and summed per text.

At most ``SAMPLE`` labelled rows train the model, chosen by a hash at a rate taken from the counted labels. They are dealt
to ``SHARDS`` groups by a hash of the text; each group runs FTRL-proximal on its own and the weights are averaged in Spark.
At most ``SLOTS`` weights exist, which bounds what is collected and broadcast.

Null text is empty; an empty text's score is the model's bias. Labels that are null or without a text are ignored; without
any label every score is 0.5. Repeated rows get equal scores. Columns named like an output are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from benchweave.llm.words import Words, mix, range_hashes, text_slices

SLOTS = 1 << 17
SAMPLE = 8_000
SHARDS = 4
ALPHA, BETA, L1, L2, EPOCHS = 2.0, 1.0, 0.002, 0.001, 4

_CLASS = np.zeros(256, dtype=np.int64)  # other bytes: letters beyond ASCII
_CLASS[33:127] = 3
_CLASS[48:58] = 2
_CLASS[65:91] = 1
_CLASS[97:123] = 0


def _shapes(words: Words) -> np.ndarray:
    """A code per word, from counts of byte classes inside it and its last byte."""
    if not len(words.starts):
        return np.zeros(0, dtype=np.uint64)
    marks = np.empty(2 * len(words.starts), dtype=np.int64)
    marks[::2], marks[1::2] = words.starts, words.ends
    size = words.ends - words.starts
    kinds = _CLASS[words.data]
    count = [np.add.reduceat((kinds == k).astype(np.int32), marks)[::2] for k in (1, 2, 3)]
    last, first = words.data[words.ends - 1], words.data[words.starts]
    code = np.minimum(count[0], 2) + 3 * np.minimum(count[1], 2) + 9 * np.minimum(count[2], 3) + 36 * (kinds[words.starts] == 1)
    code = code * 8 + np.minimum(np.log2(size).astype(np.int64), 7)
    code = code * 256 + np.where(_CLASS[last] == 3, last, 0)
    code = code * 2 + (_CLASS[first] == 3)
    return mix(code.astype(np.uint64))


def features(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, slot and value of every n-gram."""
    lowered = mix(words.hashes)
    shape = _shapes(words)
    row = words.rows()
    same = np.zeros(len(row), dtype=bool)
    same[1:] = (words.hashes[1:] == words.hashes[:-1]) & (row[1:] == row[:-1])
    shape = np.where(same, shape ^ np.uint64(0x5555), shape)
    rows, slots, values = [], [], []
    for kind, (sequence, n) in enumerate([(lowered, 1), (lowered, 2), (shape, 1), (shape, 2), (shape, 3)]):
        at = np.arange(max(0, len(row) - n + 1))
        at = at[row[at] == row[at + n - 1]] if n > 1 else at
        slots.append(((range_hashes(mix(sequence ^ np.uint64(kind)), at, at + n)) % np.uint64(SLOTS)).astype(np.int64))
        rows.append(row[at])
        share = 1 / np.maximum(1, words.counts - n + 1)
        values.append(share[row[at]])
    return np.concatenate(rows), np.concatenate(slots), np.concatenate(values)


def ftrl(texts: list[str], labels: np.ndarray, epochs: int = EPOCHS) -> np.ndarray:
    """Weights of the slots and, last, of the bias."""
    z, n = np.zeros(SLOTS + 1), np.zeros(SLOTS + 1)
    examples = []
    for text in texts:
        _, slot, value = features(Words(pa.array([text], pa.string())))
        own, inverse = np.unique(slot, return_inverse=True)
        examples.append((np.append(own, SLOTS), np.append(np.bincount(inverse, weights=value, minlength=len(own)), 1.0)))

    def weights(slot):
        zs = z[slot]
        w = -(zs - np.sign(zs) * L1) / ((BETA + np.sqrt(n[slot])) / ALPHA + L2)
        return np.where(np.abs(zs) <= L1, 0.0, w)

    for _ in range(epochs):
        for (slot, value), y in zip(examples, labels, strict=True):
            w = weights(slot)
            p = 1 / (1 + np.exp(-np.clip(w @ value, -35, 35)))
            g = (p - y) * value
            sigma = (np.sqrt(n[slot] + g * g) - np.sqrt(n[slot])) / ALPHA
            z[slot] += g - sigma * w
            n[slot] += g * g
    return weights(np.arange(SLOTS + 1))


def train(labelled: DataFrame, text: str = "text", label: str = "label") -> np.ndarray:
    """Averaged weights from at most about ``SAMPLE`` rows of ``labelled`` (0 or 1); bound the input before calling."""

    def shard(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("draw", kind="stable")
        w = ftrl(pdf["text"].tolist(), pdf["label"].to_numpy(dtype=float))
        slot = np.flatnonzero(w)
        return pd.DataFrame({"slot": slot, "weight": w[slot]})

    rows = labelled.select(F.coalesce(F.col(text), F.lit("")).alias("text"), F.col(label).cast("double").alias("label"))
    dealt = rows.withColumn("draw", F.xxhash64(F.lit(3), "text")).withColumn("shard", F.pmod("draw", F.lit(SHARDS)))
    parts = dealt.groupBy("shard").applyInPandas(shard, "slot long, weight double")
    out = np.zeros(SLOTS + 1)
    for r in parts.groupBy("slot").agg((F.sum("weight") / SHARDS).alias("weight")).collect():
        out[r["slot"]] = r["weight"]
    return out


def draw_labelled(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", sample: int = SAMPLE) -> DataFrame:
    """``(text, label)`` of at most ``sample`` labelled rows, drawn by a hash of the key."""
    fit = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull()).select(key, F.col(label).alias("label")).distinct()
    drawn = fit.orderBy(F.xxhash64(F.lit(11), key), "label").limit(sample)
    return docs.select(key, text).join(F.broadcast(drawn), key).select(text, "label").limit(2 * sample)


def score(docs: DataFrame, weights: np.ndarray, text: str = "text", output: str = "score") -> DataFrame:
    base = docs.drop(output)
    at = base.columns.index(text)
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        for batch in batches:
            for a, b in text_slices(batch.column(at)):
                part = batch.slice(a, b - a)
                row, slot, value = features(Words(part.column(at)))
                z = w[SLOTS] + np.bincount(row, weights=w[slot] * value, minlength=b - a)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(1 / (1 + np.exp(-np.clip(z, -35, 35))))], [*part.schema.names, output])

    return base.mapInArrow(run, T.StructType([*base.schema.fields, T.StructField(output, T.DoubleType())]))
