"""Substring dedup: remove every word that lies in a window of ``span`` words occurring elsewhere too.

Method: recompression (``recompression.py``) names runs and pairs of words alike in every text. Each window is tied to
the highest-level symbol that its own words fully determine, so equal windows are tied to equal names.

1. Neighbouring windows with one symbol form a region; one row per region carries the name and a digest of the region.
2. Names that occur once cannot lie in a repeat: their windows are done. Others become candidates.
3. Equal regions are repeats as a whole. Where one name has different regions, one region of each kind spells out its
   windows as 128-bit digests, and only those are compared one by one.

Every step is a count with partial aggregation followed by a join that adaptive execution can split, so a passage that
a third of the texts share costs one row per text and symbol. Nothing is capped; names and digests only ever travel
as keys. Digests are 64 bits for regions and 128 bits for single windows; 64-bit word digests underlie both.

Null text has no words. A text shorter than ``span`` words keeps all of them. Repeated rows count as separate texts, so
both lose what they share. Null or repeated ids are harmless, since rows are keyed by their content. Input columns named
like an output are replaced; all others pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from benchweave.llm import recompression
from benchweave.llm.staging import discard, row_key, stage
from benchweave.llm.words import Words, mix, sequence_hashes, text_slices

SPAN = 35
ROUNDS = 7
LOWEST = 2
OUTPUTS = ("n_words", "n_removed", "kept_text")


def _regions(words: Words, span: int, rounds: int):
    """Name, digest, row, first and last window start (word index in the batch) of every region."""
    rows = words.rows()
    at = np.arange(max(0, len(rows) - span + 1))
    windows = at[rows[at] == rows[at + span - 1]] if len(at) else at
    levels = recompression.parse(words.hashes, rows, rounds, span)
    symbol = np.full(len(windows), -1, dtype=np.int64)
    name = np.zeros(len(windows), dtype=np.uint64)
    shift = np.zeros(len(windows), dtype=np.int64)
    todo = np.arange(len(windows))
    for rank, level in enumerate(reversed(levels[LOWEST:])):
        level = level.take(level.hi - level.lo <= span)
        if not len(level.lo) or not len(todo):
            continue
        first = windows[todo]
        i = np.searchsorted(level.lo, first)
        near = np.minimum(i, len(level.lo) - 1)
        fits = (i < len(level.lo)) & (level.hi[near] <= first + span)
        chosen, near = todo[fits], near[fits]
        symbol[chosen] = near * len(levels) + rank
        name[chosen] = level.name[near]
        shift[chosen] = level.start[near]
        todo = todo[~fits]
    # No symbol of any level fits (inside long runs): the window names itself, and equal neighbours are one region.
    name[todo] = mix(sequence_hashes(words.hashes, windows[todo], windows[todo] + span))
    head = np.ones(len(windows), dtype=bool)
    head[1:] = (symbol[1:] != symbol[:-1]) | (name[1:] != name[:-1]) | (np.diff(windows) > 1)
    start = np.flatnonzero(head)
    stop = np.append(start[1:], len(windows))[: len(start)]
    first, last = windows[start], windows[stop - 1] if len(start) else windows[:0]
    body = sequence_hashes(words.hashes, first, last + span)
    body = mix(body + (shift[start] - first).astype(np.uint64) * np.uint64(0x9FB21C651E98DF25) + (last - first).astype(np.uint64))
    region = np.where(symbol[start] < 0, name[start], body)
    return name[start], region, rows[first], first, last


def _region_rows(span: int, rounds: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, keys = batch.column("text"), batch.column("row_id").to_numpy(zero_copy_only=False)
            for a, b in text_slices(texts):
                words = Words(texts.slice(a, b - a))
                name, region, row, first, last = _regions(words, span, rounds)
                base = words.offsets[row]
                columns = [name.view(np.int64), region.view(np.int64), keys[a:b][row], (first - base).astype(np.int32), (last - base).astype(np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["name", "region", "row_id", "first", "last"])

    return run


def _ranges(column: pa.Array, field: str) -> np.ndarray:
    return column.flatten().field(field).to_numpy(zero_copy_only=False).astype(np.int64)


def _window_rows(span: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, keys = batch.column("text"), batch.column("row_id").to_numpy(zero_copy_only=False)
            for a, b in text_slices(texts):
                words, spans = Words(texts.slice(a, b - a)), batch.column("spans").slice(a, b - a)
                sizes = pc.list_value_length(spans).to_numpy(zero_copy_only=False).astype(np.int64)
                row = np.repeat(np.arange(b - a), sizes)
                first, last = _ranges(spans, "first"), _ranges(spans, "last")
                weight = 1 + spans.flatten().field("known").to_numpy(zero_copy_only=False).astype(np.int32)
                length = last - first + 1
                within = np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)
                at = np.repeat(first, length) + within
                whose = np.repeat(row, length)
                start = words.offsets[whose] + at
                columns = [sequence_hashes(words.hashes, start, start + span).view(np.int64), sequence_hashes(words.second, start, start + span, 1).view(np.int64), keys[a:b][whose], at.astype(np.int32), np.repeat(weight, length)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["h1", "h2", "row_id", "first", "weight"])

    return run


def _without(words: Words, removed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The kept words of every text joined by one space: bytes and offsets."""
    keep = ~removed
    marks = np.zeros(len(words.data) + 1, dtype=np.int32)
    np.add.at(marks, words.starts[keep], 1)
    np.add.at(marks, words.ends[keep] + 1, -1)  # a kept word takes the separator after it along
    mask = np.cumsum(marks[:-1], dtype=np.int32) > 0
    data = words.data.copy()
    data[words.ends] = 32
    size = (words.ends - words.starts + 1) * keep
    total = np.concatenate([[0], np.cumsum(size)])
    ends = total[words.offsets]
    flat = data[mask]
    has = np.diff(ends) > 0
    strip = ends[1:][has] - 1  # the last separator of every text that keeps words
    solid = np.ones(len(flat), dtype=bool)
    solid[strip] = False
    offsets = ends - np.concatenate([[0], np.cumsum(has)])
    return flat[solid], offsets


def _keep_words(span: int, schema: pa.Schema, text: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(text)
            for a, b in text_slices(texts):
                words, spans = Words(texts.slice(a, b - a)), batch.column("__spans").slice(a, b - a)
                sizes = pc.list_value_length(spans).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
                row = np.repeat(np.arange(b - a), sizes)
                edge = np.zeros(len(words.hashes) + 1, dtype=np.int64)
                np.add.at(edge, words.offsets[row] + _ranges(spans, "first"), 1)
                np.add.at(edge, words.offsets[row] + _ranges(spans, "last") + span, -1)
                removed = np.cumsum(edge[:-1]) > 0
                flat, offsets = _without(words, removed)
                kept = pa.LargeStringArray.from_buffers(b - a, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(flat.tobytes())).cast(pa.string())
                gone = np.concatenate([[0], np.cumsum(removed)])[words.offsets]
                own = [batch.column(n).slice(a, b - a) for n in batch.schema.names if n not in ("__spans", "__row_id")]
                yield pa.RecordBatch.from_arrays([*own, pa.array(words.counts), pa.array(np.diff(gone)), kept], [*[n for n in batch.schema.names if n not in ("__spans", "__row_id")], *OUTPUTS])

    return run


def repeated_spans(docs: DataFrame, text: str = "text", key: str = "row_id", span: int = SPAN, rounds: int = ROUNDS) -> DataFrame:
    """``(key, first, last)``: ranges of window starts, counted in words of the row, whose windows occur elsewhere too."""
    source = docs.select(F.col(key).alias("row_id"), F.col(text).alias("text"))
    regions = stage(source.mapInArrow(_region_rows(span, rounds), "name long, region long, row_id long, first int, last int"), "regions")
    weight = F.sum(F.when(F.col("name") == F.col("region"), F.col("last") - F.col("first") + 1).otherwise(1))
    shared = regions.groupBy("name").agg(weight.alias("n")).where("n > 1").select("name")
    candidates = stage(regions.join(shared, "name"), "candidates")
    discard(regions)
    kinds = candidates.groupBy("name", "region").agg(weight.alias("copies"), F.min(F.struct("row_id", "first")).alias("head"))
    variants = kinds.groupBy("name").agg(F.count(F.lit(1)).alias("variants"))
    judged = candidates.join(kinds.join(variants, "name"), ["name", "region"])
    known = F.col("copies") > 1
    opens = (F.col("variants") > 1) & (~known | (F.struct("row_id", "first") == F.col("head")))
    spans = stage(judged.select("row_id", "first", "last", known.alias("known"), opens.alias("opens")).distinct(), "spans")
    discard(candidates)
    open_rows = spans.where("opens").groupBy("row_id").agg(F.collect_list(F.struct("first", "last", "known")).alias("spans"))
    spelled = source.join(open_rows, "row_id").mapInArrow(_window_rows(span), "h1 long, h2 long, row_id long, first int, weight int")
    windows = stage(spelled, "windows")
    twice = windows.groupBy("h1", "h2").agg(F.sum("weight").alias("n")).where("n > 1").select("h1", "h2")
    single = windows.where("weight = 1").join(twice, ["h1", "h2"]).select("row_id", "first", F.col("first").alias("last"))
    found = spans.where("known").select("row_id", "first", "last").union(single).distinct()
    found = stage(found, "found")
    discard(spans, windows)
    return found.select(F.col("row_id").alias(key), "first", "last")


def remove_repeats(docs: DataFrame, text: str = "text", span: int = SPAN, rounds: int = ROUNDS) -> DataFrame:
    """``docs`` with ``n_words``, ``n_removed`` (long) and ``kept_text``: the kept words joined by single spaces."""
    base = docs.drop(*OUTPUTS, "__row_id", "__spans")
    keyed = base.withColumn("__row_id", row_key(*[c for c, kind in base.dtypes if not kind.startswith(("map", "variant"))]))
    found = repeated_spans(keyed, text, "__row_id", span, rounds)
    lists = found.groupBy("__row_id").agg(F.collect_list(F.struct("first", "last")).alias("__spans"))
    joined = keyed.join(lists, "__row_id", "left")
    fields = [*base.schema.fields, T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_text", T.StringType())]
    return joined.mapInArrow(_keep_words(span, None, text), T.StructType([T.StructField(f.name, f.dataType) for f in fields]))
