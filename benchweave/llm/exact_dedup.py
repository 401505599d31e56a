"""Exact dedup with DataFrame functions only: of texts equal after blank normalisation, the row with the smallest id stays.

Method: two-pass Bloom filtering. Every row hashes to one 64-bit word of a fixed-size filter and to two bits in it. The
first pass counts hits per bit (partial aggregation, so at most one row per bit and task moves) and keeps the bits that
were hit twice or more. The second pass tests each row against them, map-side: a row with a bit that nobody else hit is
unique and passes straight through; only rows whose two bits were both hit again, that is copies and few false alarms,
are shuffled by digest and counted exactly. The filter has 8 to 16 bits a row at every size. Above ``MAX_BITS`` it is cut
into slices by another hash of the digest; rows are staged by slice and the slices worked off one by one, so at most
``MAX_BITS / 64`` rows of 16 bytes are broadcast at a time and the share of unique rows that shuffle does not grow.

Runs of ``[\\x20\\x09-\\x0D]`` count as one space; null counts as empty text; texts are equal when their SHA-256 is. Among
rows of equal text and equal id one stays; null ids come last. Hot digests are pre-aggregated, and the join back to the
rows is an equi-join that adaptive execution splits. Columns named like an output are replaced, others pass through.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from benchweave.llm.staging import stage

MAX_BITS = 1 << 26
HOT = 200
OUTPUTS = ("keep_id", "group_size", "kept", "text_sha256")


def text_digest(text: str = "text") -> Column:
    return F.sha2(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"[\x20\x09-\x0D]+", " "), 256)


def _cells(digest: Column, bits: int) -> tuple[Column, Column, Column]:
    """The filter word of a digest and the two bit numbers in it."""
    h = F.xxhash64(digest)
    word = F.pmod(h, F.lit(bits // 64))
    return word, F.shiftrightunsigned(h, 40).bitwiseAND(F.lit(63)), F.shiftrightunsigned(h, 50).bitwiseAND(F.lit(63))


def filter_size(rows: int) -> int:
    """Bits of the whole filter, 8 to 16 a row; a power of two."""
    return 1 << max(10, math.ceil(math.log2(8 * max(1, rows))))


def slice_of(digest: Column, slices: int) -> Column:
    """The slice of the filter that a digest falls into."""
    return F.pmod(F.shiftrightunsigned(F.xxhash64(digest, F.lit("slice")), 8), F.lit(slices)).cast("int")


def twice_hit(digests: DataFrame, bits: int) -> DataFrame:
    """First pass: ``(word, mask)``, the bits of every filter word that at least two rows hit."""
    word, first, second = _cells(F.col("text_sha256"), bits)
    hits = digests.select(word.alias("word"), F.explode(F.array_distinct(F.array(first, second))).alias("bit"))
    again = hits.groupBy("word", "bit").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return again.groupBy("word").agg(F.expr("bit_or(shiftleft(1L, cast(bit AS int)))").alias("mask"))


def maybe_repeated(rows: DataFrame, filter_words: DataFrame, bits: int) -> DataFrame:
    """Second pass: ``rows`` with ``__maybe``, false where no other row can have the same ``text_sha256``."""
    word, first, second = _cells(F.col("text_sha256"), bits)
    has = lambda bit: F.expr("mask").isNotNull() & (F.call_function("shiftright", F.col("mask"), bit.cast("int")).bitwiseAND(F.lit(1)) == 1)
    tested = rows.withColumn("__word", word).join(F.broadcast(filter_words.withColumnRenamed("word", "__word")), "__word", "left")
    return tested.withColumn("__maybe", F.coalesce(has(first) & has(second), F.lit(False))).drop("__word", "mask")


def _sliced(docs: DataFrame, kept: list[Column], text: str) -> tuple[DataFrame, int, int]:
    """``kept`` columns with their digests, staged by slice; bits of one slice, and the number of slices."""
    bits = filter_size(docs.count())
    slices = max(1, bits // MAX_BITS)
    rows = docs.select(*kept, text_digest(text).alias("text_sha256"), F.monotonically_increasing_id().alias("row"))
    rows = rows.withColumn("__slice", slice_of(F.col("text_sha256"), slices))
    return stage(rows, "digests", by="__slice" if slices > 1 else None), bits // slices, slices


def _groups(rows: DataFrame) -> DataFrame:
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row")).alias("first")
    return rows.groupBy("text_sha256").agg(first, F.count(F.lit(1)).alias("group_size"))


def _with_groups(again: DataFrame) -> DataFrame:
    """``again`` with ``first`` and ``group_size``. Digests of over one row in ``HOT`` (``HOT`` of them at most) are
    broadcast, so that no task gets all copies of a hot text; the others meet by digest."""
    groups = stage(_groups(again), "groups")
    total = groups.agg(F.sum("group_size").alias("n")).first()["n"] or 0
    hot = F.col("group_size") * HOT > total
    joined = again.join(F.broadcast(groups.where(hot)), "text_sha256", "left")
    rest = joined.where(F.col("group_size").isNull()).drop("first", "group_size")
    return joined.where(F.col("group_size").isNotNull()).union(rest.join(groups.where(~hot), "text_sha256"))


def _by_slice(rows: DataFrame, bits: int, slices: int, finish: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``finish`` of the tested rows of every slice. Slices are worked off one by one, each staged, so that only the
    filter of one is held at a time."""
    parts = []
    for n in range(slices):
        some = rows.where(F.col("__slice") == n).drop("__slice")
        words = stage(twice_hit(some, bits), "filter")
        out = finish(maybe_repeated(some, words, bits))
        parts.append(stage(out, "slice") if slices > 1 else out)
    return functools.reduce(DataFrame.union, parts)


def exact_groups(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, keep_id, group_size, kept, text_sha256)``, one row per input row; empty for an empty table."""

    def finish(tested: DataFrame) -> DataFrame:
        passed = tested.where("not __maybe").select("id", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256")
        joined = _with_groups(tested.where("__maybe").select("id", "text_sha256", "row"))
        return passed.union(joined.select("id", F.col("first.id").alias("keep_id"), "group_size", (F.col("row") == F.col("first.row")).alias("kept"), "text_sha256"))

    rows, bits, slices = _sliced(docs, [F.col(key).alias("id")], text)
    return _by_slice(rows, bits, slices, finish).withColumnRenamed("id", key)


def drop_exact_copies(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without later copies; texts of rows that cannot have a copy are never shuffled.

    Of rows with equal text and equal smallest id one stays. Beyond ``MAX_BITS`` the texts are staged by slice first.
    """
    base = docs.drop("text_sha256")
    digests, bits, slices = _sliced(base, [F.col(key).alias("id")], text)
    full = base.withColumn("text_sha256", text_digest(text))
    if slices > 1:
        full = stage(full.withColumn("__slice", slice_of(F.col("text_sha256"), slices)), "texts", by="__slice")
    parts = []
    for n in range(slices):
        some = digests.where(F.col("__slice") == n).drop("__slice")
        words = stage(twice_hit(some, bits), "filter")
        again = maybe_repeated(some, words, bits).where("__maybe").select("id", "text_sha256", "row")
        keepers = _groups(again).select(F.col("text_sha256").alias("__digest"), F.col("first.id").alias("__keep"))
        texts = full.where(F.col("__slice") == n).drop("__slice") if slices > 1 else full
        tested = maybe_repeated(texts, words, bits)
        # Digest and id together are the join key: copies of a hot text spread by their ids.
        kept = tested.where("__maybe").join(keepers, (F.col("text_sha256") == F.col("__digest")) & F.col(key).eqNullSafe(F.col("__keep")))
        out = tested.where("not __maybe").select(*base.columns).union(kept.dropDuplicates(["text_sha256", key]).select(*base.columns))
        parts.append(stage(out, "slice") if slices > 1 else out)
    return functools.reduce(DataFrame.union, parts)
