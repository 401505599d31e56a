"""Language identification by compression: the language whose dictionary compresses a text best wins.

Each language gets a zstandard raw-content dictionary of up to ``DICTIONARY_BYTES`` bytes, made of training texts in lower
case, and its consecutive parts of ``PART_BYTES`` as dictionaries of their own.
Training takes the ``SAMPLE`` distinct texts of each language with the smallest hashes, so copies count once and every
labelled language with a text is learned; of a text above ``LONGEST`` characters it takes an excerpt of that length,
placed by the hash. Every whole text is then compressed with each dictionary in blocks of at most ``BLOCK_BYTES``, each block anew, so that all of a long text
counts alike; the smallest sum over its blocks decides, ties go to the alphabetically first language.

``lang_pred`` is the winner, or ``und`` for null text, text without a letter, and when nothing was learned. ``score`` is the
softmax share of the winner over the compressed sizes. ``rejected`` marks winners whose relative margin over the second
is below ``margin``, and all ``und`` rows. Training rows with null text or language are ignored. Repeated rows are harmless;
columns named like an output are replaced, others pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from benchweave.llm.words import text_slices

SAMPLE = 300
LONGEST = 20_000
DICTIONARY_BYTES = 512 * 1024
PART_BYTES = 64 * 1024
BLOCK_BYTES = 16 * 1024
NARROW_BYTES, NARROW_SHARE = 12, 0.02
SEARCH = {"window_log": 20, "hash_log": 17, "chain_log": 17, "search_log": 4, "target_length": 32, "write_content_size": 0}
OUTPUTS = ("lang_pred", "score", "rejected")
_LETTER = regex.compile(r"\p{L}")


def _cut(share: float) -> int:
    """The signed 64-bit hash below which about ``share`` of all hashes lie."""
    return min((1 << 63) - 1, int(share * (1 << 64)) - (1 << 63))


def learn(docs: DataFrame, text: str = "text", lang: str = "lang", sample: int = SAMPLE) -> dict[str, bytes]:
    """Language to dictionary content, from labelled rows."""
    fit = docs.where((F.length(text) > 0) & F.col(lang).isNotNull())
    rows = fit.select(F.col(lang).alias("lang"), F.col(text).alias("text"), F.xxhash64(F.lit(5), F.col(text)).alias("draw"))
    distinct = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.approx_count_distinct("draw").alias("n")).collect()}
    cuts = {name: _cut(min(1.0, 2 * sample / n)) for name, n in distinct.items()}
    found: dict[str, list[bytes]] = {}
    excerpt = F.expr(f"substring(text, cast(pmod(draw, greatest(length(text) - {LONGEST}, 0) + 1) as int) + 1, {LONGEST})")
    # Twice the sample lies below the cut; a language whose estimate was far too high is read again as a whole.
    while cuts:
        below = F.lit(False)
        for name, cut in cuts.items():
            below = below | ((F.col("lang") == name) & (F.col("draw") <= cut))
        drawn = rows.where(below).select("lang", "draw", excerpt.alias("text")).groupBy("lang", "draw").agg(F.first("text").alias("text"))
        least = drawn.withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy("draw"))).where(F.col("place") <= sample)
        got: dict[str, list[bytes]] = {name: [] for name in cuts}
        for r in least.orderBy("lang", "draw").collect():
            got[r["lang"]].append(r["text"].lower().encode())
        found |= got
        cuts = {name: _cut(1.0) for name, cut in cuts.items() if cut < _cut(1.0) and len(got[name]) < sample}
    return {name: b"\n".join(texts)[:DICTIONARY_BYTES] for name, texts in sorted(found.items())}


def _compressor(content: bytes, thorough: bool) -> zstandard.ZstdCompressor:
    how = {"min_match": 3, "strategy": zstandard.STRATEGY_LAZY} if thorough else {"min_match": 4, "strategy": zstandard.STRATEGY_GREEDY}
    settings = zstandard.ZstdCompressionParameters(**SEARCH, **how)
    dictionary = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    dictionary.precompute_compress(compression_params=settings)
    return zstandard.ZstdCompressor(dict_data=dictionary, compression_params=settings)


def _compressors(dictionaries: dict[str, bytes]) -> list[tuple]:
    """The main compressor of each language and those of its parts; all languages have equally many parts."""
    shortest = min(map(len, dictionaries.values()), default=0)
    starts = range(0, max(1, shortest - PART_BYTES + 1), PART_BYTES)
    return [(_compressor(c, False), [_compressor(c[a : a + PART_BYTES], True) for a in starts]) for c in dictionaries.values()]


def _blocks(raw: bytes) -> list[bytes]:
    """``raw`` in about equal blocks of at most ``BLOCK_BYTES``, cut before a blank where one is near, never in a character."""
    if len(raw) <= BLOCK_BYTES:
        return [raw]
    n, cuts = -(-len(raw) // (BLOCK_BYTES - 1024)), [0]
    for i in range(1, n):
        cut = i * len(raw) // n
        blank = max(raw.rfind(b" ", cut - 512, cut), raw.rfind(b"\n", cut - 512, cut))
        while blank < 0 and raw[cut] & 0xC0 == 0x80:
            cut -= 1
        cuts.append(cut if blank < 0 else blank)
    return [raw[a:b] for a, b in zip(cuts, [*cuts[1:], len(raw)], strict=True)]


def classify(docs: DataFrame, dictionaries: dict[str, bytes], text: str = "text", margin: float = 0.02) -> DataFrame:
    base = docs.drop(*OUTPUTS)
    names, at = list(dictionaries), base.columns.index(text)
    shared = docs.sparkSession.sparkContext.broadcast(dictionaries)  # half a megabyte a language

    def judge(compressors: list[list], value: str | None) -> tuple[str, float, bool]:
        if not names or value is None or not _LETTER.search(value):
            return "und", 0.0, True
        blocks = _blocks(value.lower().encode())
        sizes = np.array([sum(len(own[0].compress(b)) for b in blocks) for own in compressors], dtype=float)
        lead = np.partition(sizes, 1)[:2] if len(sizes) > 1 else np.array([0, np.inf])
        if lead[1] - lead[0] < max(NARROW_BYTES, NARROW_SHARE * lead[0]):
            sizes = np.array([np.mean([sum(len(c.compress(b)) for b in blocks) for c in own[1]]) for own in compressors])
        best = int(np.argmin(sizes))
        score = 1 / np.exp(np.minimum(0, -(sizes - sizes[best]) / 4)).sum()
        rest = np.delete(sizes, best)
        return names[best], float(score), bool(len(rest) and rest.min() - sizes[best] < margin * sizes[best])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compressors = _compressors(shared.value)
        for batch in batches:
            for a, b in text_slices(batch.column(at)):
                part = batch.slice(a, b - a)
                found = [judge(compressors, t.as_py()) for t in part.column(at)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64()), pa.array([f[2] for f in found], pa.bool_())], [*part.schema.names, *OUTPUTS])

    fields = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())]
    return base.mapInArrow(run, T.StructType([*base.schema.fields, *fields]))
