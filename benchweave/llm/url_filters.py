"""URL filters: rules first, then a logistic regression on hashed character n-grams of host and path.

The model is trained from a small labelled URL table (at most ``max_rows`` rows, half of each class, chosen by a hash of
the URL so that the choice does not depend on partitioning) by full-batch gradient steps with per-weight step sizes;
its ``2^16`` weights travel with the scoring tasks. Rules are few and become one conditional expression.

A null URL, or one without ``://``, has empty host and path: no rule fits, and the model's bias decides. With no labelled
rows every undecided URL is allowed; with one class only, that class is the verdict. Repeated rows are judged alike.
Columns named like an output are replaced, others pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from benchweave.llm.words import mix, range_hashes

SLOTS = 1 << 16
GRAMS = (3, 4, 5)
OUTPUTS = ("host", "path", "rule", "p_block", "verdict")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: str) -> Column:
    rest = F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(rest, _UPPER, _LOWER)


def path_of(url: str) -> Column:
    return F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_for(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict; ``rules`` holds (verdict, host and path prefix) pairs."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, text in sorted(rules, key=lambda r: len(r[1])):
        domain, slash, prefix = text.partition("/")
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith(slash + prefix)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, what).otherwise(verdict)
    return rule, verdict


def _grams(hosts: list[str], paths: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, weight slot and value of every n-gram; a row's values have length one."""
    parts = [(f"\x02{h}\x03{p}\x04").encode() for h, p in zip(hosts, paths, strict=True)]
    sizes = np.array([len(p) for p in parts], dtype=np.int64)
    owner = np.repeat(np.arange(len(parts)), sizes)
    data = mix(np.frombuffer(b"".join(parts), dtype=np.uint8).astype(np.uint64))
    rows, slots = [], []
    for n in GRAMS:
        at = np.arange(max(0, len(data) - n + 1))
        at = at[owner[at] == owner[at + n - 1]]
        rows.append(owner[at])
        slots.append((range_hashes(data, at, at + n) ^ np.uint64(n)) % np.uint64(SLOTS))
    row, slot = np.concatenate(rows), np.concatenate(slots).astype(np.int64)
    return row, slot, 1 / np.sqrt(np.bincount(row, minlength=len(parts)))[row]


def _scores(weights: np.ndarray, hosts: list[str], paths: list[str]) -> np.ndarray:
    row, slot, value = _grams(hosts, paths)
    z = weights[SLOTS] + np.bincount(row, weights=weights[slot] * value, minlength=len(hosts))
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def train(labelled: DataFrame, max_rows: int = 4000, steps: int = 80) -> np.ndarray:
    """Weights from ``labelled`` (host, path, block boolean): at most ``max_rows`` rows reach the driver."""
    draw = lambda blocked: labelled.where(F.col("block") == blocked).orderBy(F.xxhash64("host", "path"), "host", "path").limit(max_rows // 2)
    rows = draw(True).union(draw(False)).select("host", "path", "block").collect()
    weights = np.zeros(SLOTS + 1)
    y = np.array([r.block for r in rows], dtype=float)
    if not len(y) or y.min() == y.max():
        weights[SLOTS] = -40.0 if not y.sum() else 40.0
        return weights
    row, slot, value = _grams([r.host for r in rows], [r.path for r in rows])
    squares = np.full(SLOTS + 1, 1e-8)
    for _ in range(steps):
        z = weights[SLOTS] + np.bincount(row, weights=weights[slot] * value, minlength=len(y))
        error = (1 / (1 + np.exp(-z)) - y) / len(y)
        gradient = np.append(np.bincount(slot, weights=error[row] * value, minlength=SLOTS), error.sum())
        squares += gradient**2
        weights -= 0.5 * gradient / np.sqrt(squares)
    return weights


def judge(pages: DataFrame, rules: list[tuple[str, str]], labelled: DataFrame | None = None, url: str = "url", threshold: float = 0.5) -> DataFrame:
    """``pages`` with ``host, path, rule, p_block, verdict``.

    ``labelled`` (host, path, block) trains the model; without it the URLs that the rules decide are the labelled table.
    """
    base = pages.drop(*OUTPUTS)
    split = base.withColumns({"host": host_of(url), "path": path_of(url)})
    rule, ruled = rule_for(F.col("host"), F.col("path"), rules)
    known = split.withColumns({"rule": rule, "__ruled": ruled})
    if labelled is None:
        labelled = known.where("rule is not null").select("host", "path", (F.col("__ruled") == "block").alias("block")).distinct()
    weights = train(labelled)
    names = known.columns

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hosts, paths = batch.column(names.index("host")).to_pylist(), batch.column(names.index("path")).to_pylist()
            p = _scores(weights, hosts, paths) if len(hosts) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p)], [*names, "p_block"])

    scored = known.mapInArrow(score, T.StructType([*known.schema.fields, T.StructField("p_block", T.DoubleType())]))
    learned = F.when(F.col("p_block") >= threshold, "block").otherwise("allow")
    return scored.withColumn("verdict", F.coalesce("__ruled", learned)).drop("__ruled")
