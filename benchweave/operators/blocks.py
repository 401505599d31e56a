"""Meet every left row with every right row of the same key, block by block.

Both sides are hashed into blocks of bounded size and each pair of blocks is one task group, so a hot key turns
into many equal pieces of work and only what the kernel returns leaves the task: never the pairs themselves.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from benchweave.functions.names import to_col

Kernel = Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]


def _block(ident, count) -> F.Column:
    return F.pmod(F.xxhash64(to_col(ident)), count).cast("int")


def block_join(
    left: DataFrame,
    right: DataFrame,
    kernel: Kernel,
    schema: str,
    left_id: str,
    right_id: str,
    keys: Sequence[str] = (),
    left_rows: int = 4096,
    right_rows: int = 4096,
) -> DataFrame:
    """``kernel(left_block, right_block)`` for every pair of blocks; both frames keep their columns.

    Without keys the two sizes are counted up front. With keys the sizes are one aggregate per side, joined by key.
    """
    keys = list(keys)
    if not keys:
        wide = left.sparkSession.sparkContext.defaultParallelism
        n_left, n_right = left.count(), right.count()
        left_blocks = max(1, -(-n_left // left_rows), min(wide, n_left // 64))
        right_blocks = max(1, -(-n_right // right_rows))
        lhs = left.withColumn("_lb", _block(left_id, F.lit(left_blocks)))
        rhs = right.withColumn("_rb", _block(right_id, F.lit(right_blocks)))
        lhs = lhs.withColumn("_rb", F.explode(F.sequence(F.lit(0), F.lit(right_blocks - 1))))
        rhs = rhs.withColumn("_lb", F.explode(F.sequence(F.lit(0), F.lit(left_blocks - 1))))
    else:
        left_n = left.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / left_rows).cast("int").alias("_nl"))
        right_n = right.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / right_rows).cast("int").alias("_nr"))
        sizes = left_n.join(right_n, keys, "left").withColumn("_nr", F.coalesce("_nr", F.lit(1)))
        lhs = left.join(sizes, keys).withColumn("_lb", _block(left_id, F.col("_nl")))
        lhs = lhs.withColumn("_rb", F.explode(F.sequence(F.lit(0), F.col("_nr") - 1))).drop("_nl", "_nr")
        rhs = right.join(sizes, keys).withColumn("_rb", _block(right_id, F.col("_nr")))
        rhs = rhs.withColumn("_lb", F.explode(F.sequence(F.lit(0), F.col("_nl") - 1))).drop("_nl", "_nr")
    cut = [*keys, "_lb", "_rb"]
    # Fresh column identities: both sides may come from one table.
    rhs = rhs.select(*[F.col(c).alias(c) for c in rhs.columns])

    def run(left_block: pd.DataFrame, right_block: pd.DataFrame) -> pd.DataFrame:
        return kernel(left_block.drop(columns=["_lb", "_rb"]), right_block.drop(columns=["_lb", "_rb"]))

    return lhs.groupBy(*cut).cogroup(rhs.groupBy(*cut)).applyInPandas(run, schema)
