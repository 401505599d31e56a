"""Running confusion counts, loss means and best epochs over streams."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from benchweave.operators.metrics import confusion, loss_means
from benchweave.session import ensure_checkpoint_dir

HISTORY_SCHEMA = T.StructType(
    [
        T.StructField("run", T.StringType()),
        T.StructField("epoch", T.LongType()),
        T.StructField("stage_name", T.StringType()),
        T.StructField("relation_policy", T.StringType()),
        T.StructField("train_metrics", T.MapType(T.StringType(), T.DoubleType())),
        T.StructField("val_metrics", T.MapType(T.StringType(), T.DoubleType())),
    ]
)


def read_stream(spark: SparkSession, path: str, schema: T.StructType, source: str = "parquet", files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).format(source).load(path)


def running_confusion(predictions: DataFrame) -> DataFrame:
    """Confusion counts so far; state holds one row per (true, predicted) pair."""
    return confusion(predictions)


def running_losses(steps: DataFrame, keys=("stage",)) -> DataFrame:
    """Weighted loss means so far; state holds sums only."""
    return loss_means(steps, list(keys))


def history_stream(spark: SparkSession, path: str, files_per_batch: int = 100) -> DataFrame:
    """The growing JSON-lines metrics history."""
    return read_stream(spark, path, HISTORY_SCHEMA, "json", files_per_batch)


def metric_rows(history: DataFrame, metric: str, group: str = "val_metrics") -> DataFrame:
    """(run, epoch, stage_name, metric) of one named metric; records without it have NULL."""
    return history.select("run", "epoch", "stage_name", F.try_element_at(group, F.lit(metric)).alias("metric"))


def best_epochs(history: DataFrame, metric: str = "metric", mode: str = "max", keys=("run",)) -> DataFrame:
    """Best epoch per run so far, the earliest one among equals; state holds one row per run.

    Rows with a NULL or NaN metric are not counted.
    """
    value = F.col(metric) if mode == "max" else -F.col(metric)
    best = F.max(F.struct(value.alias("v"), (-F.col("epoch")).alias("e")))
    number = F.col(metric).isNotNull() & ~F.isnan(metric)
    out = history.where(number).groupBy(*keys).agg(best.alias("_b"), F.count(F.lit(1)).alias("epochs"))
    shown = F.col("_b.v") if mode == "max" else -F.col("_b.v")
    return out.select(*keys, (-F.col("_b.e")).alias("best_epoch"), shown.alias("best_metric"), "epochs")


def drain(aggregate: DataFrame, path: str | None = None) -> DataFrame:
    """Process everything available now and return the final table.

    Results are written to a folder, not collected; offsets and state live next to it, so a restarted job with the
    same ``path`` goes on where it stopped. A batch replaces the table and may safely run twice.
    """
    spark = aggregate.sparkSession
    root = path or f"{ensure_checkpoint_dir(spark)}/streams/{uuid.uuid4().hex}"

    def replace(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/table")

    stream = aggregate.writeStream.outputMode("complete").option("checkpointLocation", f"{root}/state").foreachBatch(replace)
    job = stream.trigger(availableNow=True).start()
    job.awaitTermination()
    return spark.read.parquet(f"{root}/table")
