"""Caller-supplied transforms, scorers and encoders on Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping

import numpy as np
import pandas as pd
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from benchweave.functions.vectors import l2_normalize, softmax_top

Transform = Callable[[pd.DataFrame], pd.DataFrame]


def map_items(df: DataFrame, transforms: Transform | Mapping[str, Transform], schema) -> DataFrame:
    """Apply one transform, or the transform of each row's modality, batch by batch."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if callable(transforms):
                yield transforms(batch)
                continue
            for modality, part in batch.groupby("modality", sort=False):
                if modality not in transforms:
                    raise KeyError(f"no transform for modality {modality!r}")
                yield transforms[modality](part.reset_index(drop=True))

    return df.mapInPandas(run, schema)


def score(df: DataFrame, make_predict: Callable[[], Callable[[np.ndarray], np.ndarray]], vector: str, dim: int, batch_size: int = 1024) -> DataFrame:
    """Score vectors from a batch predictor, then predicted class and confidence.

    ``make_predict`` runs once per Python worker and returns the function that maps [n, dim] to [n, classes].
    """
    predict = predict_batch_udf(make_predict, return_type=T.ArrayType(T.FloatType()), batch_size=batch_size, input_tensor_shapes=[[dim]])
    label, confidence = softmax_top("scores")
    return df.withColumn("scores", predict(F.col(vector))).withColumns({"pred_label": label, "confidence": confidence})


def embed(df: DataFrame, make_encode: Callable[[], Callable[[np.ndarray], np.ndarray]], vector: str, dim: int, out: str = "embedding", batch_size: int = 1024) -> DataFrame:
    """Unit-length embeddings from a batch encoder."""
    encode = predict_batch_udf(make_encode, return_type=T.ArrayType(T.FloatType()), batch_size=batch_size, input_tensor_shapes=[[dim]])
    return df.withColumn("_raw", encode(F.col(vector))).withColumn(out, l2_normalize("_raw").cast("array<float>")).drop("_raw")
