"""Model table: one row per track and round, read back as a scorer."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from nightwarden import fixed_values as fv
from nightwarden.plans.network_detection import Model


def to_row(spark: SparkSession, model: Model, track: int, round_: int, version: str, clients: int, at: float) -> DataFrame:
    """One model as a table row, layers flattened row by row."""
    from nightwarden.schemas import MODELS

    layer = lambda a: (np.asarray(a, float).ravel().tolist(), a.shape[0], a.shape[1] if a.ndim > 1 else 0)
    return spark.createDataFrame([(
        track, round_, version, clients, at, [layer(c) for c in model.coefs], [layer(b) for b in model.intercepts],
        list(map(float, model.mean)), list(map(float, model.scale)))], MODELS)


def load_round(models: DataFrame, track: int = fv.TRACK_NETWORK, features: tuple[str, ...] = fv.MODEL_FEATURES,
               activation: str = "relu", classes: tuple[int, ...] = (fv.LABEL_ATTACK, fv.LABEL_BENIGN)) -> tuple[Model, int]:
    """Newest valid model of a track and its round: one row, a few thousand numbers.

    A round whose input width does not fit the feature list is passed over in favour of the
    last one that does.
    """
    width = F.col("coefs")[0]["rows"]
    rows = models.filter((F.col("track") == track) & (width == len(features))).orderBy(F.desc("round")).limit(1).collect()
    if not rows:
        raise ValueError(f"no model of track {track} takes {len(features)} features")
    row = rows[0]
    matrix = lambda w: np.array(w["values"]).reshape(w["rows"], max(w["cols"], 1))
    return Model(
        [matrix(w) for w in row["coefs"]], [np.array(w["values"]) for w in row["intercepts"]],
        np.array(row["scaler_mean"]), np.array(row["scaler_scale"]), activation, tuple(classes)).validated(features), row["round"]


def load(models: DataFrame, *args, **settings) -> Model:
    """Newest valid model of a track, as `load_round` finds it."""
    return load_round(models, *args, **settings)[0]
