"""Inference with the flat-window network: sigmoid layers and two hard-sigmoid heads.  Training happens elsewhere on the example table."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-z))


def hard_sigmoid(z: np.ndarray) -> np.ndarray:
    return np.clip((z + 2.5) / 5, 0, 1)


def forward(x: np.ndarray, weights: dict) -> tuple[np.ndarray, np.ndarray]:
    for w, b in weights["hidden"]:
        x = sigmoid(x @ w + b)
    return tuple(hard_sigmoid(x @ w + b) for w, b in weights["heads"])


def predict(examples: DataFrame, weights: dict) -> DataFrame:
    """examples: track_id, idx, n, vehicle, x.  Gives track_id, idx, n, y_position, y_velocity for the inverse transform.

    ``weights``: hidden and heads, lists of (matrix, bias); they are broadcast (a fixed network)."""
    shared = examples.sparkSession.sparkContext.broadcast(weights)

    def matrix(col) -> np.ndarray:
        v = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
        return v.flatten().to_numpy(zero_copy_only=False).reshape(len(v), -1).astype(float)

    def run(batches):
        for b in batches:
            if b.num_rows:
                pos, vel = forward(np.hstack([matrix(b.column("vehicle")), matrix(b.column("x"))]), shared.value)
                yield pa.RecordBatch.from_arrays([b.column("track_id"), b.column("idx"), b.column("n"), pa.array(list(pos), pa.list_(pa.float64())), pa.array(list(vel), pa.list_(pa.float64()))], names=["track_id", "idx", "n", "y_position", "y_velocity"])

    return examples.selectExpr("cast(track_id as long) track_id", "cast(idx as long) idx", "cast(n as long) n", "vehicle", "x").mapInArrow(run, "track_id long, idx long, n long, y_position array<double>, y_velocity array<double>")
