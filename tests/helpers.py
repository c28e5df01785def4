"""Small frames tables for the tests."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from strobelake.schema import FRAMES


def frames_of(spark: SparkSession, sequences: dict[str, np.ndarray], unit: str = "rad", height_scale: float = 2.0e-7) -> DataFrame:
    rows = [(seq, k, k, f"{k:05d}_phase", *stack.shape[1:], 0.15, height_scale, unit, [float(v) for v in frame.ravel()]) for seq, stack in sequences.items() for k, frame in enumerate(stack)]
    return spark.createDataFrame(rows, FRAMES)


def stacks(frames: DataFrame, column: str = "data") -> dict[str, np.ndarray]:
    out: dict[str, list] = {}
    for r in frames.orderBy("seq", "idx").collect():
        out.setdefault(r["seq"], []).append(np.array(r[column], dtype=float).reshape(r["height"], r["width"]))
    return {k: np.stack(v) for k, v in out.items()}


def texture(side: int = 64) -> np.ndarray:
    y, x = np.mgrid[:side, :side]
    return (128 + 60 * np.sin(2 * np.pi * x / 16) + 60 * np.sin(2 * np.pi * y / 16)).astype(np.uint8)
