"""Frames scaled onto a target range and type, from their own, their pair's or a given range."""

from __future__ import annotations

from typing import Literal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strobelake.functions.pixels import finite_max, finite_min, scale_between
from strobelake.operators.windows import FRAME_BLOCK, core, in_blocks, in_time
from strobelake.schema import INTEGER_SPANS, SPARK_TYPES

Range = tuple[float, float]


def target_of(dtype: str, target: Range | None) -> Range:
    """The span scaled to: as given, or the whole type (0 to 1 for floats)."""
    if dtype not in SPARK_TYPES:
        raise ValueError(f"no frame type {dtype!r}")
    span = INTEGER_SPANS.get(dtype)
    if target is None:
        return span or (0.0, 1.0)
    if target[1] <= target[0]:
        raise ValueError(f"empty target range {target}")
    if span and not (span[0] <= target[0] and target[1] <= span[1]):
        raise ValueError(f"{dtype} does not hold {target}")
    return target


def _cast(data: Column, dtype: str) -> Column:
    return data.cast(f"array<{SPARK_TYPES[dtype]}>")


def _scaled(frames: DataFrame, low: Column, high: Column, dtype: str, target: Range | None, name: str = "data") -> Column:
    # a range that is null or without span gives null: the fault stays in its row
    return F.when(high > low, _cast(scale_between(F.col(name), low, high, target_of(dtype, target), dtype in INTEGER_SPANS), dtype))


def per_frame(frames: DataFrame, dtype: str = "uint8", target: Range | None = None) -> DataFrame:
    """Each frame from its own range; null data for a uniform frame."""
    return frames.withColumn("data", _scaled(frames, finite_min(F.col("data")), finite_max(F.col("data")), dtype, target))


def pairwise(frames: DataFrame, dtype: str = "uint8", target: Range | None = None) -> DataFrame:
    """(seq, idx, height, width, prev, curr): each frame with the next, both from their joint range."""
    rows = frames.select("seq", "idx", "height", "width", "data", finite_min(F.col("data")).alias("low"), finite_max(F.col("data")).alias("high"))
    rows = in_blocks(rows, 0, 1, FRAME_BLOCK).select("*", *[F.lead(c).over(in_time()).alias(f"next_{c}") for c in ("data", "low", "high")])
    rows = core(rows, FRAME_BLOCK).where("next_data is not null")
    rows = rows.withColumns({"low": F.least("low", "next_low"), "high": F.greatest("high", "next_high")})
    return rows.select("seq", "idx", "height", "width", _scaled(rows, F.col("low"), F.col("high"), dtype, target).alias("prev"), _scaled(rows, F.col("low"), F.col("high"), dtype, target, "next_data").alias("curr"))


def injected(frames: DataFrame, source: Range | DataFrame, dtype: str = "uint8", target: Range | None = None, scope: Literal["dataset", "sequence"] = "dataset") -> DataFrame:
    """Every frame from one range: two numbers, a one-row table, or a table with a row for each seq; outside values are clamped."""
    if not isinstance(source, DataFrame):
        if source[1] <= source[0]:
            raise ValueError(f"empty source range {source}")
        return frames.withColumn("data", _scaled(frames, F.lit(float(source[0])), F.lit(float(source[1])), dtype, target))
    ranges = source.select(*(["seq"] if scope == "sequence" else []), F.col("min_value").alias("_low"), F.col("max_value").alias("_high"))
    joined = frames.join(ranges, "seq") if scope == "sequence" else frames.crossJoin(F.broadcast(ranges.limit(1)))  # one row
    return joined.withColumn("data", _scaled(joined, F.col("_low"), F.col("_high"), dtype, target)).select(*frames.columns)
