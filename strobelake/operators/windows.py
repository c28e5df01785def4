"""Windows along time: truncated at the ends, never padded.

A window runs over blocks of a sequence, each with as many rows around it as the window
reaches, so that a long sequence spreads over many tasks. idx counts without gaps.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


#: Indices of a sequence in one block: of scalars, and of frames.
SIGNAL_BLOCK, FRAME_BLOCK = 4096, 64


def in_blocks(rows: DataFrame, back: int, ahead: int, size: int) -> DataFrame:
    """Each row once for every block of ``size`` indices that looks at it, ``back`` before and ``ahead`` after its own; the block is column _block."""
    first, last = F.floor((F.greatest(F.col("idx") - ahead, F.lit(0))) / size), F.floor((F.col("idx") + back) / size)
    return rows.withColumn("_block", F.explode(F.sequence(first, last)))


def in_time() -> WindowSpec:
    """A block's rows in order."""
    return Window.partitionBy("seq", "_block").orderBy("idx")


def core(rows: DataFrame, size: int) -> DataFrame:
    """Each row of ``in_blocks`` in its own block alone."""
    return rows.where(F.floor(F.col("idx") / size) == F.col("_block")).drop("_block")


def followed(by: int) -> Column:
    """Whether ``by`` more rows come after a row; within blocks that look as far ahead, so nothing is counted."""
    return F.lead("idx", by).over(in_time()).isNotNull() if by else F.lit(True)


def with_count(rows: DataFrame, name: str) -> DataFrame:
    """``rows`` with the number of rows of their sequence, counted by a partial aggregation."""
    return rows.join(rows.groupBy("seq").agg(F.count("*").alias(name)), "seq")


def middle(values: Column) -> Column:
    """The median of an array; the mean of the middle two for even counts, null when empty."""
    ordered, n = F.array_sort(values), F.size(values)
    low, high = F.floor((n + 1) / 2).cast("int"), F.floor((n + 2) / 2).cast("int")
    return F.when(n > 0, (F.element_at(ordered, low) + F.element_at(ordered, high)) / 2)


def moving_median(signal: DataFrame, radius: int) -> DataFrame:
    """(seq, idx, value): Spark's median takes no frame, so the few values of each window are gathered and sorted."""
    rows = in_blocks(signal.select("seq", "idx", "value"), radius, radius, SIGNAL_BLOCK)
    near = F.collect_list("value").over(in_time().rowsBetween(-radius, radius))
    return core(rows.withColumn("value", middle(near)), SIGNAL_BLOCK)


def gaussian_weights(sigma: float, truncate: float = 4.0) -> tuple[int, list[float]]:
    """(radius, weights of -radius..radius, summing to one)."""
    radius = int(truncate * sigma + 0.5)
    raw = [math.exp(-d * d / (2 * sigma * sigma)) if sigma > 0 else float(d == 0) for d in range(-radius, radius + 1)]
    return radius, [w / sum(raw) for w in raw]


def moving_gaussian(signal: DataFrame, sigma: float, truncate: float = 4.0) -> DataFrame:
    """Weighted mean over the part of the window that exists, divided once at the end."""
    radius, weights = gaussian_weights(sigma, truncate)
    above, below = F.lit(0.0), F.lit(0.0)
    for d, w in zip(range(-radius, radius + 1), weights):
        v = F.lead("value", d).over(in_time())
        above, below = above + F.coalesce(v * w, F.lit(0.0)), below + F.when(v.isNotNull(), w).otherwise(0.0)
    rows = in_blocks(signal.select("seq", "idx", "value"), radius, radius, SIGNAL_BLOCK)
    return core(rows.withColumn("value", above / below), SIGNAL_BLOCK)


def trimmed(rows: DataFrame, lead: int, trail: int) -> DataFrame:
    """Rows whose idx is at least ``lead`` after the first and ``trail`` before the last of the sequence."""
    return with_count(rows, "_n").where((F.col("idx") >= lead) & (F.col("idx") < F.col("_n") - trail)).select(*rows.columns)
