"""Joining streams of frames by position."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def length_faults(a: DataFrame, b: DataFrame) -> DataFrame:
    """(seq, left, right) of sequences of which the two sides hold different numbers of frames."""
    count = lambda rows, name: rows.groupBy("seq").agg(F.count("*").alias(name))
    both = count(a, "left").join(count(b, "right"), "seq", "full").select("seq", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("left", "right")])
    return both.where(F.col("left") != F.col("right"))


def strict_zip(a: DataFrame, b: DataFrame, left: str = "prev", right: str = "curr") -> DataFrame:
    """(seq, idx, height, width, left, right): frame i of one side with frame i of the other; unequal lengths are refused."""
    found = length_faults(a, b).orderBy("seq").limit(5).collect()
    if found:
        raise ValueError("; ".join(f"{r['seq']}: {r['left']} and {r['right']} frames" for r in found))
    return loose_zip(a, b, left, right)


def loose_zip(a: DataFrame, b: DataFrame, left: str = "prev", right: str = "curr") -> DataFrame:
    """The same as far as both sides go."""
    one = a.select("seq", "idx", "height", "width", F.col("data").alias(left))
    return one.join(b.select("seq", "idx", F.col("data").alias(right)), ["seq", "idx"])
