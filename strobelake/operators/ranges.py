"""Value ranges folded from frames to sequences to the data set."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strobelake.functions.digests import sequence_digest
from strobelake.functions.pixels import finite_max, finite_min


def frame_ranges(frames: DataFrame) -> DataFrame:
    """(seq, idx, source, min_value, max_value) over finite pixels; null where a frame has none."""
    return frames.select("seq", "idx", F.col("source_name").alias("source"), finite_min(F.col("data")).alias("min_value"), finite_max(F.col("data")).alias("max_value"))


def sequence_ranges(ranges: DataFrame) -> DataFrame:
    """(seq, min_value, max_value, min_index, max_index, parts); ties go to the earliest frame. One partial row for each sequence and task is shuffled."""
    least, most = F.min(F.struct("min_value", "idx")).alias("low"), F.max(F.struct("max_value", (-F.col("idx")).alias("back"))).alias("high")
    folded = ranges.where("min_value is not null").groupBy("seq").agg(least, most, F.count("*").alias("parts"))
    return folded.select("seq", F.col("low.min_value").alias("min_value"), F.col("high.max_value").alias("max_value"), F.col("low.idx").alias("min_index"), (-F.col("high.back")).alias("max_index"), "parts")


def dataset_range(sequences: DataFrame) -> DataFrame:
    """One row over all sequences; positions count sequences in order of name. No row without any range.

    A position is how many names come before the one that holds it, so nothing is ranked in one task.
    """
    ends = sequences.where("min_value is not null").agg(F.min(F.struct("min_value", "seq")).alias("low"), F.min(F.struct((-F.col("max_value")).alias("sunk"), "seq")).alias("high"), F.count("*").alias("parts"))
    ends = ends.where("parts > 0").select(F.col("low.min_value").alias("min_value"), (-F.col("high.sunk")).alias("max_value"), F.col("low.seq").alias("_low"), F.col("high.seq").alias("_high"), "parts")
    counted = sequences.select("seq").crossJoin(F.broadcast(ends)).groupBy(*ends.columns)  # ends is one row
    before = lambda name: F.count_if(F.col("seq") < F.col(name)).cast("int")
    return counted.agg(before("_low").alias("min_index"), before("_high").alias("max_index")).select("min_value", "max_value", "min_index", "max_index", "parts")


def sequence_parts(ranges: DataFrame, settings: str) -> DataFrame:
    """A part for each sequence: its range, the ranges of its frames in order, and the settings they were measured under."""
    frames = ranges.groupBy("seq").agg(F.sort_array(F.collect_list(F.struct("idx", "source", "min_value", "max_value"))).alias("rows"))
    parts = frames.select("seq", F.transform("rows", lambda r: F.struct(r["source"].alias("source"), r["min_value"].alias("min_value"), r["max_value"].alias("max_value"))).alias("frames"))
    folded = sequence_ranges(ranges).join(parts, "seq")
    return folded.select(F.col("seq").alias("source"), "min_value", "max_value", F.col("min_index").cast("int"), F.col("max_index").cast("int"), "frames", F.lit(settings).alias("settings"))


def part_rows(ranges: DataFrame, settings: str) -> DataFrame:
    """A part for each sequence without the list of its frames: its range, how many frames there are, the digest of their names, and the settings."""
    some = F.col("min_value").isNotNull()
    least, most = F.min(F.when(some, F.struct("min_value", "idx"))), F.max(F.when(some, F.struct("max_value", (-F.col("idx")).alias("back"))))
    rows = ranges.groupBy("seq").agg(least.alias("low"), most.alias("high"), F.count("*").alias("n_frames"), sequence_digest(F.col("idx"), F.col("source")).alias("digest")).where("low is not null")
    return rows.select(
        F.col("seq").alias("source"), "low.min_value", "high.max_value", F.col("low.idx").cast("int").alias("min_index"), (-F.col("high.back")).cast("int").alias("max_index"),
        "n_frames", F.lit(settings).alias("settings"), "digest",
    )


def unmeasurable(ranges: DataFrame) -> DataFrame:
    """(seq, source) of frames without any finite value, which a meter refuses."""
    return ranges.where("min_value is null").select("seq", "source")
