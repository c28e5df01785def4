"""Choosing sequences and frames, and refusing what cannot be computed on."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Literal

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strobelake.functions.digests import sequence_digest
from strobelake.functions.pixels import all_finite

Names = Sequence[str] | str | None


def name_list(spark: SparkSession, names: Names) -> DataFrame | None:
    """Names given one by one, or as the path of a text file with one a line."""
    if names is None:
        return None
    found = spark.read.text(names).select(F.trim("value").alias("seq")).where("seq <> ''") if isinstance(names, str) else spark.createDataFrame([(n,) for n in names], "seq string")
    if found.isEmpty():
        raise ValueError("a selection names no sequence")
    return found.distinct()


def select_sequences(frames: DataFrame, include: Names = None, exclude: Names = None) -> DataFrame:
    """Rows of the included sequences (all by default) that are not excluded."""
    spark = frames.sparkSession
    keep, drop = name_list(spark, include), name_list(spark, exclude)
    if keep is not None:
        frames = frames.join(keep, "seq", "left_semi")
    return frames if drop is None else frames.join(drop, "seq", "left_anti")


def check_selection(start: int, step: int, count: int | None) -> None:
    if start < 0 or step < 1 or (count is not None and count < 1):
        raise ValueError(f"start {start}, step {step}, count {count}: start must be 0 or more, the others 1 or more")


def select_frames(frames: DataFrame, start: int = 0, step: int = 1, count: int | None = None) -> DataFrame:
    """Every ``step``-th frame from ``start``, ``count`` at most, as a predicate on source_idx that is pushed to the scan; idx counts anew from 0."""
    check_selection(start, step, count)
    at = F.col("source_idx")
    kept = frames.where((at >= start) & ((at - start) % step == 0))
    if count is not None:
        kept = kept.where(at < start + count * step)
    return kept.withColumn("idx", ((at - start) / step).cast("int"))


def short_sequences(frames: DataFrame, count: int) -> DataFrame:
    """(seq, taken) of sequences with fewer than ``count`` frames."""
    return frames.groupBy("seq").agg(F.count("*").alias("taken")).where(F.col("taken") < count)


def require_count(frames: DataFrame, selected: DataFrame, count: int | None, if_short: Literal["take", "error"] = "take") -> DataFrame:
    """``selected``, refused where a sequence of ``frames`` has no frame left or, with ``error``, fewer than ``count``."""
    if if_short not in ("take", "error"):
        raise ValueError(f"if_short is take or error, not {if_short!r}")
    empty = frames.select("seq").distinct().join(selected.select("seq").distinct(), "seq", "left_anti").orderBy("seq").limit(5).collect()
    if empty:
        raise ValueError("no frame is left of " + ", ".join(r["seq"] for r in empty))
    if count is not None and if_short == "error":
        short = short_sequences(selected, count).orderBy("seq").limit(5).collect()
        if short:
            raise ValueError(f"fewer than {count} frames: " + ", ".join(f"{r['seq']} ({r['taken']})" for r in short))
    return selected


def gaps(frames: DataFrame, first: int | None = None) -> DataFrame:
    """(seq, first, last, n) of sequences whose source numbers leave gaps, repeat, or start elsewhere than at ``first``."""
    per = frames.groupBy("seq").agg(F.min("source_idx").alias("first"), F.max("source_idx").alias("last"), F.count("*").alias("n"), F.countDistinct("source_idx").alias("distinct"))
    bad = (F.col("last") - F.col("first") + 1 != F.col("n")) | (F.col("n") != F.col("distinct"))
    if first is not None:
        bad = bad | (F.col("first") != first)
    return per.where(bad).select("seq", "first", "last", "n")


def nonfinite_frames(frames: DataFrame) -> DataFrame:
    """(seq, source_name) of frames with NaN or infinite pixels, after the cast to float."""
    return frames.where(~all_finite(F.col("data").cast("array<float>"))).select("seq", "source_name")


def split_finite(frames: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(frames of sequences without fault, outcomes (seq, computed, reason) of the refused ones)."""
    bad = nonfinite_frames(frames).groupBy("seq").agg(F.min("source_name").alias("name"))
    refused = bad.select("seq", F.lit(False).alias("computed"), F.concat(F.lit("non-finite pixels in "), "name").alias("reason"))
    return frames.join(bad, "seq", "left_anti"), refused


def contents(frames: DataFrame) -> DataFrame:
    """(seq, n_source, frames): the names of every sequence's frames in order."""
    named = frames.groupBy("seq").agg(F.sort_array(F.collect_list(F.struct("source_idx", "source_name"))).alias("rows"))
    return named.select("seq", F.size("rows").alias("n_source"), F.col("rows.source_name").alias("frames"))


def content_digests(frames: DataFrame) -> DataFrame:
    """(seq, n_source, digest): how many frames every sequence has, and 32 bytes that stand for their names in order."""
    return frames.groupBy("seq").agg(F.count("*").alias("n_source"), sequence_digest(F.col("idx"), F.col("source_name")).alias("digest"))


def renumber(frames: DataFrame) -> DataFrame:
    """idx counted from 0 in the order it has, for frames whose numbers have gaps."""
    order = Window.partitionBy("seq").orderBy("idx")
    return frames.withColumn("idx", (F.row_number().over(order) - 1).cast("int"))
