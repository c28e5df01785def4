"""What can be reused, what is covered, and what has lost its source: joins between manifests.

A manifest of parts has (source, settings, digest): the sequence measured, the settings as
canonical JSON, and a digest of the names of its frames in order.
"""

from __future__ import annotations

import json
from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strobelake.functions.pixels import is_finite


def canonical(settings: Mapping) -> str:
    """Settings as they compare after a round trip through JSON: tuples are lists, keys are sorted, NaN is refused."""
    return json.dumps(json.loads(json.dumps(settings, allow_nan=False)), sort_keys=True, separators=(",", ":"))


def reusable(parts: DataFrame, contents: DataFrame, settings: str) -> DataFrame:
    """(seq) whose part was measured under these settings over exactly these frames in this order."""
    known = parts.select(F.col("source").alias("seq"), "settings", F.col("digest").alias("measured")).dropDuplicates(["seq"])
    return contents.join(known, "seq").where((F.col("settings") == settings) & (F.col("measured") == F.col("digest"))).select("seq")


def reuse_plan(parts: DataFrame, contents: DataFrame, selected: DataFrame, settings: str) -> DataFrame:
    """(seq, action): reuse or compute, for every selected sequence; only those to compute are read."""
    kept = reusable(parts, contents, settings).withColumn("_kept", F.lit(True))
    return selected.select("seq").distinct().join(kept, "seq", "left").select("seq", F.when(F.col("_kept"), "reuse").otherwise("compute").alias("action"))


def complete_folders(written: DataFrame, expected: DataFrame) -> DataFrame:
    """(seq) of frame outputs that hold exactly as many frames as their manifest says."""
    counts = written.groupBy("seq").agg(F.count("*").alias("have"))
    return expected.select("seq", "n_frames").join(counts, "seq").where("have = n_frames").select("seq")


def to_compute(selected: DataFrame, *kept_by_sink: DataFrame) -> DataFrame:
    """(seq) that at least one sink still needs."""
    need = None
    for kept in kept_by_sink:
        missing = selected.select("seq").join(kept.select("seq"), "seq", "left_anti")
        need = missing if need is None else need.union(missing)
    return selected.select("seq").distinct() if need is None else need.distinct()


def unsourced(outputs: DataFrame, contents: DataFrame) -> DataFrame:
    """(seq) of outputs whose sequence is gone."""
    return outputs.select("seq").distinct().join(contents.select("seq"), "seq", "left_anti")


def covered(contents: DataFrame, selected: DataFrame, parts: DataFrame, reused: DataFrame) -> DataFrame:
    """(seq, ordinal, chosen, part, reused) of every sequence found."""
    flags = contents.select("seq", "ordinal")
    for name, rows in (("chosen", selected), ("part", parts.select(F.col("source").alias("seq"))), ("reused", reused)):
        flags = flags.join(rows.select("seq").distinct().withColumn(name, F.lit(True)), "seq", "left")
    return flags.select("seq", "ordinal", *[F.coalesce(F.col(c), F.lit(False)).alias(c) for c in ("chosen", "part", "reused")])


def coverage_counts(flags: DataFrame) -> DataFrame:
    """One row of counts (found, selected, covered, reused, skipped, unselected) over ``covered``, of fixed size."""
    chosen, part = F.col("chosen"), F.col("part")
    counts = {"selected": chosen, "covered": part, "reused": F.col("reused") & part, "skipped": chosen & ~part, "unselected": ~chosen & ~part}
    return flags.agg(F.count("*").alias("found"), *[F.count_if(c).alias(name) for name, c in counts.items()])


def uncovered(flags: DataFrame, chosen: bool) -> DataFrame:
    """(seq) of sequences without part in the order of the contents: those that were selected (skipped), or were not (unselected)."""
    return flags.where((F.col("chosen") == chosen) & ~F.col("part")).orderBy("ordinal").select("seq")


def coverage(contents: DataFrame, selected: DataFrame, parts: DataFrame, reused: DataFrame) -> DataFrame:
    """One row (found, selected, covered, reused, skipped, unselected): lists keep the order of ``contents`` (seq, ordinal).

    skipped were selected and have no part; unselected were not and have none. The lists are of one row: a document, which may be long,
    streams them from ``uncovered`` instead.
    """
    flags = covered(contents, selected, parts, reused)
    names = lambda when: F.transform(F.sort_array(F.collect_list(F.when(when, F.struct("ordinal", "seq")))), lambda r: r["seq"])
    lists = flags.agg(names(F.col("chosen") & ~F.col("part")).alias("skipped"), names(~F.col("chosen") & ~F.col("part")).alias("unselected"))
    return coverage_counts(flags).drop("skipped", "unselected").crossJoin(lists)  # a row each


def check_coverage(row: Mapping) -> None:
    """The counts must add up; skipped and unselected are counts or lists."""
    size = lambda v: v if isinstance(v, int) else len(v)
    if row["covered"] + size(row["skipped"]) + size(row["unselected"]) != row["found"] or row["selected"] > row["found"] or row["reused"] > row["covered"]:
        raise ValueError(f"found sequences are not each covered, skipped or unselected once: {dict(row)}")


def part_faults(parts: DataFrame, frames: DataFrame | None = None) -> DataFrame:
    """(source, fault) of range parts that are misfiled, not finite, inverted, or out of their frames.

    Frames are in an array of each part, or rows (source, min_value, max_value) of their own.
    """
    wrong = lambda low, high: low.isNull() | high.isNull() | (low > high)
    if frames is None:
        parts = parts.withColumns({"_n": F.size("frames"), "_bad": F.exists("frames", lambda f: wrong(f["min_value"], f["max_value"]))})
    else:
        counted = frames.groupBy(F.col("source").alias("_source")).agg(F.count("*").alias("_n"), (F.count_if(wrong(F.col("min_value"), F.col("max_value"))) > 0).alias("_bad"))
        parts = parts.join(counted, F.col("source") == F.col("_source"), "left").withColumn("_n", F.coalesce("_n", F.lit(0)))
    n = F.col("_n")
    fault = (
        F.when(F.col("source").isNull(), "no source")
        .when(F.col("min_value").isNull() | F.col("max_value").isNull(), "a bound is missing")
        .when(~is_finite(F.col("min_value")) | ~is_finite(F.col("max_value")), "a bound is not finite")
        .when(F.col("min_value") > F.col("max_value"), "the bounds are inverted")
        .when(n == 0, "it has no frames")
        .when((F.col("min_index") < 0) | (F.col("min_index") >= n) | (F.col("max_index") < 0) | (F.col("max_index") >= n), "a position is outside its frames")
        .when(F.col("_bad"), "a frame's bounds are wrong")
    )
    if "n_frames" in parts.columns:
        fault = F.when(F.col("n_frames") != n, "it has other frames than it counts").otherwise(fault)
    if "filed_as" in parts.columns:
        fault = F.when(F.col("filed_as") != F.col("source"), "filed under another name").otherwise(fault)
    return parts.select("source", fault.alias("fault")).where("fault is not null")


def merge_parts(old: DataFrame, new: DataFrame) -> DataFrame:
    """Newer parts replace older ones of the same source."""
    return new.unionByName(old.join(new.select("source"), "source", "left_anti"))
