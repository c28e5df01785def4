"""Cached or computed frames behind one name: what a sink holds is read, the rest is computed when it is asked for."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strobelake.operators.filters import apply_filter
from strobelake.plans.incremental import complete_folders, reusable
from strobelake.sinks.tables import FrameTable
from strobelake.sources.select import content_digests


def cached_sequences(sink: FrameTable, frames: DataFrame, settings: str) -> DataFrame:
    """(seq) that the sink holds whole, made under these settings from these frames."""
    held = sink.manifest()
    fit = reusable(held.select(F.col("seq").alias("source"), "settings", "digest"), content_digests(frames), settings)
    return fit.join(complete_folders(sink.counts(), held), "seq", "left_semi")


def cached_or_computed(sink: FrameTable, frames: DataFrame, kernel: object, settings: str) -> DataFrame:
    """The filtered ``frames``: each sequence from the sink where it is valid there, else by the kernel.

    Which is which is decided by joins on the manifest, so cached sequences are left out of the source before a pixel
    of them is read, and the sink's other sequences are not read.
    """
    cached = cached_sequences(sink, frames, settings)
    stored = sink.read(frames.schema).join(cached, "seq", "left_semi")
    fresh = apply_filter(frames.join(cached, "seq", "left_anti"), kernel)
    return stored.unionByName(fresh)
