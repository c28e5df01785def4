"""Range parts as a table: a row a sequence, and a row a frame beside it, which only the document reads.

A run adds rows under a name of its own, and a row of the log, written last under a number of its own, makes them count. The newest
row of each sequence is its part, so runs at the same time lose nothing of each other, and one
that never came to its end leaves nothing to see. A part without frames takes its sequence away.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strobelake.sinks.tables import claim, read_if_there

PARTS = "source string, min_value double, max_value double, min_index int, max_index int, n_frames long, settings string, digest string"
PART_FRAMES = "source string, idx int, name string, min_value double, max_value double"


@dataclass
class PartTable:
    spark: SparkSession
    root: str

    def current(self) -> DataFrame:
        """The newest part of each sequence, with its run."""
        log = read_if_there(self.spark, "run string, ordinal long", f"{self.root}/log")
        rows = read_if_there(self.spark, PARTS + ", run string", f"{self.root}/summary").join(log, "run")
        newest = F.row_number().over(Window.partitionBy("source").orderBy(F.desc("ordinal")))
        return rows.withColumn("_k", newest).where("_k = 1 and n_frames > 0").drop("_k", "ordinal")

    def frames(self, parts: DataFrame) -> DataFrame:
        """(source, idx, name, min_value, max_value) of the frames of these parts of ``current``; only their runs are read."""
        rows = read_if_there(self.spark, PART_FRAMES + ", run string", f"{self.root}/frames")
        return rows.join(parts.select("source", "run"), ["source", "run"], "left_semi").drop("run")

    def stage(self, parts: DataFrame, frames: DataFrame, gone: DataFrame | None = None) -> str:
        """Write parts and their frames, and the end of the sequences in ``gone``; the name of the run, which does not count yet."""
        run = uuid.uuid4().hex
        columns = [c.split(" ")[0] for c in PARTS.split(", ")]
        if gone is not None:
            ends = [F.lit(None).cast(t).alias(c) for c, t in (x.split(" ") for x in PARTS.split(", ")[1:])]
            ended = gone.select("source", *ends).withColumn("n_frames", F.lit(0).cast("long"))
            parts = parts.select(*columns).unionByName(ended.join(parts.select("source"), "source", "left_anti"))
        parts.select(*columns).write.parquet(f"{self.root}/summary/run={run}")
        frames.select(*(c.split(" ")[0] for c in PART_FRAMES.split(", "))).write.parquet(f"{self.root}/frames/run={run}")
        return run

    def publish(self, run: str) -> None:
        """Make a run count."""
        ordinal = claim(self.spark, f"{self.root}/claims")
        self.spark.createDataFrame([(run, ordinal)], "run string, ordinal long").write.mode("append").parquet(f"{self.root}/log")
