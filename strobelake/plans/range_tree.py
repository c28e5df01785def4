"""The range of a data set in two levels: parts in branches by name, and a row a branch, so that a change refolds the branches it falls in.

A branch holds the parts of consecutive names. The upper level has each branch's first name, folder, extremes
with the first part that has them, and number of parts; the fold reads that level, and of the parts only the branches of the two
extremes, whose positions it counts. An update reads the branches that its names fall in and writes them anew
under a folder of its own, then the upper level under a claimed number, by which it counts. A branch that outgrows twice
``branch_rows`` is cut; an update larger than the tree builds it from the start. One writer at a time.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strobelake.sinks.tables import claim, read_if_there

LEAVES = "source string, min_value double, max_value double"
TOP = "first string, path string, branch int, min_value double, low string, max_value double, high string, parts long, ordinal long"


@dataclass
class RangeTree:
    spark: SparkSession
    root: str
    branch_rows: int = 4096

    def top(self) -> DataFrame:
        """The newest upper level: a row a branch."""
        newest = read_if_there(self.spark, "ordinal long", f"{self.root}/top").agg(F.max("ordinal").alias("_newest"))  # folders by number
        rows = read_if_there(self.spark, TOP, f"{self.root}/top")
        return rows.join(F.broadcast(newest), F.col("ordinal") == F.col("_newest")).drop("_newest", "ordinal")

    def _leaves(self, branches: DataFrame) -> DataFrame:
        """(source, min_value, max_value, first) of the parts in these rows of ``top``; other branches' files are not opened."""
        places = branches.select("path", "branch", "first").collect()  # the branches of an update, or two of a fold
        if not places:
            return self.spark.createDataFrame([], LEAVES + ", first string")
        rows = self.spark.read.option("basePath", f"{self.root}/leaves").schema(LEAVES + ", path string, branch int").parquet(*sorted(f"{self.root}/leaves/path={r['path']}/branch={r['branch']}" for r in places))
        firsts = self.spark.createDataFrame([(r["path"], r["branch"], r["first"]) for r in places], "path string, branch int, first string")
        return rows.join(F.broadcast(firsts), ["path", "branch"]).select("source", "min_value", "max_value", "first")

    def _branch_of(self, source: Column, firsts: list[str]) -> Column:
        """The place in the upper level of the branch that a name falls in."""
        bounds = np.array(firsts[1:], dtype=object)

        @F.arrow_udf("int")
        def place(names: pa.Array) -> pa.Array:
            return pa.array(np.searchsorted(bounds, np.array(names.to_pylist(), dtype=object), side="right").astype(np.int32))

        return place(source) if len(bounds) else F.lit(0)

    def update(self, parts: DataFrame, gone: DataFrame | None = None) -> int:
        """Add or replace parts (source, min_value, max_value) and take those in ``gone`` (source) away; how many parts were read."""
        parts = parts.select("source", "min_value", "max_value").where("min_value is not null").dropDuplicates(["source"])
        old = self.top().orderBy("first").collect()  # a row a branch
        many, held = parts.count(), sum(r["parts"] for r in old)
        if not old or many > held:
            kept = self._leaves(self.top()).select("source", "min_value", "max_value") if old else parts.limit(0)
            if gone is not None:
                kept = kept.join(gone.select("source"), "source", "left_anti")
            rows = parts.unionByName(kept.join(parts.select("source"), "source", "left_anti"))
            wanted = max(1, -(-(many + held) // self.branch_rows))
            self._write(rows.repartitionByRange(wanted, "source").withColumn("branch", F.spark_partition_id()), [])
            return held
        names = [r["first"] for r in old]
        fallen = parts.select("source") if gone is None else parts.select("source").unionByName(gone.select("source"))
        touched = {r["at"] for r in fallen.select(self._branch_of(F.col("source"), names).alias("at")).distinct().collect()}  # branches of the update
        mine = self.spark.createDataFrame([tuple(old[k][c] for c in ("path", "branch", "first")) for k in sorted(touched)], "path string, branch int, first string")
        before = self._leaves(mine).select("source", "min_value", "max_value")
        kept = before.join(fallen, "source", "left_anti")
        rows = parts.unionByName(kept).withColumn("_at", self._branch_of(F.col("source"), names))
        size = Window.partitionBy("_at")
        turn = F.floor((F.row_number().over(size.orderBy("source")) - 1) / self.branch_rows)
        cut = F.when(F.count("*").over(size) > 2 * self.branch_rows, turn).otherwise(F.lit(0))
        self._write(rows.withColumn("branch", (F.col("_at") * 1_000_000 + cut).cast("int")).drop("_at"), [r for k, r in enumerate(old) if k not in touched])
        return sum(old[k]["parts"] for k in touched)

    def _write(self, rows: DataFrame, stay: list) -> None:
        path = uuid.uuid4().hex
        rows.select("source", "min_value", "max_value", "branch").write.partitionBy("branch").parquet(f"{self.root}/leaves/path={path}")
        written = self.spark.read.schema(LEAVES + ", branch int").parquet(f"{self.root}/leaves/path={path}")
        low, high = F.min(F.struct("min_value", "source")).alias("l"), F.min(F.struct((-F.col("max_value")).alias("sunk"), "source")).alias("h")
        folded = written.groupBy("branch").agg(F.min("source").alias("first"), low, high, F.count("*").alias("parts"))
        new = folded.select("first", F.lit(path).alias("path"), "branch", "l.min_value", F.col("l.source").alias("low"), (-F.col("h.sunk")).alias("max_value"), F.col("h.source").alias("high"), "parts")
        columns = [c.split(" ")[0] for c in TOP.split(", ")][:-1]
        kept = self.spark.createDataFrame([tuple(r[c] for c in columns) for r in stay], TOP.rsplit(",", 1)[0])
        ready = new.unionByName(kept).coalesce(1)  # a row a branch
        number = claim(self.spark, f"{self.root}/claims")
        ready.write.parquet(f"{self.root}/top/ordinal={number}")

    def fold(self) -> DataFrame:
        """One row (min_value, max_value, min_index, max_index, parts) over all parts, as ``ranges.dataset_range`` gives it; none without any part."""
        top = self.top().orderBy("first").collect()  # a row a branch
        schema = "min_value double, max_value double, min_index int, max_index int, parts long"
        if not top:
            return self.spark.createDataFrame([], schema)
        low, high = min(top, key=lambda r: (r["min_value"], r["low"])), min(top, key=lambda r: (-r["max_value"], r["high"]))
        ends = self.spark.createDataFrame([tuple(r[c] for c in ("path", "branch", "first")) for r in {x["first"]: x for x in (low, high)}.values()], "path string, branch int, first string")
        before = {r["first"]: sum(x["parts"] for x in top if x["first"] < r["first"]) for r in (low, high)}
        count = lambda branch, name: F.count_if((F.col("first") == branch["first"]) & (F.col("source") < name)) + before[branch["first"]]
        found = self._leaves(ends).agg(count(low, low["low"]).cast("int").alias("min_index"), count(high, high["high"]).cast("int").alias("max_index"))
        total = sum(r["parts"] for r in top)
        return found.select(F.lit(low["min_value"]).alias("min_value"), F.lit(high["max_value"]).alias("max_value"), "min_index", "max_index", F.lit(total).cast("long").alias("parts"))
