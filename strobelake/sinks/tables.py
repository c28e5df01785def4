"""Sequence-partitioned tables with a manifest: a run's partitions count once its manifest row is written.

Under ``root``: ``runs/run=<run>/seq=...`` holds what a run wrote, ``manifest/`` one row for each
(seq, run) that counts. A reader takes each sequence from the newest run named for it,
so a failed run, or one that is taken back, leaves nothing to see. Runs only ever add rows, and each commit claims a
number of its own by a file that must not exist before, so runs at the same time lose nothing of each other.

What a frame measures (its range, whether it is finite) is written beside its pixels: checks and ranges read
those few columns of the files that were committed, never the pixels again, and count a task that ran twice once.
"""

from __future__ import annotations

import os
import re
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from typing import Literal

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strobelake.functions.digests import sequence_digest
from strobelake.functions.pixels import all_finite, finite_max, finite_min

IfPresent = Literal["error", "overwrite", "reuse"]
IfUnsourced = Literal["keep", "delete"]
MANIFEST = "seq string, run string, ordinal long, n_frames long, settings string, digest string, first int"
#: Columns that a stage writes beside those of its frames.
MEASURED = {"_low": "double", "_high": "double", "_finite": "boolean"}
#: n_frames of a manifest row that takes a whole run back.
REVOKED = -1
_SAFE = re.compile(r"[A-Za-z0-9._ -]+\Z")


def check_name(name: str) -> str:
    """A relative path of plain parts."""
    parts = name.split("/")
    if not name or name.startswith("/") or any(p in ("", ".", "..") or not _SAFE.match(p) for p in parts):
        raise ValueError(f"{name!r} is no plain relative path")
    return name


def json_name(name: str) -> str:
    """A document's file name: without folder, .json added where it lacks."""
    if not name or "/" in name or name in (".", ".."):
        raise ValueError(f"{name!r} is no file name")
    return name if name.endswith(".json") else f"{name}.json"


def check_apart(source: str, target: str) -> None:
    """Output must not land on, in or around its source."""
    a, b = (p.rstrip("/") + "/" for p in (source, target))
    if a.startswith(b) or b.startswith(a):
        raise ValueError(f"output {target} overlaps the source {source}")


def check_policies(if_present: str, if_unsourced: str) -> None:
    if if_present not in ("error", "overwrite", "reuse"):
        raise ValueError(f"if_present is error, overwrite or reuse, not {if_present!r}")
    if if_unsourced not in ("keep", "delete"):
        raise ValueError(f"if_unsourced is keep or delete, not {if_unsourced!r}")


def claim(spark: SparkSession, root: str) -> int:
    """A number that no other writer under ``root`` gets: the first for which a new file can be made."""
    jvm = spark._jvm
    folder = jvm.org.apache.hadoop.fs.Path(root)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(folder)
    number = 1 + max([0, *(int(f.getPath().getName()) for f in fs.listStatus(folder) if f.getPath().getName().isdigit())])
    while not _made(fs, jvm.org.apache.hadoop.fs.Path(folder, str(number))):
        number += 1
    return number


def _made(fs: object, path: object) -> bool:
    """Whether this call made a file; Hadoop looks before it makes one on local disks, so there the system's own call is used."""
    if fs.getScheme() != "file":
        return fs.createNewFile(path)
    try:
        os.close(os.open(path.toUri().getPath(), os.O_CREAT | os.O_EXCL))
    except FileExistsError:
        return False
    return True


def read_if_there(spark: SparkSession, schema: str | T.StructType, path: str) -> DataFrame:
    """The table at ``path``, empty where nothing was written yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except Exception as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], schema)


@dataclass
class FrameTable:
    """Frames written by sequence, renumbered from 0, with their provenance."""

    spark: SparkSession
    root: str

    def run_path(self, run: str) -> str:
        return f"{self.root}/runs/run={run}"

    def manifest(self) -> DataFrame:
        """The newest row of each sequence that counts; a row without frames takes its sequence away."""
        rows = read_if_there(self.spark, MANIFEST, f"{self.root}/manifest")
        revoked = rows.where(f"n_frames = {REVOKED}").groupBy(F.col("run").alias("_run")).agg(F.max("ordinal").alias("_until"))  # what the run committed after that counts
        rows = rows.where("seq is not null").join(revoked, (F.col("run") == F.col("_run")) & (F.col("ordinal") <= F.col("_until")), "left_anti")
        newest = F.row_number().over(Window.partitionBy("seq").orderBy(F.desc("ordinal"), F.desc("run")))
        return rows.withColumn("_k", newest).where("_k = 1 and n_frames > 0").drop("_k")

    def present(self, selected: DataFrame) -> DataFrame:
        return self.manifest().join(selected.select("seq").distinct(), "seq", "left_semi").select("seq")

    def open(self, selected: DataFrame, if_present: IfPresent = "error", if_unsourced: IfUnsourced = "keep") -> None:
        """Refuse before anything is read."""
        check_policies(if_present, if_unsourced)
        if if_present == "error":
            found = self.present(selected).orderBy("seq").limit(5).collect()
            if found:
                raise ValueError("already written: " + ", ".join(r["seq"] for r in found))

    def stage(self, frames: DataFrame, settings: str) -> tuple[str, DataFrame]:
        """Write a run and return (run, its manifest rows), which do not count yet.

        Frames without data are left out; gaps between the others, non-finite pixels and
        sequences without frames are refused.
        """
        run = uuid.uuid4().hex
        data = F.col("data")
        measured = frames.where("data is not null").withColumns({"_low": finite_min(data), "_high": finite_max(data), "_finite": all_finite(data)})
        measured.write.partitionBy("seq").parquet(self.run_path(run))
        per = self._written(run).groupBy("seq").agg(
            F.min("idx").alias("first"), (F.max("idx") - F.min("idx") + 1).alias("span"), F.count("*").alias("n_frames"), F.count_if(~F.col("_finite")).alias("bad"),
            sequence_digest(F.col("idx"), F.col("source_name")).alias("digest"),
        )
        faults = per.where("span <> n_frames or bad > 0").orderBy("seq").limit(5).collect()
        empty = frames.select("seq").distinct().join(per.select("seq"), "seq", "left_anti").orderBy("seq").limit(5).collect()
        if faults or empty:
            raise ValueError("; ".join([f"{r['seq']}: " + ("non-finite pixels" if r["bad"] else "a gap between frames") for r in faults] + [f"{r['seq']}: no frame" for r in empty]))
        rows = per.select("seq", F.lit(run).alias("run"), F.lit(0).cast("long").alias("ordinal"), "n_frames", F.lit(settings).alias("settings"), "digest", "first")
        return run, rows

    def _written(self, run: str) -> DataFrame:
        """What a run wrote, without its pixels."""
        return self.spark.read.schema("seq string, idx int, source_name string, " + ", ".join(f"{c} {t}" for c, t in MEASURED.items())).parquet(self.run_path(run))

    def ranges(self, run: str) -> DataFrame:
        """(seq, idx, source, min_value, max_value) of a run's frames, as they were measured while they were written."""
        return self._written(run).select("seq", "idx", F.col("source_name").alias("source"), F.col("_low").alias("min_value"), F.col("_high").alias("max_value"))

    def commit(self, rows: DataFrame) -> None:
        """Make a run's sequences count: one append, the last thing written."""
        ordinal = claim(self.spark, f"{self.root}/claims")
        rows.withColumn("ordinal", F.lit(ordinal).cast("long")).write.mode("append").parquet(f"{self.root}/manifest")

    def revoke(self, runs: DataFrame) -> None:
        """Take whole runs back: what counted before them counts again."""
        empty = {c: F.lit(None).cast(t) for c, t in (x.split(" ") for x in MANIFEST.split(", "))}
        self.commit(runs.select("run").distinct().select(*[{"run": F.col("run"), "n_frames": F.lit(REVOKED).cast("long")}.get(c, v).alias(c) for c, v in empty.items()]))

    def drop(self, sequences: DataFrame) -> None:
        """Take sequences away, leaving older rows in place but overruled."""
        gone = sequences.select("seq", F.lit("").alias("run"), F.lit(0).cast("long").alias("ordinal"), F.lit(0).cast("long").alias("n_frames"), F.lit(None).cast("string").alias("settings"), F.lit(None).cast("string").alias("digest"), F.lit(None).cast("int").alias("first"))
        if not gone.isEmpty():
            self.commit(gone)

    def vacuum(self) -> int:
        """Delete the folders of runs that no manifest row names: leftovers of runs that failed or were replaced."""
        jvm = self.spark._jvm
        root = jvm.org.apache.hadoop.fs.Path(f"{self.root}/runs")
        fs = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(root):
            return 0
        counted = {r["run"] for r in self.manifest().select("run").distinct().collect()}  # one name a run
        stale = [f.getPath() for f in fs.listStatus(root) if f.getPath().getName().removeprefix("run=") not in counted]
        for path in stale:
            fs.delete(path, True)
        return len(stale)

    def read(self, schema: T.StructType) -> DataFrame:
        """Frames of every sequence that counts, idx from 0; run and seq are partitions, so other runs are not read."""
        counted = self.manifest().select("seq", "run", F.coalesce("first", F.lit(0)).alias("_first"))  # a stage leaves no gaps
        every = self.spark.read.schema(T.StructType([*schema.fields, T.StructField("run", T.StringType())])).parquet(f"{self.root}/runs")
        frames = every.join(counted, ["seq", "run"])
        return frames.withColumn("idx", (F.col("idx") - F.col("_first")).cast("int")).select(*schema.names)

    def counts(self) -> DataFrame:
        """(seq) once for every frame that the runs named in the manifest hold; only the partitions' names and row counts are read."""
        every = read_if_there(self.spark, "seq string, run string", f"{self.root}/runs")
        return every.join(self.manifest().select("seq", "run"), ["seq", "run"], "left_semi").select("seq")


def commit_together(staged: Sequence[tuple[FrameTable, DataFrame]], then: Callable[[], None] = lambda: None) -> None:
    """Commit several sinks, and what ``then`` publishes; if one cannot, those that did take theirs back."""
    done: list[tuple[FrameTable, DataFrame]] = []
    try:
        for sink, rows in staged:
            sink.commit(rows)
            done.append((sink, rows))
        then()
    except Exception:
        for sink, rows in done:
            sink.revoke(rows)
        raise
