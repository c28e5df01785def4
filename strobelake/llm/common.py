"""Shared helpers: the shared work folder, written tables, and connected components."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def work_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (spark.checkpoint.dir); in local mode a temporary one where that is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="strobelake-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{work_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str, partitions: int | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage and survives lost executors."""
    path = new_path(df.sparkSession, name)
    (df if partitions is None else df.coalesce(partitions)).write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh_names(df: DataFrame, *names: str) -> list[str]:
    """Helper column names that ``df`` does not have, in any case of letters."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def columns_of(df: DataFrame) -> list[Column]:
    """Every column, whatever its name."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


def map_rows(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> DataFrame:
    """``df`` with its rows changed by ``run``, which sees columns c0, c1, ... in their order, for mapInArrow takes no name with a dot."""
    plain = T.StructType([T.StructField(f"c{k}", f.dataType) for k, f in enumerate(df.schema.fields)])
    return df.toDF(*plain.names).mapInArrow(run, plain).toDF(*df.columns)


def byte_texts(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text; a null is an empty text."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def release() -> None:
    """Give memory that a task no longer uses back to the system, for Python workers go on to other tasks."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def _contract(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Union-find over the links of one task, batch by batch: a star for each local component."""
    for batch in batches:
        pairs = np.stack([batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)], axis=1)
        nodes, code = np.unique(pairs, return_inverse=True)
        code = code.reshape(-1, 2)
        root = np.arange(len(nodes))
        while True:
            low = np.minimum(root[code[:, 0]], root[code[:, 1]])
            new = root.copy()
            np.minimum.at(new, root[code[:, 0]], low)
            np.minimum.at(new, root[code[:, 1]], low)
            np.minimum.at(new, code[:, 0], low)
            np.minimum.at(new, code[:, 1], low)
            new = new[new]
            if (new == root).all():
                break
            root = new
        moved = root != np.arange(len(nodes))
        yield pa.RecordBatch.from_arrays([pa.array(nodes[moved]), pa.array(nodes[root[moved]])], names=["a", "b"])


def connected_components(links: DataFrame, name: str = "components") -> DataFrame:
    """(id, component) for every id that has a link to another; component is the smallest id reachable.

    ``links`` has two long columns. Alternates large-star and small-star steps until
    no link changes; every step is a map-side combined minimum by node and an
    equi-join, so a component of any size passes through no single task. Links from
    an id to itself and links with a null are ignored.
    """
    a, b = links.columns[:2]
    edges = links.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")).where("a <> b")
    edges = edges.mapInArrow(_contract, "a long, b long").distinct()
    edges = materialize(edges, name)
    seen = None
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("k"), F.least("a", "m").alias("m"))
        large = both.where("b > a").join(low, F.col("a") == F.col("k")).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("k"), "m")
        pairs = large.join(low, F.col("a") == F.col("k"))
        small = pairs.select(F.explode(F.array(F.struct(F.col("a").alias("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b").where("a <> b").distinct()
        edges = materialize(small, name)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == seen:
            return edges.select(F.col("a").alias("id"), F.col("b").alias("component"))
        seen = now
