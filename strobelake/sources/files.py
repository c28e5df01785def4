"""Frame and flow files: discovery, array files, and the three depths of validation."""

from __future__ import annotations

import ast
import io
import re
from collections.abc import Iterable, Iterator
from typing import Literal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strobelake.schema import FLOWS

#: Bytes of an array file read for its header; longer headers take one more read.
HEADER_BYTES = 256
ARRAYS = "seq string, idx int, source_name string, height int, width int, dtype string, fault string, data array<float>"


def discover(spark: SparkSession, root: str, subpath: str = "", pattern: str = "*.npy") -> DataFrame:
    """(seq, source_name, source_idx, path, bytes) of the files under ``root``; a sequence is the path between root and subpath.

    Only names are listed; contents are not read. The number in a name gives source_idx.
    With a subpath, what lies inside a sequence is part of it and no sequence of its own.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root).select("path", F.col("length").alias("bytes"))
    base = spark._jvm.org.apache.hadoop.fs.Path(root).toUri().getPath().rstrip("/")
    local = F.regexp_replace("path", r"^[a-z0-9]+:/+", "/")
    inner = F.substring(local, len(base) + 2, 1 << 20)
    folder, name = F.regexp_extract(inner, r"^(?:(.*)/)?([^/]*)$", 1), F.regexp_extract(inner, r"([^/]*)$", 1)
    tail = subpath.strip("/")
    found = files.select("path", "bytes", folder.alias("folder"), name.alias("source_name"))
    if tail:
        found = found.where((F.col("folder") == tail) | F.col("folder").endswith("/" + tail))
        found = found.withColumn("folder", F.expr(f"left(folder, greatest(length(folder) - {len(tail) + 1}, 0))"))
    rows = found.select(F.col("folder").alias("seq"), "source_name", F.try_to_number(F.regexp_extract("source_name", r"([0-9]+)", 1), F.lit("9999999999")).cast("int").alias("source_idx"), "path", "bytes")
    if tail:
        above = F.filter(F.transform(F.sequence(F.lit(0), F.size(F.split("seq", "/"))), lambda k: F.array_join(F.slice(F.split("seq", "/"), F.lit(1), k), "/")), lambda f: f != F.col("seq"))
        sequences = rows.select("seq").distinct()  # a row a sequence
        inner_ones = sequences.select("seq", F.explode(above).alias("outer")).join(sequences.select(F.col("seq").alias("outer")), "outer", "left_semi")
        rows = rows.join(inner_ones.select("seq").distinct(), "seq", "left_anti")
    if rows.isEmpty():
        raise ValueError(f"no sequence under {root} holds {subpath or pattern}")
    return rows


def npy_header(raw: bytes) -> tuple[tuple[int, ...], str, int]:
    """(shape, dtype, offset of the data) of versions 1 and 2 in C order, without touching the data."""
    if raw[:6] != b"\x93NUMPY" or raw[6] not in (1, 2):
        raise ValueError("no array file of version 1 or 2")
    wide = 2 if raw[6] == 1 else 4
    size = int.from_bytes(raw[8 : 8 + wide], "little")
    fields = ast.literal_eval(raw[8 + wide : 8 + wide + size].decode("latin1"))
    if fields["fortran_order"]:
        raise ValueError("the array is in Fortran order")
    return tuple(fields["shape"]), fields["descr"], 8 + wide + size


def read_head(file: object) -> bytes:
    """The first bytes of an open array file, as many as its header has."""
    raw = file.read(HEADER_BYTES)
    if len(raw) == HEADER_BYTES and raw[:6] == b"\x93NUMPY":
        raw += file.read(max(0, 12 + int.from_bytes(raw[8 : 10 if raw[6] == 1 else 12], "little") - len(raw)))
    return raw


def file_number(name: str) -> int | None:
    """The first number in a file's name, if it is one that an index can be."""
    found = re.search("[0-9]+", name)
    return int(found[0]) if found and len(found[0]) <= 10 and int(found[0]) < 1 << 31 else None


def npy_bytes(array: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.save(out, array, allow_pickle=False)
    return out.getvalue()


def described(raw: bytes, channels: int, with_data: bool, size: int | None = None) -> tuple[int | None, int | None, str | None, str | None, list | None]:
    try:
        shape, dtype, at = npy_header(raw)
        if len(shape) != (3 if channels > 1 else 2) or (channels > 1 and shape[0] != channels) or min(shape) < 1:
            return None, None, dtype, f"shape {shape}", None
        if dtype not in ("<f4", "|f4"):
            return *shape[-2:], dtype, f"type {dtype}", None
        if not with_data:
            return *shape[-2:], dtype, None if size in (None, at + 4 * int(np.prod(shape))) else "the file is cut short", None
        data = np.frombuffer(raw, dtype="<f4", offset=at)
        if len(data) != int(np.prod(shape)):
            return *shape[-2:], dtype, "the file is cut short", None
        return *shape[-2:], dtype, None if np.isfinite(data).all() else "non-finite values", data
    except (ValueError, SyntaxError, KeyError, IndexError) as error:
        return None, None, None, str(error), None


_TYPES = [pa.string(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.list_(pa.float32())]
_NAMES = ["seq", "idx", "source_name", "height", "width", "dtype", "fault", "data"]


def read_headers(files: DataFrame, channels: int = 1) -> DataFrame:
    """Files of ``discover`` with shape, type and fault, and no data: only the first bytes of each are read, and the size that is known is held against them.

    Paths must be in a scheme that pyarrow.fs opens.
    """
    import pyarrow.fs

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for seq, idx, name, path, size in zip(*(c.to_pylist() for c in batch.columns)):
                fs, own = pyarrow.fs.FileSystem.from_uri(path)
                with fs.open_input_stream(own, compression=None, buffer_size=0) as file:
                    raw = read_head(file)
                rows.append((seq, idx, name, *described(raw, channels, False, size)))
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(list(zip(*rows)) or [[]] * len(_TYPES), _TYPES)], names=_NAMES)

    return files.select("seq", F.col("source_idx").alias("idx"), "source_name", "path", "bytes").mapInArrow(run, ARRAYS)


def read_arrays(spark: SparkSession, root: str, channels: int = 1, pixels: bool = True) -> DataFrame:
    """Array files under ``root`` with shape, type, fault and, if wanted, pixels, each file read once where its task runs; a file at fault has no pixels."""
    from strobelake.sources import array_files

    array_files.register(spark)
    return spark.read.format("array_files").option("channels", channels).option("pixels", str(pixels).lower()).load(root)


def read_flows(spark: SparkSession, root: str, on_nonfinite: Literal["error", "null"] = "error") -> DataFrame:
    """Flow files (2, H, W) as flows; a file at fault refuses the read, or is null where only its values are."""
    arrays = read_arrays(spark, root, channels=2)
    bad = arrays.where("fault is not null" + (" and fault <> 'non-finite values'" if on_nonfinite == "null" else "")).select("source_name", "fault").limit(3).collect()
    if bad:
        raise ValueError("; ".join(f"{r['source_name']}: {r['fault']}" for r in bad))
    return arrays.select("seq", "idx", "height", "width", "dx", "dy").to(FLOWS)


def flow_faults(spark: SparkSession, root: str, level: Literal["names", "headers", "data"] = "headers") -> DataFrame:
    """(seq, fault) of flow folders: by file numbers, then also by shapes and types, then also by values."""
    if level not in ("names", "headers", "data"):
        raise ValueError(f"level is names, headers or data, not {level!r}")
    per = discover(spark, root).groupBy("seq").agg(F.min("source_idx").alias("first"), F.max("source_idx").alias("last"), F.count("*").alias("n"))
    faults = per.where("last - first + 1 <> n or first is null").select("seq", F.lit("file numbers have gaps").alias("fault"))
    if level == "names":
        return faults
    arrays = read_arrays(spark, root, channels=2, pixels=level == "data")
    shapes = arrays.where("fault is null").groupBy("seq").agg(F.countDistinct("height", "width").alias("n")).where("n > 1").select("seq", F.lit("shapes differ").alias("fault"))
    return faults.unionByName(arrays.where("fault is not null").select("seq", F.concat("source_name", F.lit(": "), "fault").alias("fault"))).unionByName(shapes)


def write_flow_files(flows: DataFrame, root: str, overwrite: bool = False) -> None:
    """Each flow as <seq>/<idx>_flow.npy, committed together; flows that are null are left out, and none at all is refused."""
    from strobelake.sources import array_files

    if flows.where("dx is not null").isEmpty():
        raise ValueError("there is no flow to write")
    array_files.register(flows.sparkSession)
    flows.where("dx is not null and dy is not null").write.format("array_files").option("channels", 2).mode("overwrite" if overwrite else "append").save(root)
