"""The range document: settings, coverage and the folded range, as strict JSON.

The document is one file for one reader. It is written as a stream: the parts of the
sequences come to the writer in order of name, a partition at a time, and are never
held together.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strobelake.operators.ranges import dataset_range
from strobelake.plans.incremental import check_coverage, coverage_counts, uncovered
from strobelake.sinks.tables import json_name

_PART = ("source", "min_value", "max_value", "min_index", "max_index")


def _strict(value: object) -> str:
    return json.dumps(value, allow_nan=False)


def document(settings: Mapping, flags: DataFrame, parts: DataFrame, frames: DataFrame, source: str) -> Iterator[str]:
    """The JSON text piece by piece; without any part there is no data set block.

    ``flags`` are the sequences found (``covered``), ``parts`` a row a sequence, ``frames`` (source, idx, name, min_value, max_value).
    """
    counts = coverage_counts(flags).first().asDict()
    check_coverage(counts)
    yield f'{{"settings": {_strict(dict(settings))},\n"coverage": {_strict({k: counts[k] for k in ("found", "selected", "covered", "reused")})[:-1]}'
    for name, chosen in (("skipped", True), ("unselected", False)):
        yield f', "{name}": ['
        for k, row in enumerate(uncovered(flags, chosen).toLocalIterator() if counts[name] else ()):
            yield (", " if k else "") + _strict(row["seq"])
        yield "]"
    yield "}"
    whole = dataset_range(parts.select(F.col("source").alias("seq"), "min_value", "max_value")).first()
    if whole is not None:
        folded = {"source": source} | {k: whole[k] for k in _PART[1:]}
        yield f',\n"dataset": {_strict(folded)[:-1]}, "sequences": ['
        own = frames.select(F.col("source").alias("_source"), "idx", "name", F.col("min_value").alias("_low"), F.col("max_value").alias("_high"))
        now = None
        for row in parts.select(*_PART).join(own, F.col("source") == F.col("_source")).orderBy("source", "idx").toLocalIterator():
            if row["source"] != now:
                yield ("]},\n" if now is not None else "\n") + _strict({k: row[k] for k in _PART})[:-1] + ', "frames": ['
            yield (", " if row["source"] == now else "") + _strict({"source": row["name"], "min_value": row["_low"], "max_value": row["_high"]})
            now = row["source"]
        yield ("]}" if now is not None else "") + "]}"
    yield "}\n"


def save_document(spark: SparkSession, root: str, name: str, text: Iterator[str]) -> str:
    """Write under a hidden temporary name and rename, through Hadoop's file system; what was there before stays, under a hidden name, until the new one is."""
    path = f"{root.rstrip('/')}/{json_name(name)}"
    jvm, target = spark._jvm, spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    temporary, before = (jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/.{json_name(name)}.{uuid.uuid4().hex}.{end}") for end in ("tmp", "old"))
    out = fs.create(temporary, True)
    try:
        for piece in text:
            out.write(bytearray(piece.encode()))
    finally:
        out.close()
    replaced = fs.exists(target) and fs.rename(target, before)
    if not fs.rename(temporary, target):
        if replaced:
            fs.rename(before, target)
        raise OSError(f"cannot move {temporary.toString()} to {path}")
    fs.delete(before, False)
    return path


def read_document(spark: SparkSession, path: str) -> str:
    """The text of a document."""
    return spark.read.text(path, wholetext=True).first()[0]
