"""Frames, flows and signals as views of ordinary tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strobelake.functions.pixels import finite_max, finite_min
from strobelake.operators.windows import with_count

#: Pixels of a side, and ids of a label that are ranked together.
SIDE, STRETCH = 8, 1 << 16


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def numbered(rows: DataFrame, key: str, order: list[str], span: Column, total: str | None = None) -> DataFrame:
    """``rows`` with idx, their position from 0 among those of their ``key`` in ``order``, and in ``total`` how many those are.

    ``span`` cuts each key into consecutive stretches by its order (ranges of ids, days). Rows are ranked within a
    stretch and the stretches before it are summed from counts, so that no key is a single task.
    """
    cut = rows.withColumn("_span", span)
    counts = cut.groupBy(key, "_span").agg(F.count("*").alias("_n"))
    whole = Window.partitionBy(key)
    before = F.coalesce(F.sum("_n").over(whole.orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = [F.sum("_n").over(whole).alias(total)] if total else []
    starts = counts.select(F.col(key).alias("_key"), F.col("_span").alias("_start"), before.alias("_before"), *sizes)  # a row a stretch
    own = F.row_number().over(Window.partitionBy(key, "_span").orderBy(*order)) - 1
    same = F.col(key).eqNullSafe(F.col("_key")) & F.col("_span").eqNullSafe(F.col("_start"))
    found = cut.withColumn("_own", own).join(starts, same)
    return found.withColumn("idx", (F.col("_before") + F.col("_own")).cast("int")).drop("_span", "_own", "_before", "_key", "_start")


def phase_frames(spark: SparkSession, sf_dir: str, total: str | None = None) -> DataFrame:
    """Each label's vectors in order of vec_id, as frames of 8 x 8 pixels in radians; with ``total`` also how many its label has."""
    rows = read(spark, sf_dir, "embeddings").select(F.col("label").cast("string").alias("seq"), "vec_id", F.col("embedding").alias("data"))
    rows = numbered(rows, "seq", ["vec_id"], F.floor(F.col("vec_id") / STRETCH), total)
    return rows.select(
        "seq", "idx", F.col("idx").alias("source_idx"), F.format_string("%05d_phase", "idx").alias("source_name"), F.lit(SIDE).alias("height"), F.lit(SIDE).alias("width"),
        F.lit(0.15).alias("pixel_size"), F.lit(2.0e-7).alias("height_scale"), F.lit("rad").alias("unit"), "data", *([total] if total else []),
    )


def phase_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ranges (seq, idx, source, min_value, max_value) of ``phase_frames``, each frame reduced where it is read: no pixel is shuffled to number it."""
    data = F.col("embedding")
    rows = read(spark, sf_dir, "embeddings").select(F.col("label").cast("string").alias("seq"), "vec_id", finite_min(data).alias("min_value"), finite_max(data).alias("max_value"))
    rows = numbered(rows, "seq", ["vec_id"], F.floor(F.col("vec_id") / STRETCH))
    return rows.select("seq", "idx", F.format_string("%05d_phase", "idx").alias("source"), "min_value", "max_value")


def _flow() -> dict[str, Column]:
    """A flow by a fixed formula of idx, x and y; null at the last of n frames."""
    cells = F.sequence(F.lit(0), F.col("height") * F.col("width") - 1)
    x, y = lambda k: k % F.col("width"), lambda k: F.floor(k / F.col("width"))
    dx = F.transform(cells, lambda k: (((x(k) * 3 + F.col("idx") * 2) % 5 - 2) * 0.25).cast("float"))
    dy = F.transform(cells, lambda k: (((y(k) * 2 + F.col("idx")) % 5 - 2) * 0.25).cast("float"))
    last = F.col("idx") == F.col("n") - 1
    return {"dx": F.when(~last, dx), "dy": F.when(~last, dy)}


def flow_frames(frames: DataFrame) -> DataFrame:
    """A flow for each of ``frames`` but the last of a sequence (null there)."""
    return with_count(frames.select("seq", "idx", "height", "width"), "n").withColumns(_flow()).drop("n")


def moving_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``phase_frames`` with their flow beside them: numbered and counted once, and never joined with themselves."""
    return phase_frames(spark, sf_dir, total="n").withColumns(_flow()).drop("n")


def signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's event values in order of time."""
    rows = read(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("seq"), "ts", "event_id", "value")
    return numbered(rows, "seq", ["ts", "event_id"], F.to_date("ts")).select("seq", "idx", "value")
