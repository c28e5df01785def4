"""Table schemas and the checks that a frames table must pass before it is computed on."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

FRAMES = T.StructType(
    [
        T.StructField("seq", T.StringType()),
        T.StructField("idx", T.IntegerType()),
        T.StructField("source_idx", T.IntegerType()),
        T.StructField("source_name", T.StringType()),
        T.StructField("height", T.IntegerType()),
        T.StructField("width", T.IntegerType()),
        T.StructField("pixel_size", T.DoubleType()),
        T.StructField("height_scale", T.DoubleType()),
        T.StructField("unit", T.StringType()),
        T.StructField("data", T.ArrayType(T.FloatType())),
    ]
)
FLOWS = T.StructType(
    [
        T.StructField("seq", T.StringType()),
        T.StructField("idx", T.IntegerType()),
        T.StructField("height", T.IntegerType()),
        T.StructField("width", T.IntegerType()),
        T.StructField("dx", T.ArrayType(T.FloatType())),
        T.StructField("dy", T.ArrayType(T.FloatType())),
    ]
)
FRAME_PART = T.StructType([T.StructField("source", T.StringType()), T.StructField("min_value", T.DoubleType()), T.StructField("max_value", T.DoubleType())])
SEQUENCE_RANGES = T.StructType(
    [
        T.StructField("source", T.StringType()),
        T.StructField("min_value", T.DoubleType()),
        T.StructField("max_value", T.DoubleType()),
        T.StructField("min_index", T.IntegerType()),
        T.StructField("max_index", T.IntegerType()),
        T.StructField("frames", T.ArrayType(FRAME_PART)),
        T.StructField("settings", T.StringType()),
    ]
)

#: The span of each integer frame type.
INTEGER_SPANS = {"uint8": (0, 255), "int8": (-128, 127), "int16": (-32768, 32767), "int32": (-(2**31), 2**31 - 1)}
#: Spark has no unsigned byte: uint8 frames are held as shorts.
SPARK_TYPES = {"uint8": "short", "int8": "tinyint", "int16": "smallint", "int32": "int", "float32": "float"}


def shape_faults(frames: DataFrame) -> DataFrame:
    """(seq, fault) of sequences whose frames have several shapes, or data of another size than their shape."""
    per = frames.groupBy("seq").agg(F.countDistinct("height", "width").alias("shapes"), F.sum((F.size("data") != F.col("height") * F.col("width")).cast("int")).alias("wrong"))
    return per.where("shapes > 1 or wrong > 0").select("seq", F.when(F.col("wrong") > 0, "data does not fill the shape").otherwise("frames differ in shape").alias("fault"))


def validate(frames: DataFrame) -> DataFrame:
    """``frames`` if every sequence has one shape that its data fills, else ValueError."""
    found = shape_faults(frames).orderBy("seq").limit(5).collect()
    if found:
        raise ValueError("; ".join(f"{r['seq']}: {r['fault']}" for r in found))
    return frames
