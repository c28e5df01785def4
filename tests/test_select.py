from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import Window
from helpers import frames_of
from pyspark.sql import functions as F

from strobelake.sources import tables
from strobelake.schema import validate
from strobelake.sources import select as sel


@pytest.fixture(scope="module")
def frames(spark):
    return frames_of(spark, {"b/two": np.ones((10, 2, 3)), "a": np.zeros((4, 2, 3)), "c": np.full((7, 2, 3), 2.0)})


@pytest.mark.parametrize("start,step,count,want", [(0, 1, None, list(range(10))), (1, 3, 2, [1, 4]), (8, 4, 5, [8]), (20, 1, None, []), (0, 2, None, [0, 2, 4, 6, 8]), (9, 1, 1, [9]), (0, 100, None, [0]), (3, 1, 3, [3, 4, 5]), (0, 5, 10, [0, 5])])
def test_frame_selection_agrees_with_its_predicate(frames, start, step, count, want):
    rows = sel.select_frames(frames.where("seq = 'b/two'"), start, step, count).orderBy("idx").collect()
    assert [r["source_idx"] for r in rows] == want
    assert [r["idx"] for r in rows] == list(range(len(want)))


@pytest.mark.parametrize("bad", [(-1, 1, None), (0, 0, None), (0, 1, 0)])
def test_bad_selections_are_refused(bad):
    with pytest.raises(ValueError):
        sel.check_selection(*bad)


def test_selection_reaches_the_scan(spark, frames, tmp_path):
    frames.write.parquet(str(tmp_path / "f"))
    plan = sel.select_frames(spark.read.parquet(str(tmp_path / "f")), 2, 1, 3).select("seq")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(source_idx,2)" in plan and "LessThan(source_idx,5)" in plan and "data" not in plan.split("ReadSchema")[1]


def test_include_and_exclude(spark, frames, tmp_path):
    listed = tmp_path / "names.txt"
    listed.write_text("a\n\n c \n")
    seqs = lambda df: sorted(r["seq"] for r in df.select("seq").distinct().collect())
    assert seqs(sel.select_sequences(frames, ["a", "c"], ["c"])) == ["a"]
    assert seqs(sel.select_sequences(frames, str(listed))) == ["a", "c"]
    assert seqs(sel.select_sequences(frames, None, ["a"])) == ["b/two", "c"]
    with pytest.raises(ValueError):
        sel.select_sequences(frames, [])
    with pytest.raises(Exception):
        sel.select_sequences(frames, str(tmp_path / "missing.txt")).collect()


def test_short_sequences(frames):
    taken = sel.select_frames(frames, 0, 1, 5)
    assert sel.require_count(frames, taken, 5, "take") is taken
    with pytest.raises(ValueError, match=r"a \(4\)"):
        sel.require_count(frames, taken, 5, "error")
    with pytest.raises(ValueError, match="no frame is left of a"):
        sel.require_count(frames, sel.select_frames(frames, 4), None)


def test_gaps(frames):
    assert sel.gaps(frames, 0).count() == 0
    holes = frames.where("not (seq = 'c' and source_idx = 3)")
    assert [r["seq"] for r in sel.gaps(holes).collect()] == ["c"]
    assert {r["seq"] for r in sel.gaps(frames, 1).collect()} == {"a", "b/two", "c"}
    assert [r["seq"] for r in sel.gaps(frames.union(frames.where("seq = 'a' and idx = 0"))).collect()] == ["a"]


def test_nonfinite_frames_refuse_their_sequence(frames):
    broken = frames.withColumn("data", F.when((F.col("seq") == "c") & (F.col("idx") == 2), F.array(*[F.lit(1e300)] * 6).cast("array<float>")).otherwise(F.col("data")))
    fine, refused = sel.split_finite(broken)
    assert {r["seq"] for r in fine.select("seq").distinct().collect()} == {"a", "b/two"}
    assert [(r["seq"], r["reason"]) for r in refused.collect()] == [("c", "non-finite pixels in 00002_phase")]


def test_shapes_are_checked(spark, frames):
    validate(frames)
    with pytest.raises(ValueError, match="differ in shape"):
        validate(frames.withColumn("height", F.when(F.col("idx") == 1, 3).otherwise(F.col("height"))).withColumn("width", F.when(F.col("idx") == 1, 2).otherwise(F.col("width"))))
    with pytest.raises(ValueError, match="does not fill"):
        validate(frames.withColumn("height", F.lit(5)))


def test_contents_and_empty(spark, frames):
    got = {r["seq"]: r["frames"] for r in sel.contents(frames).collect()}
    assert got["a"] == [f"{k:05d}_phase" for k in range(4)]
    assert sel.contents(frames.limit(0)).count() == 0


def test_positions_by_stretches_are_those_of_a_window(spark):
    """Ranks within stretches and counts before them give row numbers, nulls and one large key included."""
    rows = [("big" if k % 3 else None if k % 5 == 0 else f"s{k % 4}", (k * 37) % 1009 - 200) for k in range(1009)]
    frame = spark.createDataFrame(rows, "seq string, n long").repartition(7)
    got = tables.numbered(frame, "seq", ["n"], F.floor(F.col("n") / 50))
    order = Window.partitionBy("seq").orderBy("n")
    want = frame.withColumn("idx", (F.row_number().over(order) - 1).cast("int"))
    assert got.columns == ["seq", "n", "idx"] and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
