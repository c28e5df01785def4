"""Windows over blocks give what windows over whole sequences give."""

from __future__ import annotations

import numpy as np
import pytest
from helpers import frames_of
from pyspark.sql import Window
from pyspark.sql import functions as F

from strobelake.operators import flow, normalize, windows
from strobelake.plans import fields
from strobelake.sources import tables


@pytest.fixture
def signal(spark):
    rng = np.random.default_rng(0)
    rows = [(s, k, float(v)) for s, n in (("a", 23), ("b", 1), ("c", 7)) for k, v in enumerate(rng.normal(size=n))]
    return spark.createDataFrame(rows, "seq string, idx int, value double")


def rounded(rows):
    return sorted((r["seq"], r["idx"], round(r["value"], 9)) for r in rows.collect())


@pytest.mark.parametrize("size", [1, 3, 7, 100])
def test_blocks_hold_what_their_rows_look_at(signal, size):
    order = Window.partitionBy("seq").orderBy("idx")
    for back, ahead in ((0, 1), (2, 0), (2, 3)):
        want = rounded(signal.withColumn("value", F.sum("value").over(order.rowsBetween(-back, ahead))))
        blocks = windows.in_blocks(signal, back, ahead, size)
        assert rounded(windows.core(blocks.withColumn("value", F.sum("value").over(windows.in_time().rowsBetween(-back, ahead))), size)) == want


def test_moving_windows_over_blocks(signal, monkeypatch):
    want = [rounded(windows.moving_median(signal, 2)), rounded(windows.moving_gaussian(signal, 1.0))]
    monkeypatch.setattr(windows, "SIGNAL_BLOCK", 3)
    assert [rounded(windows.moving_median(signal, 2)), rounded(windows.moving_gaussian(signal, 1.0))] == want


def test_frame_windows_over_blocks(spark, monkeypatch):
    rng = np.random.default_rng(1)
    frames = frames_of(spark, {"a": rng.random((11, 3, 4)), "b": rng.random((1, 3, 4)), "c": rng.random((5, 3, 4))})
    plan = fields.Plan(fields.standard(0.15, 666.0, 0.18, 25.0, 0.04), ["acceleration", "path_change", "dry_mass"])

    def results():
        return (
            sorted(map(str, flow.neighbours(frames).collect())), sorted(map(str, normalize.pairwise(frames).collect())),
            *(sorted(map(str, fields.evaluate(plan, frames, tables.flow_frames(frames), aligned).collect())) for aligned in (True, False)),
        )

    whole = results()
    for module in (flow, normalize, fields):
        monkeypatch.setattr(module, "FRAME_BLOCK", 2)
    assert results() == whole and len(whole[0]) == 14
