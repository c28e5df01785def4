"""Tiles with a halo give what whole frames give."""

from __future__ import annotations

import numpy as np
import pytest
from helpers import frames_of, stacks
from pyspark.sql import functions as F

from strobelake.operators import filters, tiles, warp


@pytest.fixture(scope="module")
def frames(spark):
    rng = np.random.default_rng(0)
    return frames_of(spark, {"a": rng.random((7, 9, 13)), "b": rng.random((2, 4, 4)), "c": rng.random((1, 1, 6))}).cache()


@pytest.mark.parametrize("side", [1, 3, 4, 50])
def test_cut_and_whole(frames, side):
    cut = tiles.cut(frames, side)
    back, want = stacks(tiles.whole(cut, side)), stacks(frames)
    assert all((back[k] == want[k]).all() for k in want)
    assert cut.agg(F.max(F.size("data"))).first()[0] <= side * side and cut.columns == [*frames.columns, "ty", "tx"]
    if side < 9:
        with pytest.raises(Exception, match="don't fill it"):
            tiles.whole(cut.where("not (ty = 0 and tx = 0 and seq = 'a')"), side).collect()


@pytest.mark.parametrize("kernel", [filters.Median((2, 2, 2)), filters.Median((1, 3, 0), "cuboid"), filters.Gaussian((0.6, 0.4, 0.5)), filters.Identity()], ids=repr)
@pytest.mark.parametrize("side,chunk", [(4, 3), (2, 16), (50, 2)])
def test_filters_over_tiles_equal_whole_frames(frames, kernel, side, chunk):
    got = stacks(tiles.whole(tiles.filter_tiles(tiles.cut(frames, side), side, kernel, chunk), side))
    for seq, stack in stacks(frames).items():
        assert np.allclose(got[seq], kernel.apply(stack.astype(np.float32)), atol=1e-6)


def test_missing_neighbours_and_kernels_of_unknown_reach_are_refused(frames):
    with pytest.raises(Exception, match="missing or repeat"):
        tiles.filter_tiles(tiles.cut(frames, 4).where("not (seq = 'a' and idx = 2 and ty = 1 and tx = 1)"), 4, filters.Median((1, 1, 0))).collect()

    class Far:
        kind, reach = "far", 1

        def apply(self, window):
            return window

    with pytest.raises(TypeError):
        tiles.filter_tiles(frames, 4, Far())


@pytest.mark.parametrize("padding", ["border", "zeros", "reflection"])
def test_warped_tiles_equal_warped_frames(spark, frames, padding):
    rng = np.random.default_rng(3)
    flows, want = [], {}
    for (seq, stack), wide in zip(stacks(frames).items(), (6.0, 30.0, 1.0)):
        for k, image in enumerate(stack.astype(np.float32)):
            dx, dy = (rng.uniform(-wide, wide, image.shape).astype(np.float32) for _ in range(2))
            flows.append((seq, k, *image.shape, dx.ravel().tolist(), dy.ravel().tolist()))
            want[seq, k] = warp.backward_warp(image, dx, dy, padding)
    flows.append(("a", 99, 9, 13, None, None))
    rows = spark.createDataFrame(flows, "seq string, idx int, height int, width int, dx array<float>, dy array<float>")
    warped = tiles.warp_tiles(tiles.cut(frames, 4), tiles.cut(rows, 4, ("dx", "dy")), 4, padding)
    assert warped.where("idx = 99 and data is null").count() == 12
    got = tiles.whole(warped.where("idx <> 99"), 4).collect()
    assert len(got) == len(want)
    for r in got:
        assert np.allclose(np.reshape(r["data"], (r["height"], r["width"])), want[r["seq"], r["idx"]], atol=1e-5)


def test_sides_from_bytes():
    assert 4 * 4 * 20 * (tiles.side_for(20, 5) + 10) ** 2 <= tiles.TASK_BYTES < 4 * 4 * 20 * (tiles.side_for(20, 5) + 11) ** 2
    with pytest.raises(ValueError):
        tiles.side_for(1000, 900, 1 << 20)


def test_small_tiles_share_groups(spark):
    """70 frames of small tiles are one block in time, a large tile's blocks stay short; putting frames together needs no group of Python's."""
    from dataclasses import dataclass

    calls = spark.sparkContext.accumulator(0)

    @dataclass(frozen=True)
    class Counted:
        kind: str = "counted"
        reach = 1
        around = (1, 1)

        def apply(self, window):
            calls.add(1)
            return window + 1

    stack = np.random.default_rng(5).random((70, 6, 6)).astype(np.float32)
    some = tiles.cut(frames_of(spark, {"a": stack}), 3)
    done = tiles.whole(tiles.filter_tiles(some, 3, Counted()), 3)
    assert np.allclose(stacks(done)["a"], stack + 1) and calls.value == 4
    assert "FlatMapGroups" not in tiles.whole(some, 3)._jdf.queryExecution().analyzed().toString()
    assert tiles.chunk_for(1000, (2, 2, 2)) == tiles.CHUNK and 4 * 4 * (tiles.chunk_for(3, (2, 2, 2)) + 4) * 49 <= tiles.BLOCK_BYTES


def test_a_tile_twice_does_not_stand_for_a_missing_one(frames):
    """Two tiles of 4 x 4 pixels, one of them twice: as many pixels as the frame has."""
    cut = tiles.cut(frames.where("seq = 'a' and idx = 0"), 4)
    twice = cut.where("not (ty = 0 and tx = 0)").unionByName(cut.where("ty = 0 and tx = 1"))
    with pytest.raises(Exception, match="don't fill it"):
        tiles.whole(twice, 4).collect()


@pytest.mark.parametrize("pixels", [1, 5 * 117, tiles.WARPED])
def test_flow_tiles_of_many_frames_are_warped_together(spark, monkeypatch, pixels):
    """Small frames share a group, whose key is no frame; flows that point far in one frame and nowhere in the next change nothing."""
    monkeypatch.setattr(tiles, "WARPED", pixels)
    rng = np.random.default_rng(4)
    stack = rng.random((12, 9, 13)).astype(np.float32)
    rows, want = [], []
    for k, image in enumerate(stack):
        dx, dy = (rng.uniform(-wide, wide, image.shape).astype(np.float32) for wide in (9.0 * (k % 3), 0.5 * k))
        rows.append(("a", k, *image.shape, dx.ravel().tolist(), dy.ravel().tolist()))
        want.append(warp.backward_warp(image, dx, dy))
    flows = tiles.cut(spark.createDataFrame(rows, "seq string, idx int, height int, width int, dx array<float>, dy array<float>"), 4, ("dx", "dy"))
    images = tiles.cut(frames_of(spark, {"a": stack}), 4)
    warped = tiles.warp_tiles(images, flows, 4)
    assert np.array_equal(stacks(tiles.whole(warped, 4))["a"], np.stack(want).astype(float))
    plan = warped._jdf.queryExecution().sparkPlan().toString()
    own = [line for line in plan[plan.index("FlatMapCoGroupsInArrow") :].splitlines() if "Project [" in line][0]
    assert "_block" in own.split("idx#")[0]
    for gone in ("idx = 4 and ty = 1 and tx = 1", "idx = 5"):
        with pytest.raises(Exception, match=r"frame \d+: tiles that its flow points at are missing"):
            tiles.warp_tiles(images.where(f"not ({gone})"), flows, 4).collect()
