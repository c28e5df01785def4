"""The two-level range fold, and frames that are cached or computed."""

from __future__ import annotations

import random

import numpy as np
import pytest
from helpers import frames_of, stacks

from strobelake.operators import filters, ranges
from strobelake.plans import views
from strobelake.plans.range_tree import RangeTree
from strobelake.sinks.tables import FrameTable

PARTS = "source string, min_value double, max_value double"


def folded(spark, parts):
    rows = spark.createDataFrame([(k, *v) for k, v in parts.items()], PARTS).withColumnRenamed("source", "seq")
    return [tuple(r) for r in ranges.dataset_range(rows).collect()]


@pytest.mark.parametrize("branch_rows", [4, 1000])
def test_changes_refold_their_branches_alone(spark, tmp_path, branch_rows):
    """Adding, replacing and deleting parts, with many ties, equals the fold over all."""
    rng, tree, parts = random.Random(branch_rows), RangeTree(spark, f"file://{tmp_path}/t", branch_rows), {}
    frame = lambda p: spark.createDataFrame([(k, *map(float, v)) for k, v in p.items()], PARTS)
    assert tree.fold().count() == 0
    value = lambda: (rng.randrange(-3, 1), rng.randrange(1, 4))
    for step in range(5):
        more = {f"s{rng.randrange(10_000):05d}": value() for _ in range(40 if step == 0 else 6)}
        gone = rng.sample(sorted(set(parts) - set(more)), min(3, len(set(parts) - set(more)))) if step > 1 else []
        read = tree.update(frame(more), spark.createDataFrame([(g,) for g in gone], "source string") if gone else None)
        parts = {k: v for k, v in parts.items() if k not in gone} | more
        assert [tuple(r) for r in tree.fold().collect()] == folded(spark, {k: tuple(map(float, v)) for k, v in parts.items()})
        assert step == 0 or branch_rows > 100 or read <= 9 * 2 * branch_rows < len(parts) * 3
    one = tree.update(frame({"s05000": (-9, 9)}))
    assert one <= 2 * branch_rows and tree.fold().first()["min_value"] == -9.0
    if branch_rows == 4:
        many = {f"s05{k:03d}x": (0.0, 1.0) for k in range(20)}
        tree.update(frame(many))
        assert tree.top().agg({"parts": "max"}).first()[0] <= 2 * branch_rows
        assert tree.fold().first()["parts"] == len(parts | {"s05000": 0} | many)


def test_a_bulk_load_builds_the_tree_anew(spark, tmp_path):
    tree = RangeTree(spark, f"file://{tmp_path}/t", 8)
    tree.update(spark.createDataFrame([("m", 0.0, 1.0)], PARTS))
    parts = {f"k{n:03d}": (float(n % 7), float(n % 11)) for n in range(100)}
    tree.update(spark.createDataFrame([(k, *v) for k, v in parts.items()], PARTS))
    assert [tuple(r) for r in tree.fold().collect()] == folded(spark, parts | {"m": (0.0, 1.0)}) and tree.top().count() > 5


def test_cached_or_computed_equals_all_computed(spark, tmp_path):
    rng, kernel = np.random.default_rng(0), filters.Median((1, 1, 1))
    frames = frames_of(spark, {s: rng.random((4, 3, 3)) for s in "abcd"})
    sink = FrameTable(spark, f"file://{tmp_path}/t")
    want = stacks(filters.apply_filter(frames, kernel))
    half = filters.apply_filter(frames.where("seq in ('a', 'b')"), kernel)
    sink.commit(sink.stage(half, "{}")[1])
    sink.commit(sink.stage(frames.where("seq = 'c'"), '{"other": 1}')[1])  # made under other settings
    assert {r["seq"] for r in views.cached_sequences(sink, frames, "{}").collect()} == {"a", "b"}
    got = stacks(views.cached_or_computed(sink, frames, kernel, "{}"))
    assert got.keys() == want.keys() and all(np.allclose(got[k], want[k], atol=1e-6) for k in want)
    changed = frames.where("not (seq = 'a' and idx = 3)")  # a source that lost a frame is computed again
    assert {r["seq"] for r in views.cached_sequences(sink, changed, "{}").collect()} == {"b"}
    assert stacks(views.cached_or_computed(sink, changed, kernel, "{}"))["a"].shape[0] == 3
