from __future__ import annotations

import numpy as np
import pytest
from helpers import frames_of, stacks

from strobelake.operators import filters


def brute(window: np.ndarray, kernel) -> np.ndarray:
    t, h, w = window.shape
    out = np.zeros_like(window)
    if kernel.kind == "median":
        places = [(o, 1.0) for o in kernel.offsets()]
    else:
        rx, ry, rz = (int(kernel.truncate * s + 0.5) for s in kernel.sigma)
        g = lambda d, s: np.exp(-d * d / (2 * s * s)) if s else float(d == 0)
        places = [((x, y, z), g(x, kernel.sigma[0]) * g(y, kernel.sigma[1]) * g(z, kernel.sigma[2])) for x in range(-rx, rx + 1) for y in range(-ry, ry + 1) for z in range(-rz, rz + 1)]
    for k in range(t):
        for y in range(h):
            for x in range(w):
                got = [(window[k + dz, y + dy, x + dx], v) for (dx, dy, dz), v in places if 0 <= k + dz < t and 0 <= y + dy < h and 0 <= x + dx < w]
                out[k, y, x] = np.median([g[0] for g in got]) if kernel.kind == "median" else sum(a * b for a, b in got) / sum(b for _, b in got)
    return out


KERNELS = [filters.Median((1, 1, 1), "cuboid"), filters.Median((2, 2, 2), "ellipsoid"), filters.Median((1, 2, 0), "cuboid"), filters.Median((0, 0, 3), "ellipsoid"), filters.Gaussian((0.6, 0.4, 0.5)), filters.Gaussian(0.8), filters.Gaussian((0.5, 0.5, 0.0))]


@pytest.mark.parametrize("kernel", KERNELS, ids=repr)
def test_kernels_agree_with_brute_force(kernel):
    window = np.random.default_rng(0).random((7, 4, 5)).astype(np.float32)
    assert np.allclose(kernel.apply(window), brute(window, kernel), atol=1e-5)


def test_banding_changes_nothing(monkeypatch):
    window = np.random.default_rng(1).random((5, 9, 6)).astype(np.float32)
    kernel = filters.Median((2, 2, 2))
    want = kernel.apply(window)
    for pixels in (1, 7, 30, 1 << 20):
        monkeypatch.setattr(filters, "SELECTED", pixels)
        assert (kernel.apply(window) == want).all()


@pytest.mark.parametrize("chunk", [1, 3, 4, 50])
def test_blocks_with_halo_equal_whole_sequences(spark, chunk):
    rng = np.random.default_rng(2)
    given = {"a": rng.random((11, 3, 4)), "b": rng.random((2, 3, 4)), "c": rng.random((1, 3, 4))}
    frames = frames_of(spark, given)
    for kernel in (filters.Median((1, 1, 2)), filters.Gaussian((0.5, 0.5, 0.5))):
        got = stacks(filters.apply_filter(frames, kernel, chunk))
        for seq, stack in given.items():
            assert np.allclose(got[seq], kernel.apply(stack.astype(np.float32)), atol=1e-6)
    assert filters.apply_filter(frames, filters.Identity()) is frames


def test_relational_median_equals_numpy(spark):
    frames = frames_of(spark, {"a": np.random.default_rng(3).random((4, 3, 5))})
    kernel = filters.Median((1, 1, 1), "ellipsoid")
    rows = filters.median_by_offsets(frames, kernel).orderBy("idx", "y", "x").collect()
    want = kernel.apply(stacks(frames)["a"])
    assert len(rows) == want.size and np.allclose([r["v"] for r in rows], want.ravel(), atol=1e-6)


def test_even_counts_average_and_edges_drop_neighbours():
    column = np.array([1, 2, 10], dtype=np.float32).reshape(1, 3, 1)
    assert filters.Median((0, 1, 0)).apply(column).ravel().tolist() == [1.5, 2.0, 6.0]


def test_special_values():
    spike = np.zeros((1, 5, 5), dtype=np.float32)
    spike[0, 2, 2] = 100
    assert filters.Median((1, 1, 0), "cuboid").apply(spike).max() == 0
    assert 0 < filters.Gaussian((1.0, 1.0, 0.0)).apply(spike)[0, 2, 2] < 100
    assert np.allclose(filters.Gaussian(1.0).apply(np.full((3, 6, 7), 5, dtype=np.float32)), 5)
    assert np.isnan(filters.Median((1, 1, 1)).apply(np.full((1, 4, 5), np.nan, dtype=np.float32))).all()


@pytest.mark.parametrize("radius,sizes", [((1, 1, 0), (9, 5)), ((1, 1, 1), (27, 7)), ((2, 2, 1), (75, 15)), ((2, 2, 2), (125, 33)), ((3, 3, 1), (147, 31)), ((3, 3, 3), (343, 123))])
def test_neighbourhood_sizes(radius, sizes):
    assert tuple(len(filters.Median(radius, s).offsets()) for s in ("cuboid", "ellipsoid")) == sizes


@pytest.mark.parametrize("radius,shape", [((1, 1, 1), "cuboid"), ((2, 2, 2), "ellipsoid"), ((3, 1, 2), "ellipsoid"), ((5, 5, 1), "ellipsoid"), ((0, 0, 0), "cuboid")])
@pytest.mark.parametrize("size", [(7, 4, 5), (1, 1, 1), (3, 9, 8), (2, 1, 6), (4, 12, 13)])
def test_median_is_exactly_that_of_the_sorted_neighbours(radius, shape, size):
    """Ties, even counts, awkward magnitudes, and neighbours that are NaN: bit for bit."""
    rng, kernel = np.random.default_rng(size[1]), filters.Median(radius, shape)
    few, wide = rng.integers(0, 4, size), rng.choice([1e-38, 1e-3, 1.0, 3e38], size) * rng.uniform(-1, 1, size)
    for given in (few, wide, np.where(rng.random(size) < 0.3, np.nan, few), np.where(rng.random(size) < 0.95, np.nan, wide)):
        window = given.astype(np.float32)
        want = np.full(size, np.nan, dtype=np.float32)
        for k, y, x in np.ndindex(*size):
            near = [window[k + dz, y + dy, x + dx] for dx, dy, dz in kernel.offsets() if 0 <= k + dz < size[0] and 0 <= y + dy < size[1] and 0 <= x + dx < size[2]]
            near, n = sorted(v for v in near if v == v), sum(v == v for v in near)
            if n:
                with np.errstate(over="ignore"):
                    want[k, y, x] = near[n // 2] if n % 2 else (near[n // 2 - 1] + near[n // 2]) / np.float32(2)
        with np.errstate(over="ignore"):
            assert np.array_equal(kernel.apply(window), want, equal_nan=True)


def test_ellipsoids_hold_what_lies_within_them():
    from fractions import Fraction

    for radius in ((2, 2, 2), (3, 1, 2), (0, 2, 1), (4, 4, 0), (5, 3, 1), (0, 0, 0)):
        inside = {(x, y, z) for z in range(-6, 7) for y in range(-6, 7) for x in range(-6, 7) if all(abs(d) <= r for d, r in zip((x, y, z), radius)) and sum(Fraction(d, r) ** 2 for d, r in zip((x, y, z), radius) if r) <= 1}
        got = filters.Median(radius).offsets()
        assert set(got) == inside and len(got) == len(inside)


def test_parameters():
    assert filters.Median(2).radius == (2, 2, 2) and filters.Median((2, 1)).radius == (2, 2, 1) and filters.Gaussian(1).sigma == (1.0, 1.0, 1.0)
    for bad, error in ((True, TypeError), (1.5, TypeError), (-1, ValueError), ((1, 2, 3, 4), ValueError)):
        with pytest.raises(error):
            filters.Median(bad)
    with pytest.raises(ValueError):
        filters.Median(1, "ball")
    assert filters.describe(filters.kernel("median", radius=(1, 1, 1), shape="cuboid")) == {"kind": "median", "radius": [1, 1, 1], "shape": "cuboid"}
    with pytest.raises(ValueError):
        filters.kernel("os.system")


def test_registering_a_kernel(spark):
    class Negative:
        kind, reach = "negative", 0

        def apply(self, window):
            return -window

    filters.register("negative", Negative)
    assert (filters.kernel("negative").apply(np.ones((1, 1, 1))) == -1).all()
    with pytest.raises(TypeError):
        filters.register("bad", object)
    del filters.KERNELS["negative"]


@pytest.mark.parametrize("own", [filters.Median((2, 2, 2)), filters.Median((1, 3, 0), "cuboid"), filters.Median((0, 0, 4)), filters.Median((5, 1, 1))], ids=repr)
@pytest.mark.parametrize("values", [filters.SORTED, 700])
def test_small_frames_are_sorted_together(own, values, monkeypatch):
    """What the rectangles give, without a call for each of them: with NaN, infinities, even counts of the largest numbers and few values at once."""
    rng = np.random.default_rng(2)
    window = rng.normal(size=(9, 6, 7)).astype(np.float32)
    window[rng.random(window.shape) < 0.1] = np.nan
    window[3, 2:4, 2:5], window[6, 1, 1:3] = np.inf, (-np.inf, 3e38)
    window[:, 4:, 5:] = np.nan
    monkeypatch.setattr(filters, "SORTED", values)
    calls, select = [], filters.select_middle
    monkeypatch.setattr(filters, "select_middle", lambda samples: calls.append(1) or select(samples))
    got = own.apply(window)
    assert not calls
    monkeypatch.setattr(filters, "SMALL", 0)
    for pixels in (filters.SELECTED, 7):
        monkeypatch.setattr(filters, "SELECTED", pixels)
        assert np.array_equal(got, own.apply(window), equal_nan=True) and calls
