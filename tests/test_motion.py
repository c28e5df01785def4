from __future__ import annotations

import numpy as np
import pytest
from helpers import frames_of, texture
from pyspark.sql import functions as F

from strobelake.operators import flow, normalize, score, warp
from strobelake.sources import tables


def test_backward_warp_known_shift_and_padding():
    image = texture().astype(np.float32)
    moved = np.roll(image, (2, 3), axis=(0, 1))
    ones = np.ones_like(image)
    back = warp.backward_warp(moved, 3 * ones, 2 * ones)
    assert np.allclose(back[8:-8, 8:-8], image[8:-8, 8:-8])
    row = np.array([[0.0, 10.0, 20.0]])
    right = np.full((1, 3), 1.5)
    assert warp.backward_warp(row, right, 0 * right).tolist() == [[15.0, 20.0, 20.0]]
    assert warp.backward_warp(row, right, 0 * right, "zeros").tolist() == [[15.0, 10.0, 0.0]]
    assert warp.backward_warp(row, right, 0 * right, "reflection").tolist() == [[15.0, 15.0, 5.0]]
    assert warp.backward_warp(np.array([[0, 1, 2]], dtype=np.uint8), np.full((1, 3), 0.5), np.zeros((1, 3))).tolist() == [[0, 2, 2]]
    with pytest.raises(ValueError):
        warp.backward_warp(row, right, right, "wrap")


@pytest.mark.parametrize("own", [flow.Farneback(), flow.DualTVL1()], ids=lambda o: o.kind)
def test_flow_of_a_shifted_texture(own):
    image = texture()
    dx, dy = own.calc(image, np.roll(image, (2, 3), axis=(0, 1)))
    inside = (slice(12, -12), slice(12, -12))
    assert abs(np.median(dx[inside]) - 3) < 0.5 and abs(np.median(dy[inside]) - 2) < 0.5
    still = own.calc(image, image)
    assert abs(still[0]).max() < 0.1 and abs(still[1]).max() < 0.1


@pytest.mark.parametrize("own", [flow.Farneback(), flow.DualTVL1()], ids=lambda o: o.kind)
def test_pairs_worked_on_together_equal_single_ones(own):
    rng = np.random.default_rng(0)
    prev = (rng.random((5, 20, 17)) * 255).astype(np.uint8)
    curr = np.roll(prev, 1, axis=2)
    curr[2] = prev[2]
    dx, dy = own.calc(prev, curr)
    for k in range(5):
        one = own.calc(prev[k], curr[k])
        assert one[0].shape == (20, 17) and np.array_equal(one[0], dx[k]) and np.array_equal(one[1], dy[k])


def test_farneback_against_a_fit_and_a_solve_for_each_pixel():
    """One level by loops: a least-squares quadratic around each pixel, then a 2 x 2 system of each pixel's window."""
    rng = np.random.default_rng(3)
    own = flow.Farneback(levels=1, window=5, iterations=2, poly_n=2, poly_sigma=1.1)
    one = texture(24)[3:14, 2:15] + 5 * rng.random((11, 13))
    two = np.roll(one, 1, axis=1) + rng.random((11, 13))
    r, half = own.poly_n, own.window // 2
    d = np.arange(-r, r + 1)
    y, x = (v.ravel() for v in np.meshgrid(d, d, indexing="ij"))
    root = np.sqrt(np.exp(-(x**2 + y**2) / (2 * own.poly_sigma**2)))
    basis = np.stack([np.ones_like(x), x, y, x * x, y * y, x * y], axis=1) * root[:, None]

    def quadratics(image):
        wide = np.pad(image, r, mode="edge")
        fits = np.zeros((*image.shape, 5))
        for i, j in np.ndindex(*image.shape):
            c = np.linalg.lstsq(basis, wide[i : i + 2 * r + 1, j : j + 2 * r + 1].ravel() * root, rcond=None)[0]
            fits[i, j] = c[3], c[5] / 2, c[4], c[1], c[2]
        return fits

    f1, f2 = quadratics(one), quadratics(two)
    h, w = one.shape
    flow_xy = np.zeros((h, w, 2))
    for _ in range(own.iterations):
        terms = np.zeros((h, w, 5))
        for i, j in np.ndindex(h, w):
            u = flow_xy[i, j]
            px, py = np.clip(j + u[0], 0, w - 1), np.clip(i + u[1], 0, h - 1)
            j0, i0 = int(px), int(py)
            j1, i1, fx, fy = min(j0 + 1, w - 1), min(i0 + 1, h - 1), px - int(px), py - int(py)
            there = (1 - fy) * ((1 - fx) * f2[i0, j0] + fx * f2[i0, j1]) + fy * ((1 - fx) * f2[i1, j0] + fx * f2[i1, j1])
            xx, xy, yy = (f1[i, j, :3] + there[:3]) / 2
            a = np.array([[xx, xy], [xy, yy]])
            g, rhs = a.T @ a, a.T @ ((f1[i, j, 3:] - there[3:]) / 2 + a @ u)
            terms[i, j] = g[0, 0], g[0, 1], g[1, 1], *rhs
        wide = np.pad(terms, ((half, half), (half, half), (0, 0)), mode="edge")
        for i, j in np.ndindex(h, w):
            m = wide[i : i + 2 * half + 1, j : j + 2 * half + 1].mean(axis=(0, 1))
            flow_xy[i, j] = np.linalg.solve([[m[0], m[1]], [m[1], m[2]]], m[3:])
    dx, dy = own.calc(one, two)
    assert np.allclose(dx, flow_xy[..., 0], atol=1e-3) and np.allclose(dy, flow_xy[..., 1], atol=1e-3)


def test_tvl1_lowers_its_energy():
    """lambda |I1(x + u) - I0(x)| + |grad u| is less than for no flow and for flows beside the one found."""
    own = flow.DualTVL1(scales=1, warps=5, epsilon=0.0)
    image = texture(32).astype(float)
    moved = np.roll(image, 1, axis=1)
    found = np.stack(own.calc(image, moved)).astype(float)

    def energy(u):
        rest = np.abs(warp.backward_warp(moved, *u) - image)
        slopes = [np.gradient(c) for c in u]
        return (own.lambda_ * rest).sum() + sum(np.hypot(*g).sum() for g in slopes)

    noise = np.random.default_rng(0).normal(0, 0.3, found.shape)
    assert energy(found) < 0.5 * energy(0 * found) and all(energy(found) < energy(v) for v in (found + 1, found - 1, found + noise))


def test_estimate_labels_by_the_first_frame(spark):
    image = texture(32)
    frames = frames_of(spark, {"a": np.stack([np.roll(image, k, axis=1) for k in range(4)]), "b": image[None]})
    rows = flow.estimate(flow.neighbours(frames), flow.Farneback()).orderBy("idx").collect()
    assert [(r["seq"], r["idx"]) for r in rows] == [("a", 0), ("a", 1), ("a", 2)]
    assert all(abs(np.median(np.array(r["dx"]).reshape(32, 32)[10:-10, 10:-10]) - 1) < 0.5 for r in rows)


def test_estimators_are_whitelisted():
    assert flow.estimator("farneback", levels=2).levels == 2
    with pytest.raises(NotImplementedError):
        flow.estimator("deepflow")
    with pytest.raises(ValueError):
        flow.estimator("guess")


def test_scores(spark):
    image = texture(32).astype(float)
    frames = frames_of(spark, {"a": np.stack([image, image, image + 10])})
    rows = score.scores(flow.neighbours(frames), "prev", "curr", 255.0).orderBy("idx").collect()
    assert rows[0]["mse"] == 0 and rows[0]["psnr"] == float("inf") and rows[0]["ssim"] == pytest.approx(1)
    assert rows[1]["mse"] == pytest.approx(100) and rows[1]["mae"] == pytest.approx(10) and rows[1]["psnr"] == pytest.approx(10 * np.log10(255**2 / 100)) and rows[1]["ssim"] < 1
    means = score.reduced(score.scores(flow.neighbours(frames), "prev", "curr", 255.0).where("idx = 1"), "seq").first()
    assert means["psnr"] == pytest.approx(rows[1]["psnr"])
    assert score.data_range_of("uint8") == 255 and score.data_range_of("float32", 2) == 2
    with pytest.raises(ValueError):
        score.data_range_of("float32")


def test_warp_consistency_prefers_the_true_flow(spark):
    image = texture(32).astype(float)
    frames = frames_of(spark, {"a": np.stack([image, np.roll(image, 2, axis=1)])})
    pairs = flow.neighbours(frames)
    with_flow = lambda v: pairs.withColumns({"dx": F.array_repeat(F.lit(v).cast("float"), 1024), "dy": F.array_repeat(F.lit(0.0).cast("float"), 1024)})
    true, wrong = (score.warp_consistency(with_flow(v), 255.0).first() for v in (2.0, -2.0))
    assert true["mse"] < wrong["mse"] and true["ssim"] > wrong["ssim"]
    assert score.warp_consistency(pairs.withColumns({"dx": F.lit(None).cast("array<float>"), "dy": F.lit(None).cast("array<float>")}), 255.0).count() == 0


def test_normalisation(spark):
    ramp = np.linspace(-1, 3, 64).reshape(1, 8, 8)
    frames = frames_of(spark, {"a": np.concatenate([ramp, 2 * ramp]), "flat": np.ones((1, 8, 8))})
    own = {(r["seq"], r["idx"]): r["data"] for r in normalize.per_frame(frames).collect()}
    assert own["a", 0][0] == 0 and own["a", 0][-1] == 255 and own["flat", 0] is None
    pair = normalize.pairwise(frames).collect()
    assert len(pair) == 1 and min(pair[0]["curr"]) == 0 and max(pair[0]["curr"]) == 255 and max(pair[0]["prev"]) < 255
    clamped = normalize.injected(frames, (0.0, 1.0), "float32").where("seq = 'a' and idx = 0").first()["data"]
    assert min(clamped) == 0 and max(clamped) == 1
    half = normalize.injected(frames_of(spark, {"h": np.array([[[0.5, 1.5, 2.5, 4.0]]])}), (0.0, 4.0), "uint8", (0.0, 4.0)).first()["data"]
    assert half == [0, 2, 2, 4]  # half to even
    for bad in ((1.0, 1.0), (2.0, 1.0)):
        with pytest.raises(ValueError):
            normalize.injected(frames, bad)
    with pytest.raises(ValueError):
        normalize.target_of("uint8", (0, 300))
    assert normalize.target_of("int16", None) == (-32768, 32767) and normalize.target_of("float32", None) == (0.0, 1.0)


def test_flow_view_is_null_at_the_last_frame(spark):
    rows = tables.flow_frames(frames_of(spark, {"a": np.zeros((3, 2, 2))})).orderBy("idx").collect()
    assert [r["dx"] is None for r in rows] == [False, False, True]
