"""Dense optical flow between neighbouring frames, in numpy inside Arrow tasks.

Farneback's two-frame method by polynomial expansion, and the duality-based TV-L1
method of Zach, Pock and Bischof, each from its paper. Both take (..., H, W) frames:
small frames are worked on together, large ones pair by pair.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strobelake.operators.filters import to_array
from strobelake.operators.warp import backward_warp
from strobelake.operators.windows import FRAME_BLOCK, core, in_blocks, in_time


#: Pixels worked on together.
TOGETHER_PIXELS = 1 << 19


def _correlate(a: np.ndarray, weights: np.ndarray, axis: int) -> np.ndarray:
    """Correlation along one axis (-2 or -1) with the edge repeated."""
    r, n = len(weights) // 2, a.shape[axis]
    pad = [(0, 0)] * a.ndim
    pad[axis] = (r, r)
    wide = np.moveaxis(np.pad(a, pad, mode="edge"), axis, 0)
    out = sum(w * wide[k : k + n] for k, w in enumerate(weights))
    return np.moveaxis(out, 0, axis)


def _both(a: np.ndarray, weights: np.ndarray) -> np.ndarray:
    return _correlate(_correlate(a, weights, -2), weights, -1)


def _resize(a: np.ndarray, shape: tuple[int, int]) -> np.ndarray:
    """Bilinear sampling at the new pixels' centres."""
    h, w = a.shape[-2:]
    y = np.clip((np.arange(shape[0]) + 0.5) * h / shape[0] - 0.5, 0, h - 1)
    x = np.clip((np.arange(shape[1]) + 0.5) * w / shape[1] - 0.5, 0, w - 1)
    y0, x0 = np.floor(y).astype(int), np.floor(x).astype(int)
    y1, x1, fy, fx = np.minimum(y0 + 1, h - 1), np.minimum(x0 + 1, w - 1), (y - y0)[:, None], x - x0
    rows = (1 - fy) * a[..., y0, :] + fy * a[..., y1, :]
    return (1 - fx) * rows[..., x0] + fx * rows[..., x1]


def _grown(u: np.ndarray, shape: tuple[int, int], axis: int) -> np.ndarray:
    """A flow component on a finer grid: its values grow with the pixels along its axis."""
    return _resize(u, shape) * shape[axis] / u.shape[axis]


def _pyramid(a: np.ndarray, levels: int, scale: float, least: int) -> list[np.ndarray]:
    """Images from fine to coarse, each smoothed before it shrinks."""
    out = [a]
    sigma = 0.6 * np.sqrt(1 / scale**2 - 1)
    r = max(1, int(3 * sigma + 0.5))
    weights = np.exp(-(np.arange(-r, r + 1) ** 2) / (2 * sigma**2))
    weights /= weights.sum()
    while len(out) < levels and min(out[-1].shape[-2:]) * scale >= least:
        shape = tuple(max(1, round(n * scale)) for n in out[-1].shape[-2:])
        out.append(_resize(_both(out[-1], weights), shape))
    return out


@dataclass(frozen=True)
class Farneback:
    levels: int = 3
    scale: float = 0.5
    window: int = 15
    iterations: int = 3
    poly_n: int = 5
    poly_sigma: float = 1.2
    kind: str = "farneback"

    def expand(self, a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(A as (xx, xy, yy), b as (x, y)): the quadratic fitted around each pixel by weighted least squares."""
        r = self.poly_n
        d = np.arange(-r, r + 1, dtype=float)
        g = np.exp(-(d**2) / (2 * self.poly_sigma**2))
        g /= g.sum()
        basis = [(0, 0), (1, 0), (0, 1), (2, 0), (0, 2), (1, 1)]  # powers of x and y
        moments = np.array([[(g * d ** (p[0] + q[0])).sum() * (g * d ** (p[1] + q[1])).sum() for q in basis] for p in basis])
        rows = {k: _correlate(a, g * d**k, -2) for k in (0, 1, 2)}
        seen = np.stack([_correlate(rows[py], g * d**px, -1) for px, py in basis])
        fit = np.einsum("ij,j...->i...", np.linalg.inv(moments), seen)
        return np.stack([fit[3], fit[5] / 2, fit[4]]), fit[1:3]

    def calc(self, prev: np.ndarray, curr: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(dx, dy) from prev to curr."""
        pairs = list(zip(*(_pyramid(f.astype(np.float64), self.levels, self.scale, 2 * self.poly_n) for f in (prev, curr))))
        dx = dy = None
        box = np.full(self.window | 1, 1.0 / (self.window | 1))
        for one, two in reversed(pairs):
            if dx is None:
                dx, dy = np.zeros(one.shape), np.zeros(one.shape)
            else:
                dx, dy = _grown(dx, one.shape[-2:], -1), _grown(dy, one.shape[-2:], -2)
            (a1, b1), (a2, b2) = self.expand(one), self.expand(two)
            for _ in range(self.iterations):
                moved = [backward_warp(c, dx, dy) for c in (*a2, *b2)]
                xx, xy, yy = ((p + q) / 2 for p, q in zip(a1, moved[:3]))
                bx = (b1[0] - moved[3]) / 2 + xx * dx + xy * dy
                by = (b1[1] - moved[4]) / 2 + xy * dx + yy * dy
                terms = [xx * xx + xy * xy, xy * (xx + yy), xy * xy + yy * yy, xx * bx + xy * by, xy * bx + yy * by]
                g11, g12, g22, h1, h2 = (_both(t, box) for t in terms)
                det = g11 * g22 - g12 * g12 + 1e-9
                dx, dy = (g22 * h1 - g12 * h2) / det, (g11 * h2 - g12 * h1) / det
        return dx.astype(np.float32), dy.astype(np.float32)


@dataclass(frozen=True)
class DualTVL1:
    tau: float = 0.25
    lambda_: float = 0.05
    theta: float = 0.3
    scales: int = 3
    warps: int = 3
    epsilon: float = 0.005
    scale: float = 0.8
    inner: int = 20
    outer: int = 5
    kind: str = "dual_tvl1"

    def calc(self, prev: np.ndarray, curr: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(dx, dy) from prev to curr; each pair stops by itself."""
        shape = prev.shape
        one, two = (_pyramid(f.reshape(-1, *shape[-2:]).astype(np.float64), self.scales, self.scale, 8) for f in (prev, curr))
        u = None
        for i0, i1 in reversed(list(zip(one, two))):
            n, h, w = i0.shape
            u = np.zeros((2, n, h, w)) if u is None else np.stack([_grown(u[0], (h, w), -1), _grown(u[1], (h, w), -2)])
            p = np.zeros((2, 2, n, h, w))
            gy, gx = np.gradient(i1, axis=(-2, -1)) if min(h, w) > 1 else (np.zeros_like(i1),) * 2
            for _ in range(self.warps):
                wx, wy = backward_warp(gx, *u), backward_warp(gy, *u)
                constant = backward_warp(i1, *u) - wx * u[0] - wy * u[1] - i0
                self._relax(u, p, constant, np.stack([wx, wy]))
        return tuple(c.reshape(shape).astype(np.float32) for c in u)

    def _relax(self, u: np.ndarray, p: np.ndarray, constant: np.ndarray, slope: np.ndarray) -> None:
        """Alternate thresholding and dual steps on u and p in place, until a pair changes little."""
        live = np.arange(u.shape[1])
        v, q, limit, rate = u.copy(), p.copy(), self.lambda_ * self.theta, self.tau / self.theta
        steep = (slope**2).sum(axis=0)
        for _ in range(self.outer * self.inner):
            rho = constant + (slope * v).sum(axis=0)
            step = np.where(rho < -limit * steep, limit, np.where(rho > limit * steep, -limit, -rho / np.maximum(steep, 1e-12)))
            new = v + np.where(steep > 1e-12, step, 0) * slope + self.theta * self._divergence(q)
            ux, uy = np.zeros_like(new), np.zeros_like(new)
            ux[..., :-1], uy[..., :-1, :] = np.diff(new, axis=-1), np.diff(new, axis=-2)
            q = (q + rate * np.stack([ux, uy], axis=1)) / (1 + rate * np.sqrt(ux**2 + uy**2)[:, None])
            moving = ((new - v) ** 2).sum(axis=0).mean(axis=(-2, -1)) >= self.epsilon**2
            v = new
            if not moving.all():
                u[:, live], p[:, :, live] = v, q
                live = live[moving]
                if not len(live):
                    return
                v, q, constant, slope, steep = v[:, moving], q[:, :, moving], constant[moving], slope[:, moving], steep[moving]
        u[:, live], p[:, :, live] = v, q

    @staticmethod
    def _divergence(p: np.ndarray) -> np.ndarray:
        px, py = p[:, 0].copy(), p[:, 1].copy()
        px[..., -1], py[..., -1, :] = 0, 0
        return np.diff(px, axis=-1, prepend=0) + np.diff(py, axis=-2, prepend=0)


ESTIMATORS: dict[str, type] = {"farneback": Farneback, "dual_tvl1": DualTVL1}


def estimator(kind: str, **parameters: object) -> object:
    """An estimator by its recorded kind. DeepFlow has no public implementation here and is refused."""
    if kind == "deepflow":
        raise NotImplementedError("deepflow needs a backend that this package does not ship; register one")
    if kind not in ESTIMATORS:
        raise ValueError(f"no estimator {kind!r}; there are {', '.join(sorted(ESTIMATORS))}")
    return ESTIMATORS[kind](**parameters)


def neighbours(frames: DataFrame, *keep: str) -> DataFrame:
    """(seq, idx, height, width, columns to keep, prev, curr): each frame with the next; none for the last."""
    rows = in_blocks(frames.select("seq", "idx", "height", "width", *keep, F.col("data").alias("prev")), 0, 1, FRAME_BLOCK)
    # A pair costs far more work than its bytes tell, so blocks are dealt over a stated number of tasks, which Spark doesn't merge by size.
    rows = rows.repartition(int(frames.sparkSession.conf.get("spark.sql.shuffle.partitions")), "seq", "_block")
    return core(rows.withColumn("curr", F.lead("prev").over(in_time())), FRAME_BLOCK).where("curr is not null")


def estimate(pairs: DataFrame, own: object) -> DataFrame:
    """(seq, idx, height, width, dx, dy) of each pair, labelled by the first frame; the estimator is used inside the tasks."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            heights, widths = rows.column("height").to_numpy(), rows.column("width").to_numpy()
            out: list = [None] * len(rows)
            for h, w in sorted({(int(h), int(w)) for h, w in zip(heights, widths)}):
                same = np.flatnonzero((heights == h) & (widths == w))
                step = max(1, TOGETHER_PIXELS // max(1, h * w))
                for some in (same[k : k + step] for k in range(0, len(same), step)):
                    part = rows.take(pa.array(some))
                    flows = own.calc(to_array(part.column("prev"), h, w), to_array(part.column("curr"), h, w))
                    for k, dx, dy in zip(some, *flows):
                        out[k] = (dx.ravel(), dy.ravel())
            flows = [pa.array([o[c] for o in out], pa.list_(pa.float32())) for c in (0, 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *flows], names=["seq", "idx", "height", "width", "prev", "curr", "dx", "dy"])

    columns = pairs.select("seq", "idx", "height", "width", "prev", "curr")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in columns.schema.fields) + ", dx array<float>, dy array<float>"
    return columns.mapInArrow(run, schema).select("seq", "idx", "height", "width", "dx", "dy")
