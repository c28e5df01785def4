"""Neighbourhood filters over (x, y, t): identity, median and Gaussian.

The unit of work is a block of ``chunk`` frames of one sequence with a halo of as many
frames as the kernel reaches in time, so that a long sequence spreads over many
tasks and no task holds more than chunk + 2 radius frames. Each output depends
only on the frames within the radius, so blocks give what whole sequences give.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass
from typing import Literal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strobelake.operators.windows import gaussian_weights, middle

#: Pixels whose neighbours are selected from at once: few enough that a processor's cache holds them.
SELECTED = 1 << 14
#: Frames of at most so many pixels are sorted place by place, this many values at once.
SMALL, SORTED = 1 << 13, 1 << 20
CHUNK = 32


def triple(value: object, *, whole: bool) -> tuple:
    """(x, y, t) from one number, (space, time) or (x, y, t); radii are whole, nothing is negative."""
    parts = tuple(value) if isinstance(value, (tuple, list)) else (value,)
    if len(parts) not in (1, 2, 3):
        raise ValueError(f"{value!r}: give one number, (space, time) or (x, y, t)")
    for p in parts:
        if isinstance(p, bool) or not isinstance(p, int if whole else (int, float)):
            raise TypeError(f"{p!r} is no {'whole ' if whole else ''}number")
        if p < 0 or not math.isfinite(p):
            raise ValueError(f"{p!r} is negative or not finite")
    full = {1: parts * 3, 2: (parts[0], parts[0], parts[-1]), 3: parts}[len(parts)]
    return full if whole else tuple(map(float, full))


@dataclass(frozen=True)
class Identity:
    kind: str = "identity"
    reach = 0

    def apply(self, window: np.ndarray) -> np.ndarray:
        return window.copy()


@dataclass(frozen=True)
class Median:
    """The median of the neighbours that exist; a box, or the ellipsoid within it."""

    radius: object = (2, 2, 2)
    shape: Literal["cuboid", "ellipsoid"] = "ellipsoid"
    kind: str = "median"

    def __post_init__(self) -> None:
        object.__setattr__(self, "radius", triple(self.radius, whole=True))
        if self.shape not in ("cuboid", "ellipsoid"):
            raise ValueError(f"shape is cuboid or ellipsoid, not {self.shape!r}")

    @property
    def reach(self) -> int:
        return self.radius[2]

    def offsets(self) -> list[tuple[int, int, int]]:
        """(dx, dy, dt) of the neighbourhood, from how far each of its rows reaches."""
        rx, ry, rz = self.radius
        if self.shape == "cuboid":
            reach = {(dy, dz): rx for dz in range(-rz, rz + 1) for dy in range(-ry, ry + 1)}
        else:  # in whole numbers: (dx ry rz)^2 <= (rx ry rz)^2 - (dy rx rz)^2 - (dz rx ry)^2, an axis without radius counting as one of radius 1
            ux, uy, uz = (max(r, 1) for r in self.radius)
            left = {(dy, dz): (ux * uy * uz) ** 2 - (dy * ux * uz) ** 2 - (dz * ux * uy) ** 2 for dz in range(-rz, rz + 1) for dy in range(-ry, ry + 1)}
            reach = {row: min(rx, math.isqrt(rest) // (uy * uz)) for row, rest in left.items() if rest >= 0}
        return [(dx, dy, dz) for (dy, dz), most in reach.items() for dx in range(-most, most + 1)]

    def apply(self, window: np.ndarray) -> np.ndarray:
        """Every frame of a (T, H, W) window filtered over the whole window.

        Pixels near an edge lack the same neighbours as those beside them, so a frame falls into rectangles in which
        all have the same ones; each is selected by itself, a few rows at a time. A small frame has so few pixels in
        each that the calls would cost more than the work: there many frames are sorted together.
        """
        window = np.ascontiguousarray(window, dtype=np.float32)
        (rx, ry, _), (t, h, w), offsets = self.radius, window.shape, self.offsets()
        if h * w <= SMALL:
            return self._sorted(window, offsets)
        out = np.empty_like(window)
        for k in range(t):
            there = [o for o in offsets if 0 <= k + o[2] < t]
            for top, bottom in _stretches(h, ry):
                for left, right in _stretches(w, rx):
                    own = [(dx, dy, dz) for dx, dy, dz in there if 0 <= top + dy and bottom + dy <= h and 0 <= left + dx and right + dx <= w]
                    step = max(1, SELECTED // (right - left))
                    for y in range(top, bottom, step):
                        end = min(bottom, y + step)
                        out[k, y:end, left:right] = select_middle([window[k + dz, y + dy : end + dy, left + dx : right + dx] for dx, dy, dz in own])
        self._mend(window, out, offsets)
        return out

    def _sorted(self, window: np.ndarray, offsets: list[tuple[int, int, int]]) -> np.ndarray:
        """The same from the sorted neighbours of each pixel; those outside are NaN, which come last and are not counted."""
        (rx, ry, rz), (t, h, w), n = self.radius, window.shape, len(offsets)
        wide = np.pad(window, ((rz, rz), (ry, ry), (rx, rx)), constant_values=np.nan)
        out = np.empty_like(window)
        places = max(1, SORTED // n)
        high = min(h, max(1, places // max(1, w)))
        deep = max(1, places // max(1, h * w)) if high == h else 1
        for k in range(0, t, deep):
            for y in range(0, h, high):
                d, e = min(deep, t - k), min(high, h - y)
                seen = np.empty((d, e, w, n), dtype=np.float32)
                for i, (dx, dy, dz) in enumerate(offsets):
                    seen[..., i] = wide[k + rz + dz : k + rz + dz + d, y + ry + dy : y + ry + dy + e, rx + dx : rx + dx + w]
                seen.sort(axis=-1)
                count = n - np.isnan(seen).sum(axis=-1)
                below, above = np.maximum(count - 1, 0) // 2, np.minimum(count // 2, n - 1)  # without numbers both find NaN
                low, upper = (np.take_along_axis(seen, at[..., None], axis=-1)[..., 0] for at in (below, above))
                out[k : k + d, y : y + e] = np.where(below == above, low, (low + upper) / np.float32(2))
        return out

    @staticmethod
    def _mend(window: np.ndarray, out: np.ndarray, offsets: list[tuple[int, int, int]]) -> None:
        """Pixels with a NaN around them, by how many numbers there are."""
        bad = np.isnan(window)
        if not bad.any():
            return
        shift, shape = np.array([(z, y, x) for x, y, z in offsets]), np.array(window.shape)
        touched = np.zeros_like(bad)
        for s in shift:  # whose neighbour at this offset is missing
            here = tuple(slice(max(0, -d), max(0, n - max(0, d))) for d, n in zip(s, shape))
            there = tuple(slice(max(0, d), max(0, n + min(0, d))) for d, n in zip(s, shape))
            touched[here] |= bad[there]
        flat = np.flatnonzero(touched)
        for at in range(0, len(flat), SELECTED):
            places = np.stack(np.unravel_index(flat[at : at + SELECTED], window.shape), axis=1)[:, None, :] + shift
            inside = ((places >= 0) & (places < shape)).all(axis=2)
            samples = np.where(inside, window[tuple(np.moveaxis(np.where(inside[..., None], places, 0), 2, 0))], np.nan)
            here, numbers = flat[at : at + SELECTED], ~np.isnan(samples)
            count = numbers.sum(axis=1)
            out.ravel()[here] = np.nan
            for n in np.unique(count[count > 0]).tolist():  # places with as many numbers are selected together
                own = count == n
                out.ravel()[here[own]] = select_middle(list(samples[own][numbers[own]].reshape(-1, n).T))


def _stretches(n: int, radius: int) -> list[tuple[int, int]]:
    """0 to n cut where the edges begin to matter: a place at a time within ``radius`` of an end, the rest as one."""
    near = [*range(min(radius, n)), *range(max(radius, n - radius), n)]
    whole = [(radius, n - radius)] if n > 2 * radius else []
    return sorted([(k, k + 1) for k in near] + whole)


def select_middle(samples: list[np.ndarray]) -> np.ndarray:
    """The median of equally shaped arrays place by place; the mean of the two middle ones of an even count.

    Of more than half of the samples, the least and the largest cannot be in the middle. Both are dropped, one more
    sample comes in, and so on, all by exchanges of whole arrays: no place is sorted.
    """
    n = len(samples)
    more = iter(samples)
    spare: list[np.ndarray] = []

    def exchange(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(lesser, larger), in arrays that are not needed any more."""
        low = np.minimum(a, b, out=spare.pop() if spare else np.empty_like(a))
        high = np.maximum(a, b, out=b)
        spare.append(a)
        return low, high

    def take() -> np.ndarray:
        got = next(more)
        mine = spare.pop() if spare else np.empty_like(got, order="C", subok=False)
        np.copyto(mine, got)
        return mine

    held = [take() for _ in range(min(n, n // 2 + 2))]
    left = n - len(held)
    while len(held) > 2:
        lows, highs = [], []
        for k in range(0, len(held) - 1, 2):
            low, high = exchange(held[k], held[k + 1])
            lows.append(low)
            highs.append(high)
        if len(held) % 2:  # one without a partner is on either side
            low, lows[0] = exchange(lows[0], held[-1])
            single, highs[0] = exchange(lows[0], highs[0])
            lows[0] = low
            rest = [single]
        else:
            rest = []
        least = lows[0]
        for other in lows[1:]:
            least, larger = exchange(least, other)
            rest.append(larger)
        most = highs[0]
        for other in highs[1:]:
            lesser, most = exchange(most, other)
            rest.append(lesser)
        spare += [least, most]
        held = rest
        held += [take() for _ in range(min(1, left))]
        left -= min(1, left)
    return held[0] if len(held) == 1 else (held[0] + held[1]) / np.float32(2)


@dataclass(frozen=True)
class Gaussian:
    """A separable weighted mean over what exists of the neighbourhood, divided once at the end."""

    sigma: object = 1.0
    truncate: float = 4.0
    kind: str = "gaussian"

    def __post_init__(self) -> None:
        object.__setattr__(self, "sigma", triple(self.sigma, whole=False))

    @property
    def reach(self) -> int:
        return gaussian_weights(self.sigma[2], self.truncate)[0]

    def apply(self, window: np.ndarray) -> np.ndarray:
        above, below = window.astype(np.float64), np.ones(window.shape)
        for axis, sigma in ((0, self.sigma[2]), (1, self.sigma[1]), (2, self.sigma[0])):
            radius, weights = gaussian_weights(sigma, self.truncate)
            above, below = (_blur(a, axis, radius, weights) for a in (above, below))
        return (above / below).astype(np.float32)


def _blur(a: np.ndarray, axis: int, radius: int, weights: list[float]) -> np.ndarray:
    """Correlation with zeros outside."""
    n, out = a.shape[axis], np.zeros_like(a)
    moved, target = np.moveaxis(a, axis, 0), np.moveaxis(out, axis, 0)
    for d, w in zip(range(-radius, radius + 1), weights):
        low, high = max(0, -d), min(n, n - d)
        if low < high:
            target[low:high] += w * moved[low + d : high + d]
    return out


KERNELS: dict[str, type] = {"identity": Identity, "median": Median, "gaussian": Gaussian}


def register(kind: str, kernel: type) -> None:
    """Add a kernel: a picklable dataclass with ``kind``, ``reach`` (frames to either side) and a pure ``apply(window)``."""
    if not callable(getattr(kernel, "apply", None)) or not hasattr(kernel, "reach"):
        raise TypeError(f"{kernel.__name__} lacks apply or reach")
    KERNELS[kind] = kernel


def kernel(kind: str, **parameters: object) -> object:
    """A kernel from its recorded kind and parameters; kinds outside the registry are refused."""
    if kind not in KERNELS:
        raise ValueError(f"no kernel {kind!r}; there are {', '.join(sorted(KERNELS))}")
    return KERNELS[kind](**parameters)


def describe(own: object) -> dict:
    """Kind and parameters of a kernel, as they are recorded."""
    values = {k: getattr(own, k) for k in getattr(own, "__dataclass_fields__", {})}
    return {"kind": values.pop("kind"), **{k: list(v) if isinstance(v, tuple) else v for k, v in values.items()}}


def blocks(frames: DataFrame, reach: int, chunk: int = CHUNK) -> DataFrame:
    """Each frame once for every block that needs it."""
    return frames.withColumn("_block", F.explode(F.sequence(F.floor((F.col("idx") - reach) / chunk), F.floor((F.col("idx") + reach) / chunk))))


def to_array(column: pa.ChunkedArray, height: int, width: int) -> np.ndarray:
    flat = column.combine_chunks()
    flat = flat.flatten() if isinstance(flat, (pa.ListArray, pa.LargeListArray)) else flat
    return flat.to_numpy(zero_copy_only=False).reshape(len(column), height, width)


def to_lists(frames: np.ndarray, kind: pa.DataType | None = None) -> pa.Array:
    n = frames.shape[0]
    size = int(np.prod(frames.shape[1:]))
    return pa.ListArray.from_arrays(pa.array(np.arange(0, (n + 1) * size, size, dtype=np.int32)) if size else pa.array(np.zeros(n + 1, dtype=np.int32)), pa.array(np.ascontiguousarray(frames).ravel(), kind))


def over_blocks(frames: DataFrame, reach: int, compute: Callable[[np.ndarray], np.ndarray], chunk: int = CHUNK) -> DataFrame:
    """``frames`` with data replaced by ``compute`` over each block's (T, H, W) window."""
    names = [c for c in frames.columns]

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("idx")
        height, width = rows.column("height")[0].as_py(), rows.column("width")[0].as_py()
        window = to_array(rows.column("data"), height, width).astype(np.float32)
        idx = rows.column("idx").to_numpy()
        core = np.flatnonzero(idx // chunk == key[1].as_py())
        if not len(core):
            return rows.select(names).slice(0, 0)
        out = compute(window)[core]
        kept = rows.select(names).take(pa.array(core))
        return kept.set_column(names.index("data"), "data", to_lists(out, pa.float32()))

    schema = ", ".join(f"`{f.name}` {'array<float>' if f.name == 'data' else f.dataType.simpleString()}" for f in frames.schema.fields)
    return blocks(frames, reach, chunk).groupBy("seq", "_block").applyInArrow(run, schema)


def apply_filter(frames: DataFrame, own: object, chunk: int = CHUNK) -> DataFrame:
    """One output frame for each frame."""
    return frames if isinstance(own, Identity) else over_blocks(frames, own.reach, own.apply, chunk)


def pixels(frames: DataFrame) -> DataFrame:
    """(seq, idx, y, x, v), a row a pixel."""
    cells = frames.select("seq", "idx", "width", F.posexplode("data").alias("k", "v"))
    return cells.select("seq", "idx", F.floor(F.col("k") / F.col("width")).cast("int").alias("y"), (F.col("k") % F.col("width")).alias("x"), "v")


def median_by_offsets(frames: DataFrame, own: Median) -> DataFrame:
    """The relational form of the median, (seq, idx, y, x, v): each pixel is sent to the neighbours it counts for, and existing cells keep their group."""
    shift = F.explode(F.array(*[F.struct(F.lit(x).alias("dx"), F.lit(y).alias("dy"), F.lit(z).alias("dz")) for x, y, z in own.offsets()]))
    sent = pixels(frames).withColumn("o", shift).select("seq", (F.col("idx") - F.col("o.dz")).alias("idx"), (F.col("y") - F.col("o.dy")).alias("y"), (F.col("x") - F.col("o.dx")).alias("x"), "v", ((F.col("o.dx") == 0) & (F.col("o.dy") == 0) & (F.col("o.dz") == 0)).alias("own"))
    gathered = sent.groupBy("seq", "idx", "y", "x").agg(middle(F.collect_list("v")).cast("float").alias("v"), F.max("own").alias("own"))
    return gathered.where("own").drop("own")
