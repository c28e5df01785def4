"""Backward warping: each output pixel is sampled bilinearly where its offset points."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import Literal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from strobelake.operators.filters import to_array, to_lists

Padding = Literal["border", "zeros", "reflection"]


def _reflect(p: np.ndarray, n: int) -> np.ndarray:
    """Positions mirrored about the centres of the end pixels."""
    if n == 1:
        return np.zeros_like(p)
    period = 2 * (n - 1)
    p = np.abs(p) % period
    return np.minimum(p, period - p)


def check_padding(padding: str) -> None:
    if padding not in ("border", "zeros", "reflection"):
        raise ValueError(f"no padding {padding!r}")


def targets(dx: np.ndarray, dy: np.ndarray, size: tuple[int, int], origin: tuple[int, int], padding: Padding) -> tuple[np.ndarray, np.ndarray]:
    """(y, x) in a frame of ``size`` that the pixels of (N, h, w) offsets, whose first is at ``origin``, point at."""
    (height, width), (_, h, w) = size, dx.shape
    y, x = np.meshgrid(np.arange(h, dtype=np.float64) + origin[0], np.arange(w, dtype=np.float64) + origin[1], indexing="ij")
    px = x + dx if width > 1 else np.zeros(dx.shape)
    py = y + dy if height > 1 else np.zeros(dy.shape)
    if padding == "border":
        px, py = np.clip(px, 0, width - 1), np.clip(py, 0, height - 1)
    elif padding == "reflection":
        px, py = _reflect(px, width), _reflect(py, height)
    return py, px


def sampled(source: np.ndarray, py: np.ndarray, px: np.ndarray, size: tuple[int, int], origin: tuple[int, int] = (0, 0)) -> np.ndarray:
    """Bilinear samples at places of a frame of ``size``, of which ``source`` (N, h, w) holds the pixels from ``origin`` on; outside the frame there is 0."""
    (height, width), (_, h, w) = size, source.shape
    y0, x0 = np.floor(py), np.floor(px)
    fx, fy = px - x0, py - y0
    out = np.zeros(py.shape)
    n = np.arange(len(source))[:, None, None]
    for ky, wy in ((0, 1 - fy), (1, fy)):
        for kx, wx in ((0, 1 - fx), (1, fx)):
            cx, cy = x0 + kx, y0 + ky
            inside = (cx >= 0) & (cx <= width - 1) & (cy >= 0) & (cy <= height - 1)
            ix, iy = np.clip(cx - origin[1], 0, w - 1).astype(int), np.clip(cy - origin[0], 0, h - 1).astype(int)
            out += np.where(inside, wx * wy * source[n, iy, ix], 0)
    return out


def backward_warp(image: np.ndarray, dx: np.ndarray, dy: np.ndarray, padding: Padding = "border") -> np.ndarray:
    """(..., H, W) images sampled at (x + dx, y + dy); integers are rounded half to even and clamped to their type."""
    check_padding(padding)
    *lead, h, w = image.shape
    source = image.reshape(-1, h, w).astype(np.float64)
    py, px = targets(dx.reshape(-1, h, w), dy.reshape(-1, h, w), (h, w), (0, 0), padding)
    out = sampled(source, py, px, (h, w))
    if np.issubdtype(image.dtype, np.integer):
        span = np.iinfo(image.dtype)
        out = np.clip(np.rint(out), span.min, span.max)
    return out.astype(image.dtype).reshape(*lead, h, w)


def warp_pairs(pairs: DataFrame, image: str, padding: Padding = "border", out: str = "warped") -> DataFrame:
    """``pairs`` with column ``out``: its ``image`` warped by dx, dy; null where one of them is."""
    names = pairs.columns

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            result: list = [None] * len(rows)
            heights, widths = rows.column("height").to_numpy(), rows.column("width").to_numpy()
            whole = ~np.array([rows.column(c).is_null().to_numpy() for c in (image, "dx", "dy")]).any(axis=0)
            for shape in sorted({(int(h), int(w)) for h, w in zip(heights[whole], widths[whole])}):
                at = np.flatnonzero(whole & (heights == shape[0]) & (widths == shape[1]))
                some = rows.take(pa.array(at))
                warped = backward_warp(*(to_array(some.column(c), *shape).astype(np.float32) for c in (image, "dx", "dy")), padding)
                for k, frame in zip(at, warped):
                    result[k] = frame.ravel()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(result, pa.list_(pa.float32()))], names=[*names, out])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pairs.schema.fields) + f", `{out}` array<float>"
    return pairs.mapInArrow(run, schema)
