"""How alike two frames are: MSE, MAE and PSNR as column expressions, SSIM in numpy."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strobelake.functions.pixels import mean, minus, square
from strobelake.operators.filters import to_array
from strobelake.operators.warp import warp_pairs
from strobelake.schema import INTEGER_SPANS

#: Window width, its standard deviation and the two stabilisers of SSIM.
SSIM_SIDE, SSIM_SIGMA, SSIM_K1, SSIM_K2 = 11, 1.5, 0.01, 0.03


def data_range_of(dtype: str, data_range: float | None = None) -> float:
    """The span of values; a float type has none of its own."""
    if data_range is not None:
        return float(data_range)
    if dtype not in INTEGER_SPANS:
        raise ValueError("a float frame has no data range of its own; state it")
    low, high = INTEGER_SPANS[dtype]
    return float(high - low)


def _doubles(a: Column) -> Column:
    return a.cast("array<double>")


def mse(a: Column, b: Column) -> Column:
    return mean(square(minus(_doubles(a), _doubles(b))))


def mae(a: Column, b: Column) -> Column:
    return mean(F.transform(minus(_doubles(a), _doubles(b)), lambda x: F.abs(x)))


def psnr(a: Column, b: Column, data_range: float) -> Column:
    """10 log10(range^2 / mse), infinite for equal frames."""
    error = mse(a, b)
    return F.when(error == 0, F.lit(float("inf"))).otherwise(10 * F.log10(F.lit(data_range**2) / error))


def ssim(a: np.ndarray, b: np.ndarray, data_range: float) -> np.ndarray:
    """Mean structural similarity of (N, H, W) pairs, over the window positions that lie within the frame (reflected where there is none)."""
    side = SSIM_SIDE // 2
    weights = np.exp(-(np.arange(-side, side + 1) ** 2) / (2 * SSIM_SIGMA**2))
    weights /= weights.sum()

    def smooth(z: np.ndarray) -> np.ndarray:
        h, w = z.shape[1:]
        z = np.pad(z, ((0, 0), (side, side), (side, side)), mode="symmetric" if min(h, w) <= side else "reflect")
        z = sum(k * z[:, i : i + h] for i, k in enumerate(weights))
        return sum(k * z[:, :, i : i + w] for i, k in enumerate(weights))

    a, b = a.astype(np.float64), b.astype(np.float64)
    ma, mb = smooth(a), smooth(b)
    va, vb, cov = smooth(a * a) - ma**2, smooth(b * b) - mb**2, smooth(a * b) - ma * mb
    c1, c2 = (SSIM_K1 * data_range) ** 2, (SSIM_K2 * data_range) ** 2
    score = ((2 * ma * mb + c1) * (2 * cov + c2)) / ((ma**2 + mb**2 + c1) * (va + vb + c2))
    h, w = score.shape[1:]
    if h > 2 * side and w > 2 * side:
        score = score[:, side : h - side, side : w - side]
    return score.reshape(len(score), -1).mean(axis=1)


def with_ssim(pairs: DataFrame, a: str, b: str, data_range: float) -> DataFrame:
    """``pairs`` with column ssim; null where a frame is."""
    names = pairs.columns

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            out: list = [None] * len(rows)
            heights, widths = rows.column("height").to_numpy(), rows.column("width").to_numpy()
            whole = ~(rows.column(a).is_null().to_numpy() | rows.column(b).is_null().to_numpy())
            for shape in sorted({(int(h), int(w)) for h, w in zip(heights[whole], widths[whole])}):
                at = np.flatnonzero(whole & (heights == shape[0]) & (widths == shape[1]))
                some = rows.take(pa.array(at))
                for k, s in zip(at, ssim(to_array(some.column(a), *shape), to_array(some.column(b), *shape), data_range)):
                    out[k] = float(s)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.float64())], names=[*names, "ssim"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pairs.schema.fields) + ", ssim double"
    return pairs.mapInArrow(run, schema)


def scores(pairs: DataFrame, a: str, b: str, data_range: float) -> DataFrame:
    """(seq, idx, ssim, psnr, mse, mae) of each pair."""
    scored = with_ssim(pairs, a, b, data_range)
    return scored.select("seq", "idx", "ssim", psnr(F.col(a), F.col(b), data_range).alias("psnr"), mse(F.col(a), F.col(b)).alias("mse"), mae(F.col(a), F.col(b)).alias("mae"))


def reduced(scored: DataFrame, *keys: str) -> DataFrame:
    """The mean of the scores of single pairs, PSNR too, for each key."""
    return scored.groupBy(*keys).agg(*[F.avg(c).alias(c) for c in ("ssim", "psnr", "mse", "mae")])


def warp_consistency(pairs: DataFrame, data_range: float, padding: str = "border") -> DataFrame:
    """Scores of ``curr`` warped back along the flow against ``prev``: (seq, idx, ssim, psnr, mse, mae)."""
    return scores(warp_pairs(pairs, "curr", padding).where("warped is not null"), "prev", "warped", data_range)
