"""Frames as rows of tiles, for frames too large to be one array in one task.

A tile is a row with its place (ty, tx) in a grid of ``side`` pixels and its own pixels; height and width stay those of the whole
frame. Work that looks around a pixel gets a halo: each tile sends the strips that its neighbours (in space, and in
blocks of time) look at, cut by Spark's array functions, and a task puts one tile together with its halo. What lies
outside the frame is missing there as it is at the edge of a whole frame, so tiles give exactly what whole frames give. A task
holds ``chunk + 2 * reach`` layers of one tile and its halo, whatever the size of the frame; ``side_for`` turns bytes into a side.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strobelake.operators.filters import Gaussian, Identity, Median, to_array, to_lists
from strobelake.operators.warp import Padding, check_padding, sampled, targets
from strobelake.operators.windows import gaussian_weights

#: Frames of a block in time, at least; bytes that a task may hold of one tile with its halo, and up to which small tiles' blocks get longer.
CHUNK, TASK_BYTES, BLOCK_BYTES = 16, 64 << 20, 1 << 20
#: Pixels of frames whose flow tiles are warped together; a larger frame is by itself.
WARPED = 1 << 16


def side_for(depth: int, around: int, held: int = TASK_BYTES, copies: int = 4) -> int:
    """The largest side for which ``depth`` layers of a tile with ``around`` pixels of halo, ``copies`` times in floats, take at most ``held`` bytes."""
    side = math.isqrt(held // (4 * copies * max(1, depth))) - 2 * around
    if side < 1:
        raise ValueError(f"{depth} layers with a halo of {around} pixels don't fit in {held} bytes")
    return side


def chunk_for(side: int, reach: tuple[int, int, int], copies: int = 4) -> int:
    """Frames of a block in time: where tiles are small, so many that the cost of a group is shared by BLOCK_BYTES of them."""
    rx, ry, rz = reach
    return max(CHUNK, BLOCK_BYTES // (4 * copies * (side + 2 * rx) * (side + 2 * ry)) - 2 * rz)


def _alike(*columns: np.ndarray) -> Iterator[tuple[list[int], np.ndarray]]:
    """Each combination of values in ``columns`` with the places that have it."""
    found, which, counts = np.unique(np.stack(columns, axis=1), axis=0, return_inverse=True, return_counts=True)
    return zip(found.tolist(), np.split(np.argsort(which.ravel(), kind="stable"), np.cumsum(counts)[:-1]))


def _numbers(rows: pa.Table, *names: str) -> list[np.ndarray]:
    return [rows.column(n).to_numpy() for n in names]


def _laid(window: np.ndarray, at: np.ndarray, parts: pa.Table, names: tuple[str, str, str, str], origin: tuple[int, int]) -> np.ndarray:
    """Puts strips into the frames ``at`` of a window that begins at ``origin``, all of one place together; how many pixels each frame got."""
    filled = np.zeros(len(window), dtype=np.int64)
    data = parts.column("data").combine_chunks()
    for (y, x, h, w), own in _alike(*_numbers(parts, *names)):
        y, x = y - origin[0], x - origin[1]
        window[at[own], y : y + h, x : x + w] = to_array(pa.chunked_array([data.take(pa.array(own))]), h, w)
        filled += np.bincount(at[own], minlength=len(window)) * (h * w)
    return filled


def _cut(data: Column, stride: Column, y: Column, x: Column, height: Column, width: Column) -> Column:
    """Rows y.. and columns x.. of a flat array whose rows are ``stride`` long."""
    rows = F.transform(F.sequence(y, y + height - 1), lambda k: F.slice(data, k * stride + x + 1, width))
    return F.flatten(rows)


def _extent(place: Column, side: int, whole: Column) -> Column:
    return F.least(F.lit(side), whole - place * side)


def cut(frames: DataFrame, side: int, columns: tuple[str, ...] = ("data",)) -> DataFrame:
    """``frames`` as tiles: columns ty and tx, and each of ``columns`` cut; null where it was."""
    last = lambda n: F.floor((F.col(n) - 1) / side).cast("int")
    rows = frames.withColumn("ty", F.explode(F.sequence(F.lit(0), last("height")))).withColumn("tx", F.explode(F.sequence(F.lit(0), last("width"))))
    h, w = _extent(F.col("ty"), side, F.col("height")), _extent(F.col("tx"), side, F.col("width"))
    return rows.withColumns({c: F.when(F.col(c).isNotNull(), _cut(F.col(c), F.col("width"), F.col("ty") * side, F.col("tx") * side, h, w)) for c in columns})


def whole(tiles: DataFrame, side: int, column: str = "data") -> DataFrame:
    """Frames put together again; a frame whose tiles don't fill it is refused."""
    names = [c for c in tiles.columns if c not in ("ty", "tx")]
    kept = [F.first(c).alias(c) for c in names if c not in ("seq", "idx", column)]
    rows = tiles.groupBy("seq", "idx").agg(*kept, F.array_sort(F.collect_list(F.struct("ty", "tx", F.col(column).alias("data")))).alias("_tiles"))
    down, across = (F.ceil(F.col(n) / side).cast("int") for n in ("height", "width"))
    size = lambda t: F.least(F.lit(side), F.col("height") - t["ty"] * side) * F.least(F.lit(side), F.col("width") - t["tx"] * side)
    fill = (F.transform("_tiles", lambda t: t["ty"] * across + t["tx"]) == F.sequence(F.lit(0), down * across - 1)) & F.forall("_tiles", lambda t: F.coalesce(F.size(t["data"]) == size(t), F.lit(False)))

    def line(y: Column) -> Column:
        """A row of the frame from the tiles beside each other."""
        ty = F.floor(y / side).cast("int")

        def part(tx: Column) -> Column:
            wide = F.least(F.lit(side), F.col("width") - tx * side)
            return F.slice(F.get("_tiles", ty * across + tx)["data"], (y - ty * side) * wide + 1, wide)

        return F.flatten(F.transform(F.sequence(F.lit(0), across - 1), part))

    frame = F.flatten(F.transform(F.sequence(F.lit(0), F.col("height") - 1), line))
    refused = F.raise_error(F.concat(F.coalesce("seq", F.lit("null")), F.lit(", frame "), F.col("idx").cast("string"), F.lit(": its tiles don't fill it")))
    return rows.withColumn(column, F.when(F.coalesce(fill, F.lit(False)), frame).otherwise(refused).cast("array<float>")).select(names)


def _reached(low: Column, high: Column, side: int, size: Column) -> Column:
    """Places of the grid whose pixels are among low to high."""
    last = F.floor((size - 1) / side)
    return F.sequence(F.greatest(F.floor(low / side), F.lit(0)).cast("int"), F.least(F.floor(high / side), last).cast("int"))


def over_tiles(tiles: DataFrame, side: int, reach: tuple[int, int, int], compute: Callable[[np.ndarray], np.ndarray], chunk: int = CHUNK) -> DataFrame:
    """``tiles`` with data replaced by ``compute`` over (T, H, W) windows that hold all within ``reach`` (x, y, t) of their pixels."""
    rx, ry, rz = reach
    names = tiles.columns
    y0, x0 = F.col("ty") * side, F.col("tx") * side
    h, w = _extent(F.col("ty"), side, F.col("height")), _extent(F.col("tx"), side, F.col("width"))
    sent = tiles.withColumn("_block", F.explode(F.sequence(F.floor((F.col("idx") - rz) / chunk), F.floor((F.col("idx") + rz) / chunk))))
    sent = sent.withColumn("_ty", F.explode(_reached(y0 - ry, y0 + h - 1 + ry, side, F.col("height")))).withColumn("_tx", F.explode(_reached(x0 - rx, x0 + w - 1 + rx, side, F.col("width"))))
    top, left = F.greatest(y0, F.col("_ty") * side - ry), F.greatest(x0, F.col("_tx") * side - rx)
    bottom, right = F.least(y0 + h, (F.col("_ty") + 1) * side + ry), F.least(x0 + w, (F.col("_tx") + 1) * side + rx)
    strip = _cut(F.col("data"), w, top - y0, left - x0, bottom - top, right - left)
    own = (F.col("_ty") == F.col("ty")) & (F.col("_tx") == F.col("tx"))
    others = {c: F.when(own, F.col(c)) for c in names if c not in ("seq", "idx", "height", "width", "ty", "tx", "data")}  # what only the tile itself needs
    sent = sent.withColumns({"data": strip, "_y": top, "_x": left, "_h": bottom - top, "_w": right - left, **others})

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        block, ty, tx = (k.as_py() for k in key[1:])
        height, width = rows.column("height")[0].as_py(), rows.column("width")[0].as_py()
        a, b = max(0, ty * side - ry), min(height, (ty + 1) * side + ry)
        c, d = max(0, tx * side - rx), min(width, (tx + 1) * side + rx)
        idx = np.unique(rows.column("idx").to_numpy())
        window = np.empty((len(idx), b - a, d - c), dtype=np.float32)
        at = np.searchsorted(idx, rows.column("idx").to_numpy())
        filled = _laid(window, at, rows, ("_y", "_x", "_h", "_w"), (a, c))
        if (filled != window[0].size).any():
            raise ValueError(f"{key[0].as_py()}: tiles around ({ty}, {tx}) are missing or repeat")
        own = (rows.column("ty").to_numpy() == ty) & (rows.column("tx").to_numpy() == tx) & (rows.column("idx").to_numpy() // chunk == block)
        kept = np.flatnonzero(own)
        if not len(kept):
            return rows.select(names).slice(0, 0)
        out = compute(window)[at[kept], ty * side - a : min(height, (ty + 1) * side) - a, tx * side - c : min(width, (tx + 1) * side) - c]
        return rows.select(names).take(pa.array(kept)).set_column(names.index("data"), "data", to_lists(out, pa.float32()))

    schema = ", ".join(f"`{f.name}` {'array<float>' if f.name == 'data' else f.dataType.simpleString()}" for f in tiles.schema.fields)
    return sent.groupBy("seq", "_block", "_ty", "_tx").applyInArrow(run, schema)


def reach_of(kernel: object) -> tuple[int, int, int]:
    """How far a kernel looks along x, y and t; a registered one tells it as ``around`` (x, y)."""
    if isinstance(kernel, Median):
        return kernel.radius
    if isinstance(kernel, Gaussian):
        return tuple(gaussian_weights(s, kernel.truncate)[0] for s in kernel.sigma)
    if not isinstance(kernel, Identity) and not hasattr(kernel, "around"):
        raise TypeError(f"{type(kernel).__name__} doesn't tell how far it looks around a pixel")
    return (*getattr(kernel, "around", (0, 0)), kernel.reach)


def filter_tiles(tiles: DataFrame, side: int, kernel: object, chunk: int | None = None) -> DataFrame:
    """What ``filters.apply_filter`` gives, tile by tile."""
    if isinstance(kernel, Identity):
        return tiles
    reach = reach_of(kernel)
    return over_tiles(tiles, side, reach, kernel.apply, chunk or chunk_for(side, reach))


def warp_tiles(images: DataFrame, flows: DataFrame, side: int, padding: Padding = "border") -> DataFrame:
    """(seq, idx, height, width, ty, tx, data): ``images`` warped back by the flow tiles of the same idx; each flow tile asks for the pixels that it points at.

    Tiles whose flow is null are null.
    """
    check_padding(padding)
    together = F.greatest(F.floor(F.lit(WARPED) / (F.col("height") * F.col("width"))), F.lit(1))
    own = flows.select("seq", "idx", "height", "width", "ty", "tx", "dx", "dy").withColumn("_block", F.floor(F.col("idx") / together))

    def span(place: str, offset: str, size: str) -> tuple[Column, Column]:
        """First and last row (or column) that a tile may take pixels from."""
        first = F.col(place) * side
        low, high, last = F.floor(first + F.array_min(offset)), F.ceil(first + _extent(F.col(place), side, F.col(size)) - 1 + F.array_max(offset)) + 1, F.col(size) - 1
        if padding == "reflection":
            low, high = F.least(low, F.when(high > last, 2 * last - high).otherwise(low)), F.greatest(high, F.when(low < 0, -low + 1).otherwise(high))
        return F.least(F.greatest(low, F.lit(0)), last).cast("int"), F.greatest(F.least(high, last), F.lit(0)).cast("int")

    (top, bottom), (left, right) = span("ty", "dy", "height"), span("tx", "dx", "width")
    asked = own.where("dx is not null and dy is not null").withColumns({"_top": top, "_bottom": bottom, "_left": left, "_right": right})
    want = asked.select("seq", "idx", F.col("ty").alias("_ty"), F.col("tx").alias("_tx"), "_top", "_bottom", "_left", "_right", F.col("height").alias("_height"), F.col("width").alias("_width"), "_block")
    want = want.withColumn("ty", F.explode(_reached(F.col("_top"), F.col("_bottom"), side, F.col("_height")))).withColumn("tx", F.explode(_reached(F.col("_left"), F.col("_right"), side, F.col("_width"))))
    met = images.select("seq", "idx", "height", "width", "ty", "tx", "data").join(want, ["seq", "idx", "ty", "tx"])
    h, w = _extent(F.col("ty"), side, F.col("height")), _extent(F.col("tx"), side, F.col("width"))
    y, x = F.greatest(F.col("ty") * side, "_top"), F.greatest(F.col("tx") * side, "_left")
    high, wide = F.least(F.col("ty") * side + h, F.col("_bottom") + 1) - y, F.least(F.col("tx") * side + w, F.col("_right") + 1) - x
    # names of their own, for images and flows may come from one table
    strips = met.select(F.col("seq").alias("_seq"), F.col("idx").alias("_idx"), F.col("_block").alias("_asked"), "_height", "_width", "_ty", "_tx", y.alias("y"), x.alias("x"), high.alias("h"), wide.alias("w"), _cut(F.col("data"), w, y - F.col("ty") * side, x - F.col("tx") * side, high, wide).alias("data"))

    def run(tiles: pa.Table, parts: pa.Table) -> pa.Table:
        names = [f.name for f in out if f.name != "data"]
        if not len(tiles):
            return out.empty_table()
        tiles = tiles.sort_by("idx")
        height, width, ty, tx = (n[0].item() for n in _numbers(tiles, "height", "width", "ty", "tx"))
        idx, top, bottom, left, right = _numbers(tiles, "idx", "_top", "_bottom", "_left", "_right")
        a, b, c, d = top.min(), bottom.max() + 1, left.min(), right.max() + 1  # pixels of it that a tile doesn't ask for are not looked at
        canvas = np.zeros((len(idx), b - a, d - c), dtype=np.float32)
        filled = _laid(canvas, np.searchsorted(idx, parts.column("_idx").to_numpy()), parts, ("y", "x", "h", "w"), (a, c)) if len(parts) else np.zeros(len(idx))
        wrong = np.flatnonzero(filled != (bottom + 1 - top) * (right + 1 - left))
        if len(wrong):
            raise ValueError(f"{tiles.column('seq')[0].as_py()}, frame {idx[wrong[0]]}: tiles that its flow points at are missing")
        y0, x0 = ty * side, tx * side
        size = min(side, height - y0), min(side, width - x0)
        dx, dy = (to_array(tiles.column(n), *size).astype(np.float32) for n in ("dx", "dy"))
        py, px = targets(dx, dy, (height, width), (y0, x0), padding)
        warped = sampled(canvas.astype(np.float64), py, px, (height, width), (a, c)).astype(np.float32)
        return tiles.select(names).append_column("data", to_lists(warped, pa.float32())).cast(out)

    out = pa.schema([("seq", pa.string()), ("idx", pa.int32()), ("height", pa.int32()), ("width", pa.int32()), ("ty", pa.int32()), ("tx", pa.int32()), ("data", pa.list_(pa.float32()))])
    schema = "seq string, idx int, height int, width int, ty int, tx int, data array<float>"
    warped = asked.groupBy("seq", "_block", "height", "width", "ty", "tx").cogroup(strips.groupBy("_seq", "_asked", "_height", "_width", "_ty", "_tx")).applyInArrow(run, schema)
    still = own.where("dx is null or dy is null").select("seq", "idx", "height", "width", "ty", "tx", F.lit(None).cast("array<float>").alias("data"))
    return warped.unionByName(still)
