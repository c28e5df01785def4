"""Cutting blocks of UTF-8 texts into pieces with numpy, and looking up each distinct piece once."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa


def block_ranges(lengths: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``most`` bytes or characters each (or one row)."""
    ends, low = np.cumsum(lengths), 0
    while low < len(lengths):
        high = max(low + 1, int(np.searchsorted(ends, (ends[low - 1] if low else 0) + most, side="right")))
        yield low, high
        low = high


def valid(column: pa.Array) -> pa.Array:
    """A column of texts in which bytes that are no UTF-8 are U+FFFD."""
    try:
        column.validate(full=True)
    except pa.ArrowInvalid:
        return pa.array([None if t is None else t.decode("utf-8", "replace") for t in column.cast(pa.binary()).to_pylist()], pa.string())
    return column


def text_blocks(column: pa.Array, most: int) -> Iterator[tuple[int, int, list[bytes]]]:
    """(first row, end row, UTF-8 texts) of a column of texts, about ``most`` bytes at a time; a null is an empty text, and bytes that are no UTF-8 are U+FFFD."""
    raw = valid(column).cast(pa.binary())
    offsets = np.frombuffer(raw.buffers()[1], dtype=np.int32)[raw.offset : raw.offset + len(raw) + 1] if len(raw) else np.zeros(1, dtype=np.int32)
    for low, high in block_ranges(np.diff(offsets).astype(np.int64), most):
        yield low, high, [t or b"" for t in raw.slice(low, high - low).to_pylist()]


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All bytes one after another, and the bounds of the texts."""
    return np.frombuffer(b"".join(texts), dtype=np.uint8), np.cumsum([0, *map(len, texts)], dtype=np.int64)


def distinct_pieces(data: np.ndarray, starts: np.ndarray, ends: np.ndarray | None = None) -> tuple[np.ndarray, list[bytes]]:
    """(index of each piece, the distinct pieces). Without ``ends`` a piece lasts until the next begins."""
    if ends is None:
        offsets = np.append(starts, len(data)).astype(np.int32)
        column = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data)]).dictionary_encode()
        return column.indices.to_numpy(), column.dictionary.to_pylist()
    offsets = np.stack([starts, ends], axis=1).ravel()
    offsets = np.append(offsets, len(data)).astype(np.int32)
    column = pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(data)])
    column = column.take(pa.array(np.arange(0, len(offsets) - 1, 2))).dictionary_encode()
    return column.indices.to_numpy(), column.dictionary.to_pylist()


class Memory:
    """Values of pieces already met; when too many, only those that the current block uses stay."""

    def __init__(self, learn: Callable[[list[bytes]], dict], entries: int, length: int):
        self.learn, self.entries, self.length, self.known = learn, entries, length, {}

    def values(self, wanted: list[bytes]) -> list:
        known = self.known
        if len(known) > self.entries:
            self.known = known = {p: known[p] for p in wanted if p in known}
        fresh = [p for p in wanted if p not in known]
        long = [p for p in fresh if len(p) > self.length]
        known.update(self.learn([p for p in fresh if len(p) <= self.length]))
        look = known if not long else known | self.learn(long)
        return [look[p] for p in wanted]


def spell(index: np.ndarray, values: list[bytes], owner: np.ndarray, rows: int, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all rows one after another, ids of each row) from each piece's ids as 32-bit integers; ``end_id`` closes each row."""
    size = np.array([len(v) // 4 for v in values], dtype=np.int64)
    flat = np.frombuffer(b"".join(values), dtype="<i4")
    first = np.cumsum(size) - size
    count = size[index]
    spread = np.arange(int(count.sum()))
    source = spread + np.repeat(first[index] - (np.cumsum(count) - count), count)
    sizes = np.bincount(owner, weights=count, minlength=rows).astype(np.int64)
    if end_id is None:
        return flat[source], sizes
    out = np.full(len(spread) + rows, end_id, dtype=np.int32)
    out[spread + np.repeat(owner, count)] = flat[source]
    return out, sizes + 1
