"""Streams of frames that arrive one by one: each is paired with the one before, whose frame is the only state.

A frame that comes too early waits until the gap before it closes: a few in the task, the others as bytes in the
state, which RocksDB keeps on disk. There a row is a page of neighbouring frames, so that a small frame costs no call to the
state of its own; a frame larger than a page is by itself. One that was already seen is left out. A frame whose column ``reset`` is true starts
anew: it is paired with none before it. Results are labelled by the first frame of their pair.

With a ``timeout`` a gap is waited for that long, counted from the batch in which it was seen. Then each frame that never came is
named by a row with ``missing`` set and no results, and the sequence goes on after the gap. The timer is part of the state: a stream
that is started again goes on waiting where it stopped. Batches without data go on while a timer may come due, so a stream that shall end with
its data (``availableNow``) needs ``spark.sql.streaming.noDataMicroBatches.enabled`` off.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

STATE = "next int, data binary, waiting int, page int"
WAITING = "idx array<int>, data array<binary>, height array<int>, width array<int>, reset array<boolean>"
#: Bytes of neighbouring frames that wait as one row of the state, and how many pages of early frames a task holds before they go there.
PAGE_BYTES, HELD = 1 << 18, 64
#: Pixels whose results are computed together and given out at once.
TOGETHER = 1 << 18


@dataclass
class _Place:
    """Where a sequence stands: the next wanted frame and the one before it, how many frames wait in the state, and how many make a page."""

    want: int
    before: bytes | None
    stored: int
    page: int
    held: dict[int, tuple] = field(default_factory=dict)  # early frames in the task
    pulled: int | None = None  # the page that was taken from the state last
    pairs: list[tuple] = field(default_factory=list)
    pixels: int = 0


class Push(StatefulProcessor):
    """Calls ``calc(previous, current)`` on (H, W) arrays and emits one flat result for each pair; a processor that is ``stacked`` on (N, H, W) arrays of many pairs.

    ``patience`` is how many frames may wait for a missing one at the end of a batch; the stream fails beyond it.
    ``timeout`` is how many milliseconds a missing frame is waited for; None waits for ever.
    """

    names: tuple[str, ...] = ("value",)
    stacked = False

    def __init__(self, calc: Callable[[np.ndarray, np.ndarray], list[np.ndarray]], first: int = 0, patience: int | None = None, timeout: int | None = None):
        self.calc, self.first, self.patience, self.timeout, self.page_bytes = calc, first, patience, timeout, PAGE_BYTES

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", STATE)
        self.waiting = handle.getMapState("waiting", "page int", WAITING)
        if self.timeout is not None:
            self.due = handle.getValueState("due", "idx int, at long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        at = _Place(*(self.last.get() if self.last.exists() else (self.first, None, 0, 0)))
        for frame in rows:
            frame = frame[frame["idx"] >= at.want].sort_values("idx", kind="stable")
            for idx, data, height, width, reset in zip(*(frame[c].tolist() for c in ("idx", "data", "height", "width", "reset"))):
                if idx < at.want or idx in at.held:
                    continue
                data = np.asarray(data, dtype=np.float32).tobytes()
                at.page = at.page or max(1, self.page_bytes // max(1, len(data)))
                at.held[idx] = (data, height, width, reset)
                if idx == at.want:
                    yield from self._advance(key, at)
                if len(at.held) > HELD * at.page:
                    self._store(at)
            yield self._results(key, at)
        self._store(at)
        if self.patience is not None and at.stored > self.patience:
            raise ValueError(f"{key[0]}: frame {at.want} is missing and {at.stored} frames wait for it")
        self.last.update((at.want, at.before, at.stored, at.page))
        if self.timeout is not None:
            self._wait(at.want if at.stored else None, timerValues.getCurrentProcessingTimeInMs())

    def _load(self, page: int) -> dict[int, tuple]:
        found = self.waiting.getValue((page,)) if self.waiting.containsKey((page,)) else None
        return {} if found is None else {idx: values for idx, *values in zip(*found)}

    def _store(self, at: _Place) -> None:
        """The frames that the task holds go to their pages; one that waits there already was seen before."""
        pages: dict[int, list[int]] = {}
        for idx in sorted(at.held):
            pages.setdefault(idx // at.page, []).append(idx)
        for page, some in pages.items():
            there = self._load(page) if at.stored and page != at.pulled else {}
            new = {idx: at.held[idx] for idx in some if idx not in there}
            if new:
                frames = there | new
                data, height, width, reset = zip(*frames.values())
                self.waiting.updateValue((page,), (list(frames), [bytes(d) for d in data], list(height), list(width), list(reset)))
                at.stored += len(new)
        at.held.clear()
        at.pulled = None

    def _pull(self, at: _Place) -> None:
        """The page of the wanted frame comes from the state to the task."""
        page = at.want // at.page
        if at.stored and page != at.pulled:
            found = self._load(page)
            if found:
                self.waiting.removeKey((page,))
                at.stored -= len(found)
                at.held.update(found)
            at.pulled = page

    def _advance(self, key: tuple, at: _Place) -> Iterator[pd.DataFrame]:
        """Takes the frames that follow, as far as they are there."""
        while True:
            self._pull(at)
            if at.want not in at.held:
                return
            data, height, width, reset = at.held.pop(at.want)
            if at.before is not None and not reset:
                if len(at.before) != len(data):
                    raise ValueError(f"{key[0]}: frames {at.want - 1} and {at.want} are not of one size")
                at.pairs.append((at.want - 1, at.before, data, height, width))
                at.pixels += height * width
            at.before, at.want = bytes(data), at.want + 1
            if at.pixels >= TOGETHER:
                yield self._results(key, at)

    def _results(self, key: tuple, at: _Place) -> pd.DataFrame:
        """The results of the pairs that were found, those of one size computed together."""
        out: list[tuple] = []
        for size in sorted({pair[3:] for pair in at.pairs}):
            own = [pair for pair in at.pairs if pair[3:] == size]
            a, b = (np.frombuffer(b"".join(pair[k] for pair in own), dtype=np.float32).reshape(len(own), *size) for k in (1, 2))
            found = self.calc(a, b) if self.stacked else [np.stack(c) for c in zip(*map(self.calc, a, b))]
            flat = [list(np.asarray(c, dtype=np.float32).reshape(len(own), -1)) for c in found]
            out += [(key[0], pair[0], *values, False) for pair, *values in zip(own, *flat)]
        at.pairs, at.pixels = [], 0
        return self._rows(out)

    def _rows(self, out: list[tuple]) -> pd.DataFrame:
        """Results as the stream gives them; only a stream with a timeout has the column ``missing``."""
        columns = ["seq", "idx", *self.names, *(["missing"] if self.timeout is not None else [])]
        return pd.DataFrame({c: pd.Series([r[k] for r in out], dtype={"idx": "int32", "missing": "bool"}.get(c, object)) for k, c in enumerate(columns)})

    def _wait(self, missing: int | None, now: int) -> None:
        """One timer for the first missing frame: another gap gets a time of its own, a closed one none."""
        due = self.due.get() if self.due.exists() else None
        if due is not None and due[0] != missing:
            self.handle.deleteTimer(due[1])
            self.due.clear()
            due = None
        if missing is not None and due is None:
            self.handle.registerTimer(now + self.timeout)
            self.due.update((missing, now + self.timeout))

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:
        at = _Place(*self.last.get())
        self.due.clear()
        if at.stored:
            there = min(self._load(min(k[0] for k in self.waiting.keys())))
            yield self._rows([(key[0], idx, *[None] * len(self.names), True) for idx in range(at.want, there)])
            at.want, at.before = there, None
            yield from self._advance(key, at)
            yield self._results(key, at)
            self._store(at)
            self.last.update((at.want, at.before, at.stored, at.page))
            self._wait(at.want if at.stored else None, timerValues.getCurrentProcessingTimeInMs())

    def close(self) -> None:
        pass


class Difference(Push):
    """current - previous."""

    names = ("change",)
    stacked = True

    def __init__(self, **limits: int | None) -> None:
        super().__init__(lambda a, b: [b - a], **limits)


class FlowPush(Push):
    """The flow of an estimator between successive frames."""

    names = ("dx", "dy")
    stacked = True

    def __init__(self, estimator: object, **limits: int | None):
        super().__init__(lambda a, b: list(estimator.calc(a, b)), **limits)


def push(frames: DataFrame, processor: Push) -> DataFrame:
    """A streaming DataFrame (seq, idx, results) from one with (seq, idx, height, width, data) and, if wanted, reset; needs the RocksDB state store."""
    schema = "seq string, idx int, " + ", ".join(f"{n} array<float>" for n in processor.names) + (", missing boolean" if processor.timeout is not None else "")
    reset = F.coalesce(F.col("reset"), F.lit(False)) if "reset" in frames.columns else F.lit(False)
    rows = frames.select("seq", "idx", "height", "width", "data", reset.alias("reset"))
    return rows.groupBy("seq").transformWithStateInPandas(processor, outputStructType=schema, outputMode="Append", timeMode="None" if processor.timeout is None else "ProcessingTime")
