from __future__ import annotations

import numpy as np
import pytest
from helpers import frames_of
from pyspark.sql import functions as F

from strobelake.schema import FLOWS
from strobelake.sources import files
from strobelake.streaming import push


def save(path, array):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(files.npy_bytes(array))


def test_discovery(spark, tmp_path):
    for seq in ("TL_00", "plate_A/2026-03-11/TL_01"):
        for k in range(2):
            save(tmp_path / seq / "Phase" / f"{k:05d}_phase.npy", np.zeros((2, 3), dtype=np.float32))
    save(tmp_path / "other" / "x" / "00000_phase.npy", np.zeros((2, 3), dtype=np.float32))
    rows = files.discover(spark, str(tmp_path), "Phase").orderBy("seq", "source_idx").collect()
    assert [(r["seq"], r["source_idx"]) for r in rows] == [("TL_00", 0), ("TL_00", 1), ("plate_A/2026-03-11/TL_01", 0), ("plate_A/2026-03-11/TL_01", 1)]
    with pytest.raises(ValueError, match="no sequence"):
        files.discover(spark, str(tmp_path), "Missing")
    save(tmp_path / "TL_00" / "inner" / "Phase" / "00000_phase.npy", np.zeros((2, 3), dtype=np.float32))  # part of TL_00
    save(tmp_path / "TL_001" / "Phase" / "00000_phase.npy", np.zeros((2, 3), dtype=np.float32))
    assert {r["seq"] for r in files.discover(spark, str(tmp_path), "Phase").collect()} == {"TL_00", "TL_001", "plate_A/2026-03-11/TL_01"}


def test_flow_files_round_trip_and_levels(spark, tmp_path):
    root = f"file://{tmp_path}/flows"
    rows = [("s", k, 2, 3, [float(k)] * 6, [-float(k)] * 6) for k in range(3)]
    flows = spark.createDataFrame(rows, FLOWS)
    files.write_flow_files(flows, root)
    back = files.read_flows(spark, str(tmp_path / "flows")).orderBy("idx").collect()
    assert [(r["idx"], r["dx"][0], r["dy"][0], r["height"], r["width"]) for r in back] == [(k, float(k), -float(k), 2, 3) for k in range(3)]
    here = str(tmp_path / "flows")
    assert files.flow_faults(spark, here, "data").count() == 0
    save(tmp_path / "flows/s/00003_flow.npy", np.full((2, 2, 3), np.nan, dtype=np.float32))
    assert files.flow_faults(spark, here, "headers").count() == 0 and files.flow_faults(spark, here, "data").count() == 1
    with pytest.raises(ValueError, match="non-finite"):
        files.read_flows(spark, here)
    assert files.read_flows(spark, here, "null").where("dx is null").count() == 1
    save(tmp_path / "flows/s/00005_flow.npy", np.zeros((2, 4, 4), dtype=np.float32))
    assert files.flow_faults(spark, here, "names").count() == 1
    assert {r["fault"] for r in files.flow_faults(spark, here, "headers").collect()} == {"file numbers have gaps", "shapes differ"}
    with pytest.raises(ValueError):
        files.write_flow_files(flows.limit(0), root)


def test_headers():
    for array in (np.zeros((2, 3, 4), dtype=np.float32), np.zeros((5,), dtype=np.int16)):
        shape, dtype, at = files.npy_header(files.npy_bytes(array))
        assert shape == array.shape and np.dtype(dtype) == array.dtype and len(files.npy_bytes(array)) - at == array.nbytes
    with pytest.raises(ValueError):
        files.npy_header(b"not an array file")
    with pytest.raises(ValueError, match="Fortran"):
        files.npy_header(files.npy_bytes(np.asfortranarray(np.zeros((3, 4)))))


@pytest.fixture
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.unset(key)


def streamed(spark, path, parts, processor):
    for k, part in enumerate(parts):
        part.coalesce(1).write.mode("append").parquet(f"{path}/in/part={k}")
    arriving = spark.readStream.schema(parts[0].schema.add("part", "integer")).option("maxFilesPerTrigger", "1").parquet(f"{path}/in")
    query = push.push(arriving, processor).writeStream.option("checkpointLocation", f"{path}/c").trigger(availableNow=True).start(f"{path}/out")
    query.awaitTermination()
    return spark.read.parquet(f"{path}/out").where("seq is not null").orderBy("seq", "idx").collect()


def test_push_emits_n_minus_one_for_each_sequence_in_any_order(spark, tmp_path, rocks):
    rng = np.random.default_rng(0)
    stack = {"a": rng.random((6, 2, 2)), "b": rng.random((1, 2, 2))}
    frames = frames_of(spark, stack).select("seq", "idx", "height", "width", "data")
    got = streamed(spark, tmp_path, [frames.where(p) for p in ("idx in (0, 3)", "idx in (2, 5, 3)", "idx in (1, 4, 0)")], push.Difference())  # early, repeated and late frames
    assert [(r["seq"], r["idx"]) for r in got] == [("a", k) for k in range(5)]
    for r in got:
        assert np.allclose(r["change"], (stack["a"][r["idx"] + 1] - stack["a"][r["idx"]]).ravel(), atol=1e-6)


def test_push_of_many_early_frames_resets_and_patience(spark, tmp_path, rocks):
    """More frames wait than a task holds; a reset pairs with none before it; a gap that stays open fails the stream if asked to."""
    n = 2 * push.HELD + 9
    stack = np.arange(n, dtype=float)[:, None, None] ** 2 * np.ones((1, 1, 2))
    frames = frames_of(spark, {"a": stack}).select("seq", "idx", "height", "width", "data", (F.col("idx") == 70).alias("reset"))
    got = streamed(spark, tmp_path / "1", [frames.where("idx > 0"), frames.where("idx = 0")], push.Difference())
    assert [r["idx"] for r in got] == [k for k in range(n - 1) if k != 69]
    assert all(r["change"] == [2.0 * r["idx"] + 1] * 2 for r in got)
    with pytest.raises(Exception, match="frame 0 is missing"):
        streamed(spark, tmp_path / "2", [frames.where("idx > 0")], push.Difference(patience=20))


def test_headers_move_no_pixels(spark, tmp_path):
    """Shapes and cut files are told from the first bytes and the size; headers longer than a read, and of version 2, are read whole."""
    import numpy as np

    (tmp_path / "a").mkdir()
    for k in range(3):
        np.save(tmp_path / f"a/{k:05d}_flow.npy", np.ones((2, 40, 50), dtype=np.float32))
    raw = (tmp_path / "a/00000_flow.npy").read_bytes()
    (tmp_path / "a/00003_flow.npy").write_bytes(raw[:-4])
    head = b"{'descr': '<f4', 'fortran_order': False, 'shape': (2, 40, 50), }" + b" " * 3000 + b"\n"
    (tmp_path / "a/00004_flow.npy").write_bytes(b"\x93NUMPY\x02\x00" + len(head).to_bytes(4, "little") + head + raw[128:])
    (tmp_path / "a/00005_flow.npy").write_bytes(b"no array")
    found = {r["idx"]: (r["height"], r["fault"], r["data"]) for r in files.read_headers(files.discover(spark, f"file://{tmp_path}"), 2).collect()}
    assert found[0] == found[4] == (40, None, None) and found[3][1] == "the file is cut short" and found[5][1].startswith("no array file")


@pytest.fixture
def data_batches_only(spark):
    """A stream that ends with its data: else batches go on as long as a timer may come due."""
    key = "spark.sql.streaming.noDataMicroBatches.enabled"
    spark.conf.set(key, "false")
    yield
    spark.conf.unset(key)


def test_a_gap_that_never_closes_is_named_after_its_time(spark, tmp_path, rocks, data_batches_only):
    """Frames 2 and 3 never come: the gap is named once the time is over, in a stream that was started again, and the sequence goes on."""
    import time

    stack = {"a": np.arange(7.0)[:, None, None] ** 2 * np.ones((1, 1, 2)), "b": np.arange(4.0)[:, None, None] * np.ones((1, 1, 2))}
    frames = frames_of(spark, stack).select("seq", "idx", "height", "width", "data")
    schema, wait = frames.schema, 20_000

    def go(part, name):
        part.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/part={name}")
        arriving = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
        query = push.push(arriving, push.Difference(timeout=wait)).writeStream.option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start(f"{tmp_path}/out")
        assert query.awaitTermination(120)
        return {(r["seq"], r["idx"]): (r["change"], r["missing"]) for r in spark.read.parquet(f"{tmp_path}/out").where("seq is not null").collect()}

    first = go(frames.where("(seq = 'a' and idx in (0, 1, 4, 5)) or (seq = 'b' and idx in (0, 2))"), 1)
    assert first == {("a", 0): ([1.0, 1.0], False)}
    second = go(frames.where("seq = 'b' and idx = 1"), 2)  # this gap closes in time
    assert not any(missing for _, missing in second.values()) and ("b", 1) in second
    time.sleep(wait / 1000 + 1)
    third = go(frames.where("seq = 'b' and idx = 3"), 3)
    assert {k for k, (_, missing) in third.items() if missing} == {("a", 2), ("a", 3)} and third["a", 2][0] is None
    assert third["a", 4] == ([9.0, 9.0], False) and ("a", 3) in third and third["b", 2] == ([1.0, 1.0], False)
    last = go(frames.where("seq = 'a' and idx = 6"), 4)
    assert last["a", 5] == ([11.0, 11.0], False) and len(last) == 8


class Kept:
    """States of one key in memory, with a count of the calls."""

    def __init__(self):
        self.calls, self.value, self.rows = 0, None, {}

    def getValueState(self, name, schema):
        return _Value(self)

    def getMapState(self, name, *schemas):
        return _Map(self)


class _Value:
    def __init__(self, kept):
        self.kept = kept

    exists = lambda self: self.kept.value is not None
    get = lambda self: self.kept.value

    def update(self, value):
        self.kept.value = value


class _Map:
    def __init__(self, kept):
        self.kept = kept

    def _counted(self):
        self.kept.calls += 1
        return self.kept.rows

    containsKey = lambda self, key: key in self._counted()
    getValue = lambda self, key: self._counted()[key]

    def removeKey(self, key):
        del self._counted()[key]

    def updateValue(self, key, value):
        self._counted()[key] = value


@pytest.mark.parametrize("page_bytes", [16, 160, push.PAGE_BYTES])
def test_early_frames_wait_in_pages_and_pairs_are_computed_together(page_bytes):
    """Half of a sequence arrives before the other half, both out of order: state and calc are called for pages and batches, not for frames."""
    import pandas as pd

    n, rng, calls = 3000, np.random.default_rng(0), []
    stack = rng.random((n, 2, 2)).astype(np.float32)
    own = push.Difference()
    calc, own.page_bytes = own.calc, page_bytes
    own.calc = lambda a, b: calls.append(len(a)) or calc(a, b)
    kept = Kept()
    own.init(kept)
    order, got = rng.permutation(n), {}
    for batch in (order[: n // 2], [*order[n // 2 :], *order[:9]]):
        rows = pd.DataFrame({"seq": "a", "idx": batch, "height": 2, "width": 2, "data": [stack[k].ravel() for k in batch], "reset": [k == 70 for k in batch]})
        for out in own.handleInputRows(("a",), iter([rows[:1000], rows[1000:]]), None):
            for _, idx, change in out.itertuples(index=False):
                assert idx not in got
                got[idx] = change
        assert kept.value[2] == sum(len(v[0]) for v in kept.rows.values()) and not any(len(v[0]) * 16 > page_bytes for v in kept.rows.values())
    assert sorted(got) == [k for k in range(n - 1) if k != 69] and not kept.rows
    assert all((got[k] == (stack[k + 1] - stack[k]).ravel()).all() for k in got)
    assert len(calls) <= 8 and sum(calls) == n - 2
    if page_bytes > 16:
        assert kept.calls < 2 * n
    if page_bytes == push.PAGE_BYTES:
        assert kept.calls < 10


def test_a_processor_of_single_pairs_and_frames_of_other_sizes():
    import pandas as pd

    shapes = [(2, 3), (2, 3), (3, 2), (3, 2)]
    rows = pd.DataFrame({"seq": "a", "idx": range(4), "height": [h for h, _ in shapes], "width": [w for _, w in shapes], "data": [np.full(6, k, np.float32) for k in range(4)], "reset": False})
    own = push.Push(lambda a, b: [np.full(1, a.shape[0] * 10 + a.shape[1] + b.sum())])
    own.init(Kept())
    got = {r[1]: r[2][0] for out in own.handleInputRows(("a",), iter([rows]), None) for r in out.itertuples(index=False)}
    assert got == {0: 23 + 6, 1: 32 + 12, 2: 32 + 18}
    rows.at[3, "data"], rows.at[3, "height"] = np.ones(8, np.float32), 4
    own.init(Kept())
    with pytest.raises(ValueError, match="frames 2 and 3 are not of one size"):
        list(own.handleInputRows(("a",), iter([rows]), None))
