"""Array files as a data source: pruning, the commit protocol, units and scales."""

from __future__ import annotations

import numpy as np
import pytest
from helpers import frames_of, stacks
from pyspark.sql import datasource as ds
from pyspark.sql import functions as F

from strobelake.sources import array_files as af
from strobelake.sources import files


@pytest.fixture(scope="module")
def source(spark):
    af.register(spark)
    return spark


def reader(root, **options):
    return af.ArrayReader({"path": f"file://{root}", **options}, None)


def paths(root):
    return sorted(str(p.relative_to(root)) for p in root.rglob("*.npy"))


def save(path, array):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(files.npy_bytes(array))


def test_frames_go_out_and_come_back(source, tmp_path):
    rng = np.random.default_rng(0)
    given = {"plate_A/TL_00": rng.random((5, 3, 4)), "TL_01": rng.random((2, 3, 4))}
    frames = frames_of(source, given).withColumn("idx", F.col("idx") + 7)  # renumbered from 0
    frames.repartition(3).write.format("array_files").mode("append").save(f"file://{tmp_path}/out")
    got = source.read.format("array_files").load(f"file://{tmp_path}/out")
    back = stacks(got)
    assert back.keys() == given.keys() and all(np.allclose(back[k], given[k], atol=1e-6) for k in given)
    assert {(r["unit"], r["pixel_size"], r["height_scale"]) for r in got.collect()} == {("rad", 0.15, 2.0e-7)}
    assert paths(tmp_path / "out")[:2] == ["TL_01/00000_phase.npy", "TL_01/00001_phase.npy"]
    assert not (tmp_path / "out/_staging").exists() or not list((tmp_path / "out/_staging").iterdir())
    assert got.where("fault is not null").count() == 0
    plan = got.where("seq = 'TL_01'").select("seq", "data")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_nanometres_become_metres(source, tmp_path):
    frames_of(source, {"a": np.full((1, 2, 2), 250.0)}, unit="nm").write.format("array_files").mode("append").save(f"file://{tmp_path}")
    row = source.read.format("array_files").load(f"file://{tmp_path}").first()
    assert row["unit"] == "m" and row["data"] == pytest.approx([2.5e-7] * 4)


def test_conditions_prune_files(source, tmp_path):
    for seq in ("a", "b", "c/d"):
        for k in range(6):
            save(tmp_path / seq / "Phase" / f"{k:05d}_phase.npy", np.full((2, 2), k, dtype=np.float32))
    own = reader(tmp_path, subpath="Phase")
    left = list(own.pushFilters([ds.EqualTo(("seq",), "c/d"), ds.GreaterThanOrEqual(("idx",), 2), ds.LessThan(("idx",), 4), ds.IsNotNull(("seq",)), ds.EqualTo(("unit",), "m")]))
    assert [type(f) for f in left] == [ds.EqualTo] and [r[:3] for p in own.partitions() for r in p.rows] == [("c/d", k, f"{k:05d}_phase.npy") for k in (2, 3)]
    (tmp_path / "b" / "Phase" / "00003_phase.npy").write_bytes(b"no array at all")
    rows = source.read.format("array_files").option("subpath", "Phase").load(f"file://{tmp_path}")
    assert [(r["seq"], r["idx"], r["data"][0]) for r in rows.where("seq in ('a', 'c/d') and idx > 3").orderBy("seq", "idx").collect()] == [("a", 4, 4.0), ("a", 5, 5.0), ("c/d", 4, 4.0), ("c/d", 5, 5.0)]
    assert [r["source_name"] for r in rows.where("fault is not null").collect()] == ["00003_phase.npy"]
    assert rows.where("seq = 'none'").count() == 0 and rows.where("idx = 1 and seq like '%d'").count() == 1
    assert len(reader(tmp_path, subpath="Phase", task_bytes="400").partitions()) > 3
    heads = source.read.format("array_files").option("subpath", "Phase").option("pixels", "false").load(f"file://{tmp_path}")
    assert "data" not in heads.columns and heads.where("height = 2 and width = 2").count() == 17


def test_sequences_inside_sequences_and_hidden_files_are_left_out(tmp_path):
    for name in ("TL_00/Phase", "TL_00/inner/Phase", "TL_001/Phase", "p/TL_01/Phase", ".x/Phase", "_staging/r/Phase"):
        save(tmp_path / name / "00000_phase.npy", np.zeros((1, 1), dtype=np.float32))
    assert {r[0] for r in reader(tmp_path, subpath="Phase").listed()} == {"TL_00", "TL_001", "p/TL_01"}


def test_a_failed_task_leaves_nothing(source, tmp_path):
    frames = frames_of(source, {"a": np.ones((3, 2, 2)), "b": np.ones((3, 2, 2))})
    broken = frames.withColumn("data", F.when((F.col("seq") == "b") & (F.col("idx") == 2), F.array(*[F.lit(float("inf")).cast("float")] * 4)).otherwise(F.col("data")))
    for bad, why in ((broken, "non-finite"), (frames.where("not (seq = 'a' and idx = 1)"), "a gap"), (frames.unionByName(frames.where("idx = 0")), "twice|meanwhile"), (frames.limit(0), "no array"), (frames.withColumn("height", F.lit(9)), "fill")):
        with pytest.raises(Exception, match=why):
            bad.repartition(2).write.format("array_files").mode("append").save(f"file://{tmp_path}/t")
        assert not (tmp_path / "t").exists() or (paths(tmp_path / "t") == [] and not list((tmp_path / "t").glob("_manifest/*")))
    with pytest.raises(Exception, match="missing"):
        frames.drop("width").write.format("array_files").mode("append").save(f"file://{tmp_path}/t")


def test_present_sequences_are_refused_or_replaced_together(source, tmp_path, monkeypatch):
    root = f"file://{tmp_path}"
    write = lambda rows, mode: rows.write.format("array_files").mode(mode).save(root)
    write(frames_of(source, {"a": np.ones((3, 2, 2)), "b": np.ones((1, 2, 2))}), "append")
    with pytest.raises(Exception, match="already written: a"):
        write(frames_of(source, {"a": np.zeros((2, 2, 2)), "c": np.zeros((2, 2, 2))}), "append")
    assert len(paths(tmp_path)) == 4
    write(frames_of(source, {"a": np.zeros((2, 2, 2))}), "overwrite")
    for committed in ("true", "false"):
        back = stacks(source.read.format("array_files").option("committed", committed).load(root))
        assert {k: v.shape[0] for k, v in back.items()} == {"a": 2, "b": 1} and back["a"].max() == 0
    save(tmp_path / "a" / "00009_phase.npy", np.ones((2, 2), dtype=np.float32))  # of no run
    assert source.read.format("array_files").option("committed", "true").load(root).where("seq = 'a'").count() == 2
    own = af.ArrayWriter({"path": root}, frames_of(source, {"a": np.ones((1, 1, 1))}).schema, True)
    batch = frames_of(source, {"a": np.full((2, 2, 2), 5.0)}).toArrow().to_batches()
    message = own.write(iter(batch))
    monkeypatch.setattr(af.pyarrow.parquet, "write_table", lambda *a, **k: (_ for _ in ()).throw(OSError("full")))
    with pytest.raises(OSError, match="full"):
        own.commit([message])
    monkeypatch.undo()
    assert stacks(source.read.format("array_files").option("committed", "true").load(root))["a"].max() == 0
    assert not (tmp_path / "_staging" / own.run).exists()


def test_flows_as_files(source, tmp_path):
    flows = source.createDataFrame([("s", k, 2, 3, [float(k)] * 6, [-float(k)] * 6) for k in range(4)] + [("s", 4, 2, 3, None, None)], "seq string, idx int, height int, width int, dx array<float>, dy array<float>")
    flows.write.format("array_files").option("channels", 2).mode("append").save(f"file://{tmp_path}")
    rows = source.read.format("array_files").option("channels", 2).load(f"file://{tmp_path}").orderBy("idx").collect()
    assert [(r["idx"], r["dx"], r["dy"]) for r in rows] == [(k, [float(k)] * 6, [-float(k)] * 6) for k in range(4)]
    with pytest.raises(Exception, match="channels"):
        af.ArrayReader({"path": "/x", "channels": "3"}, None)
    with pytest.raises(ValueError, match="path"):
        af.ArrayReader({}, None)
