from __future__ import annotations

import json

import numpy as np
import pytest
from helpers import frames_of, stacks
from pyspark.sql import functions as F

from strobelake.operators import ranges
from strobelake.plans import incremental as inc
from strobelake.plans import preprocess
from strobelake.schema import FRAMES
from strobelake.sinks import tables as sinks
from strobelake.sinks.parts import PartTable


def bounds(spark, pairs):
    return ranges.frame_ranges(frames_of(spark, {s: np.array([[[a, b]] for a, b in p]) for s, p in pairs.items()}))


def test_fold_positions_and_ties(spark):
    rows = ranges.sequence_ranges(bounds(spark, {"a": [(1, 2), (-4, 3), (0, 9), (0.5, 1.5)], "tie": [(0, 5)] * 3})).orderBy("seq").collect()
    assert [(r["min_value"], r["max_value"], r["min_index"], r["max_index"]) for r in rows] == [(-4.0, 9.0, 1, 2), (0.0, 5.0, 0, 0)]
    data = ranges.dataset_range(ranges.sequence_ranges(bounds(spark, {"b": [(0, 9)], "a": [(-1, 3)], "c": [(0, 9)]}))).first()
    assert (data["min_index"], data["max_index"], data["parts"]) == (0, 1, 3)
    assert ranges.dataset_range(ranges.sequence_ranges(bounds(spark, {"a": [(0, 1)]}).limit(0))).count() == 0


def test_only_finite_pixels_count(spark):
    frames = frames_of(spark, {"a": np.array([[[-2.5, np.nan], [7.25, 1]], [[np.inf, -np.inf], [0, 3]], [[np.nan] * 2] * 2])})
    rows = ranges.frame_ranges(frames).orderBy("idx").collect()
    assert [(r["min_value"], r["max_value"]) for r in rows] == [(-2.5, 7.25), (0.0, 3.0), (None, None)]
    assert [r["source"] for r in ranges.unmeasurable(ranges.frame_ranges(frames)).collect()] == ["00002_phase"]


def test_coverage(spark):
    contents = spark.createDataFrame([("c", 0), ("a", 1), ("b", 2)], "seq string, ordinal int")
    pick = lambda *n: spark.createDataFrame([(x,) for x in n], "seq string")
    row = inc.coverage(contents, contents, pick("a").withColumnRenamed("seq", "source"), pick().limit(0) if False else contents.limit(0)).first()
    assert (row["found"], row["selected"], row["covered"], row["skipped"], row["unselected"]) == (3, 3, 1, ["c", "b"], [])
    row = inc.coverage(contents, pick("a", "a"), pick("a").withColumnRenamed("seq", "source"), pick("a")).first()
    assert (row["selected"], row["covered"], row["reused"], row["unselected"]) == (1, 1, 1, ["c", "b"])
    inc.check_coverage(row.asDict())
    with pytest.raises(ValueError):
        inc.check_coverage(row.asDict() | {"found": 9})


def test_settings_compare_after_json():
    assert inc.canonical({"b": (1, 2), "a": 1}) == inc.canonical({"a": 1, "b": [1, 2]})
    with pytest.raises(ValueError):
        inc.canonical({"a": float("nan")})


def test_names_and_policies():
    assert sinks.json_name("r") == "r.json" == sinks.json_name("r.json") and sinks.check_name("plate_A/TL_00") == "plate_A/TL_00"
    for bad in ("", "../x", "/x", "a//b", "a/."):
        with pytest.raises(ValueError):
            sinks.check_name(bad)
    with pytest.raises(ValueError):
        sinks.json_name("a/b")
    with pytest.raises(ValueError):
        sinks.check_policies("maybe", "keep")
    sinks.check_apart("/data/in", "/data/in2")
    with pytest.raises(ValueError):
        sinks.check_apart("/data/in", "/data/in/out")


def test_frame_table(spark, tmp_path):
    sink = sinks.FrameTable(spark, f"file://{tmp_path}/t")
    frames = frames_of(spark, {"a": np.random.default_rng(0).random((3, 2, 2)), "b": np.ones((2, 2, 2))})
    _, rows = sink.stage(frames.withColumn("idx", F.col("idx") + 5), "{}")
    assert sink.manifest().count() == 0  # staged only
    sink.commit(rows)
    assert np.allclose(stacks(sink.read(FRAMES))["a"], stacks(frames)["a"])
    assert [r["idx"] for r in sink.read(FRAMES).where("seq = 'a'").orderBy("idx").collect()] == [0, 1, 2]
    with pytest.raises(ValueError, match="already written: a, b"):
        sink.open(frames, "error")
    sink.drop(frames.where("seq = 'b'").select("seq").distinct())
    assert set(stacks(sink.read(FRAMES))) == {"a"}
    with pytest.raises(ValueError, match="a gap between frames"):
        sink.stage(frames.where("idx <> 1"), "{}")
    with pytest.raises(ValueError, match="non-finite"):
        sink.stage(frames_of(spark, {"x": np.full((1, 1, 1), np.nan)}), "{}")
    with pytest.raises(ValueError, match="no frame"):
        sink.stage(frames.withColumn("data", F.when(F.col("seq") == "a", F.col("data"))), "{}")


def test_commit_together_takes_back(spark, tmp_path):
    good, bad = sinks.FrameTable(spark, f"file://{tmp_path}/g"), sinks.FrameTable(spark, f"file://{tmp_path}/b")
    frames = frames_of(spark, {"a": np.ones((2, 1, 1))})
    staged = [(s, s.stage(frames, "{}")[1]) for s in (good, bad)]
    bad.commit = lambda rows: (_ for _ in ()).throw(OSError("full"))
    with pytest.raises(OSError):
        sinks.commit_together(staged)
    assert good.manifest().count() == 0
    with pytest.raises(OSError):  # what is published last takes all sinks back
        sinks.commit_together(staged[:1], lambda: (_ for _ in ()).throw(OSError("full")))
    assert good.manifest().count() == 0
    sinks.commit_together(staged[:1])
    assert good.manifest().count() == 1


def test_a_revoked_run_leaves_what_counted_before(spark, tmp_path):
    sink = sinks.FrameTable(spark, f"file://{tmp_path}/t")
    first, second = frames_of(spark, {"a": np.ones((2, 1, 1)), "b": np.ones((1, 1, 1))}), frames_of(spark, {"a": np.zeros((3, 1, 1))})
    for frames, fails in ((first, False), (second, True)):
        staged = [(sink, sink.stage(frames, "{}")[1])]
        if fails:
            with pytest.raises(OSError):
                sinks.commit_together(staged, lambda: (_ for _ in ()).throw(OSError("full")))
        else:
            sinks.commit_together(staged)
    assert {k: v.shape[0] for k, v in stacks(sink.read(FRAMES)).items()} == {"a": 2, "b": 1}


def test_claims_are_never_shared(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    with ThreadPoolExecutor(8) as pool:
        got = list(pool.map(lambda _: sinks.claim(spark, f"file://{tmp_path}/claims"), range(24)))
    assert len(set(got)) == 24


@pytest.mark.parametrize("same", [False, True])
def test_runs_at_the_same_time_lose_nothing(spark, tree, tmp_path, monkeypatch, same):
    """A run that begins, reads and commits while another is between its reading and its commit."""
    target, inner = f"file://{tmp_path}/out", []
    other = preprocess.Job(target=target, include=["TL_01", "TL_02"] if same else ["TL_02"], filter={"kind": "identity"}, if_present="overwrite")
    commit = preprocess.commit_together

    def interleaved(staged, then):
        if not inner:
            inner.append(None)
            inner[0] = preprocess.run(tree, other).verdict()
        commit(staged, then)

    monkeypatch.setattr(preprocess, "commit_together", interleaved)
    done = preprocess.run(tree, preprocess.Job(target=target, include=["TL_00", "TL_01"], filter={"kind": "identity"}, if_present="overwrite"))
    assert inner[0]["failed"] == 0 and done.verdict() == {"computed": 2, "unchanged": 0, "failed": 0}
    assert set(stacks(sinks.FrameTable(spark, f"{target}/frames").read(FRAMES))) == {"TL_00", "TL_01", "TL_02"}
    parts = PartTable(spark, f"{target}/ranges.parts").current()
    assert sorted(r["source"] for r in parts.collect()) == ["TL_00", "TL_01", "TL_02"]
    assert json.loads(done.document)["coverage"]["covered"] == 3


def test_frames_are_read_once_and_measured_while_written(spark, tree, tmp_path):
    """The pixels that a run wrote are not read again: ranges come from columns beside them."""
    sink = sinks.FrameTable(spark, f"file://{tmp_path}/t")
    run, _ = sink.stage(tree, "{}")
    got = sink.ranges(run)
    scanned = got._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[1]
    assert "data" not in scanned and "_low" in scanned
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, ranges.frame_ranges(tree).collect()))


def test_digests_tell_order_names_and_counts(spark):
    from strobelake.sources import select as sel

    frames = frames_of(spark, {s: np.ones((4, 1, 1)) for s in "abcd"})
    digests = lambda f: {r["seq"]: r["digest"] for r in sel.content_digests(f).collect()}
    whole = digests(frames)
    assert len(set(whole.values())) == 1 and len(whole["a"]) == 64
    swapped = frames.withColumn("idx", F.when(F.col("seq") == "a", 3 - F.col("idx")).otherwise(F.col("idx")))
    fewer = swapped.where("not (seq = 'b' and idx = 3)").withColumn("source_name", F.when((F.col("seq") == "c") & (F.col("idx") == 1), "other").otherwise(F.col("source_name")))
    other = digests(fewer.repartition(5))
    assert other["d"] == whole["d"] and len({other[s] for s in "abcd"}) == 4
    assert digests(frames.unionByName(frames.where("seq = 'a' and idx = 0")).unionByName(frames.where("seq = 'a' and idx = 0")))["a"] != whole["a"]


@pytest.fixture
def tree(spark):
    rng = np.random.default_rng(0)
    return frames_of(spark, {f"TL_0{s}": rng.random((4, 4, 5)) * (s + 1) for s in range(3)})


def test_job_writes_frames_and_document(spark, tree, tmp_path):
    job = preprocess.Job(target=f"file://{tmp_path}/out", include=["TL_01"], step=2, filter={"kind": "median", "radius": [1, 1, 1], "shape": "cuboid"})
    done = preprocess.run(tree, job)
    document = json.loads(open(f"{tmp_path}/out/ranges.json").read())
    assert list(document) == ["settings", "coverage", "dataset"]
    assert document["coverage"] == {"found": 3, "selected": 1, "covered": 1, "reused": 0, "skipped": [], "unselected": ["TL_00", "TL_02"]}
    assert [f["source"] for f in document["dataset"]["sequences"][0]["frames"]] == ["00000_phase", "00002_phase"]
    assert done.verdict() == {"computed": 1, "unchanged": 0, "failed": 0}
    written = sinks.FrameTable(spark, f"file://{tmp_path}/out/frames").read(FRAMES)
    want = job.kernel().apply(stacks(tree)["TL_01"][::2].astype(np.float32))
    assert np.allclose(stacks(written)["TL_01"], want, atol=1e-6)
    with pytest.raises(ValueError, match="already measured: TL_01"):
        preprocess.run(tree, job)


def test_job_reuses_what_is_valid(spark, tree, tmp_path):
    job = preprocess.Job(target=f"file://{tmp_path}/out", filter={"kind": "identity"}, if_present="reuse")
    assert preprocess.run(tree, job).verdict()["computed"] == 3
    again = preprocess.run(tree, job)
    assert again.verdict() == {"computed": 0, "unchanged": 3, "failed": 0}
    assert json.loads(again.document)["coverage"]["reused"] == 3
    fewer = preprocess.run(tree.where("not (seq = 'TL_02' and idx = 3)"), job)
    assert fewer.verdict() == {"computed": 1, "unchanged": 2, "failed": 0}
    gone = preprocess.run(tree.where("seq <> 'TL_00'"), preprocess.Job(target=job.target, filter={"kind": "identity"}, if_present="reuse", if_unsourced="delete"))
    assert json.loads(gone.document)["coverage"]["found"] == 2
    assert set(stacks(sinks.FrameTable(spark, f"file://{tmp_path}/out/frames").read(FRAMES))) == {"TL_01", "TL_02"}


def test_job_isolates_failures(spark, tree, tmp_path):
    broken = tree.withColumn("data", F.when((F.col("seq") == "TL_01") & (F.col("idx") == 2), F.array_repeat(F.lit(float("nan")).cast("float"), 20)).otherwise(F.col("data")))
    with pytest.raises(preprocess.IncompleteRun) as error:
        preprocess.run(broken, preprocess.Job(target=f"file://{tmp_path}/out", filter={"kind": "identity"}))
    assert error.value.reasons == {"TL_01": "non-finite pixels in 00002_phase"}
    document = json.loads(open(f"{tmp_path}/out/ranges.json").read())
    assert document["coverage"]["skipped"] == ["TL_01"] and len(document["dataset"]["sequences"]) == 2


def test_job_names_every_fault_and_goes_on(spark, tree, tmp_path):
    """Sequences of the wrong shape or first number fail by themselves, and every reason is kept."""
    short = tree.withColumn("data", F.when((F.col("seq") == "TL_00") & (F.col("idx") == 1), F.slice("data", 1, 7)).otherwise(F.col("data")))
    late = short.withColumn("source_idx", F.col("source_idx") + F.when(F.col("seq") == "TL_02", 4).otherwise(0))
    with pytest.raises(preprocess.IncompleteRun) as error:
        preprocess.run(late, preprocess.Job(target=f"file://{tmp_path}/out", filter={"kind": "identity"}, first=0))
    assert error.value.count == 2 and set(error.value.reasons) == {"TL_00", "TL_02"} and "start at 0" in error.value.reasons["TL_02"]
    assert error.value.outcome.verdict() == {"computed": 1, "unchanged": 0, "failed": 2}
    many = spark.range(1500).select(F.concat(F.lit("s"), "id").alias("seq"), F.lit(False).alias("computed"), F.lit("broken").alias("reason"))
    assert len(preprocess.IncompleteRun(preprocess.Outcome(many, ""), 1500, {}).reasons) == 1500


def test_job_computes_folders_that_lost_files_again(spark, tree, tmp_path):
    import shutil

    job = preprocess.Job(target=f"file://{tmp_path}/out", filter={"kind": "identity"}, if_present="reuse", vacuum=True)
    preprocess.run(tree, job)
    (folder,) = (tmp_path / "out/frames/runs").glob("run=*/seq=TL_01")
    shutil.rmtree(folder)
    assert preprocess.run(tree, job).verdict() == {"computed": 1, "unchanged": 2, "failed": 0}
    table = sinks.FrameTable(spark, f"file://{tmp_path}/out/frames")
    assert set(stacks(table.read(FRAMES))) == {"TL_00", "TL_01", "TL_02"}
    table.stage(tree, "{}")  # a run that never commits
    assert len(list((tmp_path / "out/frames/runs").glob("run=*"))) == 3
    assert table.vacuum() == 1 and set(stacks(table.read(FRAMES))) == {"TL_00", "TL_01", "TL_02"}


def test_units_and_sweep(spark, tmp_path):
    scale = 2.0e-7
    metres = frames_of(spark, {"a": np.linspace(0, 4 * scale, 20).reshape(1, 4, 5)}, unit="m", height_scale=scale)
    done = preprocess.run(metres, preprocess.Job(target=f"file://{tmp_path}/u", filter={"kind": "identity"}))
    data = json.loads(done.document)["dataset"]
    assert data["min_value"] == 0 and data["max_value"] == pytest.approx(4, abs=1e-5)
    with pytest.raises(ValueError):
        preprocess.sweep(metres, preprocess.Job(target=f"file://{tmp_path}/s"), {})
    swept = preprocess.sweep(metres, preprocess.Job(target=f"file://{tmp_path}/s", write_frames=False), {"identity": {"kind": "identity"}, "flat": {"kind": "gaussian", "sigma": [1.0, 1.0, 0.0]}})
    assert json.loads(swept["flat"].document)["dataset"]["max_value"] < json.loads(swept["identity"].document)["dataset"]["max_value"]


def test_part_faults(spark):
    frame = [("f", 0.0, 1.0)]
    rows = [("ok", 0.0, 1.0, 0, 0, frame, "{}"), ("nan", float("nan"), 1.0, 0, 0, frame, "{}"), ("turned", 2.0, 1.0, 0, 0, frame, "{}"), ("none", None, 1.0, 0, 0, frame, "{}"), ("bare", 0.0, 1.0, 0, 0, [], "{}")]
    from strobelake.schema import SEQUENCE_RANGES

    assert {r["source"] for r in inc.part_faults(spark.createDataFrame(rows, SEQUENCE_RANGES)).collect()} == {"nan", "turned", "none", "bare"}
