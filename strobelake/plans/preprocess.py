"""The preprocessing job: select, check, filter, write frames and the range document, reuse what is still valid."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strobelake.functions.pixels import to_radians
from strobelake.operators.filters import apply_filter, describe, kernel
from strobelake.operators.ranges import frame_ranges, part_rows
from strobelake.plans.incremental import canonical, complete_folders, covered, part_faults, reusable, to_compute, unsourced
from strobelake.schema import shape_faults
from strobelake.sinks.documents import document, read_document, save_document
from strobelake.sinks.parts import PartTable
from strobelake.sinks.tables import FrameTable, check_apart, check_name, check_policies, commit_together
from strobelake.sources import select as sel


class IncompleteRun(RuntimeError):
    """Some sequences failed; ``outcome`` is what the run would have returned, with every reason."""

    def __init__(self, outcome: Outcome, count: int, first: Mapping[str, str]):
        self.outcome, self.count = outcome, count
        super().__init__(f"{count} failed: " + "; ".join(f"{k}: {v}" for k, v in first.items()))

    @property
    def reasons(self) -> dict[str, str]:
        """Every reason by sequence, read when asked for."""
        return {r["seq"]: r["reason"] for r in self.outcome.outcomes.where("reason is not null").toLocalIterator()}


@dataclass(frozen=True)
class Job:
    """What a run does. Selection is not part of the settings that reuse compares.

    ``first`` is the number that source frames must start at; ``vacuum`` deletes frames that
    no longer count once the run is committed, so no other run may be writing.
    """

    target: str
    name: str = "ranges"
    source: str = ""
    include: Sequence[str] | str | None = None
    exclude: Sequence[str] | str | None = None
    start: int = 0
    step: int = 1
    count: int | None = None
    first: int | None = None
    if_short: str = "take"
    filter: Mapping = field(default_factory=lambda: {"kind": "median", "radius": [2, 2, 2], "shape": "ellipsoid"})
    write_frames: bool = True
    vacuum: bool = False
    if_present: str = "error"
    if_unsourced: str = "keep"

    def __post_init__(self) -> None:
        check_name(self.name)
        check_policies(self.if_present, self.if_unsourced)
        sel.check_selection(self.start, self.step, self.count)
        if self.source:
            check_apart(self.source, self.target)

    def kernel(self) -> object:
        parameters = {k: tuple(v) if isinstance(v, list) else v for k, v in self.filter.items() if k != "kind"}
        return kernel(self.filter["kind"], **parameters)

    def settings(self) -> dict:
        return {"source": {"path": self.source, "frames": {"start": self.start, "step": self.step, "count": self.count}}, "filter": describe(self.kernel())}


@dataclass(frozen=True)
class Outcome:
    """What came of a run."""

    outcomes: DataFrame
    path: str

    @property
    def document(self) -> str:
        """The document's text, read when asked for."""
        return read_document(self.outcomes.sparkSession, self.path)

    def verdict(self) -> dict[str, int]:
        """How many sequences were computed, unchanged and failed."""
        return verdict_counts(self.outcomes).first().asDict()


def verdict_counts(outcomes: DataFrame) -> DataFrame:
    """One row of how many outcomes (seq, computed, reason) were computed, unchanged and failed."""
    failed = F.col("reason").isNotNull()
    return outcomes.agg(F.count_if(F.col("computed")).alias("computed"), F.count_if(~F.col("computed") & ~failed).alias("unchanged"), F.count_if(failed).alias("failed"))


def run(frames: DataFrame, job: Job) -> Outcome:
    """Run over a frames table. Sequences at fault are left out and named; IncompleteRun is raised once all else is committed."""
    spark = frames.sparkSession
    settings = canonical(job.settings())
    known = sel.content_digests(sel.select_frames(frames, job.start, job.step, job.count))
    known = known.withColumn("ordinal", F.col("seq"))
    chosen = sel.select_sequences(frames, job.include, job.exclude)
    if chosen.isEmpty():
        raise ValueError("the selection leaves no sequence")
    taken = sel.select_frames(chosen, job.start, job.step, job.count)
    sel.require_count(chosen, taken, job.count, job.if_short)
    names = chosen.select("seq").distinct()

    sink = FrameTable(spark, f"{job.target.rstrip('/')}/frames")
    table = PartTable(spark, f"{job.target.rstrip('/')}/{job.name}.parts")
    old = table.current()
    if job.if_present == "error":
        found = old.select(F.col("source").alias("seq")).join(names, "seq", "left_semi").limit(5).collect()
        if found:
            raise ValueError("already measured: " + ", ".join(r["seq"] for r in found))
    if job.write_frames:
        sink.open(names, job.if_present, job.if_unsourced)

    kept_parts = reusable(old, known, settings) if job.if_present == "reuse" else names.limit(0)
    kept_frames = names.limit(0)
    if job.if_present == "reuse" and job.write_frames:
        kept_frames = reusable(sink.manifest().select(F.col("seq").alias("source"), "settings", "digest"), known, settings)
        kept_frames = kept_frames.join(complete_folders(sink.counts(), sink.manifest()), "seq", "left_semi")
    need = to_compute(names, *([kept_parts, kept_frames] if job.write_frames else [kept_parts])).persist()
    todo = taken.join(need, "seq", "left_semi")
    fault = lambda rows, reason: rows.select("seq", F.lit(False).alias("computed"), reason.alias("reason")).join(need, "seq", "left_semi")
    gapped = fault(sel.gaps(chosen, job.first), F.lit("frame numbers have gaps" + ("" if job.first is None else f" or don't start at {job.first}")))
    shaped = fault(shape_faults(todo), F.col("fault")).join(gapped, "seq", "left_anti")
    unfit = gapped.unionByName(shaped).persist()
    fine, refused = sel.split_finite(todo.join(unfit.select("seq"), "seq", "left_anti"))
    refused = refused.unionByName(unfit).persist()
    radians = fine.withColumn("data", to_radians(F.col("data"), F.col("unit"), F.col("height_scale"))).withColumn("unit", F.lit("rad"))
    filtered = apply_filter(radians, job.kernel())

    run_id, rows = sink.stage(filtered, settings) if job.write_frames and not fine.isEmpty() else ("", None)
    # frames are measured while they are written; where they are not, once
    measured = frame_ranges(filtered).persist() if rows is None else sink.ranges(run_id)
    new = part_rows(measured, settings)
    gone = unsourced(old.select(F.col("source").alias("seq")), known).select(F.col("seq").alias("source"))
    staged = table.stage(new, measured.select(F.col("seq").alias("source"), "idx", F.col("source").alias("name"), "min_value", "max_value"), gone if job.if_unsourced == "delete" else None)
    commit_together([] if rows is None else [(sink, rows)], lambda: table.publish(staged))
    if rows is None:
        measured.unpersist()
    if job.write_frames and job.if_unsourced == "delete":
        sink.drop(unsourced(sink.manifest(), known))
    if job.write_frames and job.vacuum:
        sink.vacuum()

    parts = table.current().join(known.select(F.col("seq").alias("source")), "source", "left_semi")
    bad = part_faults(parts, table.frames(parts))
    sound = parts.join(bad.select("source"), "source", "left_anti")
    text = document(job.settings(), covered(known, names, sound, names.join(need, "seq", "left_anti")), sound, table.frames(sound), job.source or job.name)
    path = save_document(spark, job.target, job.name, text)
    done = need.join(refused.select("seq"), "seq", "left_anti").select("seq", F.lit(True).alias("computed"), F.lit(None).cast("string").alias("reason"))
    unchanged = names.join(need, "seq", "left_anti").select("seq", F.lit(False).alias("computed"), F.lit(None).cast("string").alias("reason"))
    broken = bad.select(F.coalesce("source", F.lit("?")).alias("seq"), F.lit(False).alias("computed"), F.concat(F.lit("bad range part: "), "fault").alias("reason"))
    whole = done.unionByName(unchanged).join(broken.select("seq"), "seq", "left_anti")
    result = Outcome(whole.unionByName(refused.join(broken.select("seq"), "seq", "left_anti")).unionByName(broken), path)
    failed = result.outcomes.where("reason is not null")
    count = failed.count()
    if count:
        raise IncompleteRun(result, count, {r["seq"]: r["reason"] for r in failed.orderBy("seq").limit(5).collect()})
    return result


def sweep(frames: DataFrame, job: Job, filters: Mapping[str, Mapping]) -> dict[str, Outcome]:
    """One run for each filter over the shared source; frames are not written in a sweep."""
    from dataclasses import replace

    if job.write_frames:
        raise ValueError("a sweep writes ranges only")
    return {name: run(frames, replace(job, filter=f, name=f"{job.name}_{name}")) for name, f in filters.items()}
