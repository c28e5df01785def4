"""Every query of the frame engine by name, with the SQL it must agree with."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Sequence
from math import tau

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strobelake.functions import pixels as px
from strobelake.operators import filters, flow, normalize, pairing, ranges, score, tiles, warp, windows
from strobelake.plans import fields, incremental, preprocess, range_tree, views
from strobelake.sinks.tables import FrameTable
from strobelake.sources import array_files, files, select, tables
from strobelake.streaming import push

Query = Callable[[SparkSession, str], DataFrame]

PIXEL_SIZE, WAVELENGTH, ALPHA, DELTA, RATE = 0.15, 666.0, 0.18, 0.04, 25.0
SETTINGS = '{"filter":{"kind":"identity"}}'

_PHASE = "phase AS (SELECT label::VARCHAR AS seq, (row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1)::INTEGER AS idx, embedding AS data FROM embeddings)"
_CELLS = f"{_PHASE}, cells AS (SELECT seq, idx, k // 8 AS y, k % 8 AS x, data[k + 1] AS v FROM phase, range(64) t(k))"
_FLOW = f"{_CELLS}, sizes AS (SELECT seq, count(*) AS n FROM phase GROUP BY seq), flow AS (SELECT c.*, ((x * 3 + idx * 2) % 5 - 2) * 0.25::DOUBLE AS dx, ((y * 2 + idx) % 5 - 2) * 0.25::DOUBLE AS dy FROM cells c JOIN sizes USING (seq) WHERE idx < n - 1)"
_SIGNAL = "signal AS (SELECT user_id::VARCHAR AS seq, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1)::INTEGER AS idx, value FROM events)"
_RANGES = f"{_PHASE}, frame_range AS (SELECT seq, idx, list_min(data)::DOUBLE + 0.0 AS min_value, list_max(data)::DOUBLE + 0.0 AS max_value FROM phase)"
_SEQUENCES = f"{_RANGES}, sequence_range AS (SELECT seq, min(min_value) AS min_value, max(max_value) AS max_value, arg_min(idx, (min_value, idx)) AS min_index, arg_min(idx, (-max_value, idx)) AS max_index, count(*) AS parts FROM frame_range GROUP BY seq)"


def _round(value: Column | str, digits: int) -> Column:
    """Rounded, with no negative zero."""
    return F.round(value, digits) + F.lit(0.0)


def _cells(frames: DataFrame, digits: int = 5) -> DataFrame:
    rows = filters.pixels(frames)
    return rows.select("seq", "idx", F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"), _round(F.col("v").cast("double"), digits).alias("v"))


def _filtered(kernel: object) -> Query:
    return lambda spark, d: _cells(filters.apply_filter(tables.phase_frames(spark, d), kernel))


def _median_sql(rx: int, ry: int, rz: int, ellipsoid: bool) -> str:
    inside = " + ".join(f"(d{a} / {float(r)}) ** 2" for a, r in (("x", rx), ("y", ry), ("z", rz)) if r) or "0"
    return f"""WITH {_CELLS}, offsets AS (SELECT dx, dy, dz FROM range(-{rx}, {rx + 1}) a(dx), range(-{ry}, {ry + 1}) b(dy), range(-{rz}, {rz + 1}) c(dz) {f"WHERE {inside} <= 1.0" if ellipsoid else ""})
    SELECT p.seq, p.idx, p.y::INTEGER AS y, p.x::INTEGER AS x, round(median(q.v)::DOUBLE, 5) + 0.0 AS v
    FROM cells p CROSS JOIN offsets JOIN cells q ON q.seq = p.seq AND q.idx = p.idx + dz AND q.y = p.y + dy AND q.x = p.x + dx GROUP BY ALL"""


def _gauss_sql(sx: float, sy: float, sz: float) -> str:
    rx, ry, rz = (int(4 * s + 0.5) for s in (sx, sy, sz))
    return f"""WITH {_CELLS}, offsets AS (SELECT dx, dy, dz, exp(-(dx * dx / {2 * sx * sx} + dy * dy / {2 * sy * sy} + dz * dz / {2 * sz * sz})) AS w FROM range(-{rx}, {rx + 1}) a(dx), range(-{ry}, {ry + 1}) b(dy), range(-{rz}, {rz + 1}) c(dz))
    SELECT p.seq, p.idx, p.y::INTEGER AS y, p.x::INTEGER AS x, round((sum(w * q.v) / sum(w))::FLOAT::DOUBLE, 4) + 0.0 AS v
    FROM cells p CROSS JOIN offsets JOIN cells q ON q.seq = p.seq AND q.idx = p.idx + dz AND q.y = p.y + dy AND q.x = p.x + dx GROUP BY ALL"""


# --- ranges -------------------------------------------------------------------------


def frame_range(spark: SparkSession, d: str) -> DataFrame:
    return ranges.frame_ranges(tables.phase_frames(spark, d)).select("seq", "idx", "min_value", "max_value")


def sequence_range(spark: SparkSession, d: str) -> DataFrame:
    return ranges.sequence_ranges(tables.phase_ranges(spark, d))


def dataset_range(spark: SparkSession, d: str) -> DataFrame:
    return ranges.dataset_range(sequence_range(spark, d))


def range_rollup(spark: SparkSession, d: str) -> DataFrame:
    """Both levels of the fold in one pass."""
    rows = ranges.frame_ranges(tables.phase_frames(spark, d))
    return rows.rollup("seq").agg(F.min("min_value").alias("min_value"), F.max("max_value").alias("max_value"), F.count("*").alias("frames"))


def sequence_part_frames(spark: SparkSession, d: str) -> DataFrame:
    parts = ranges.sequence_parts(ranges.frame_ranges(tables.phase_frames(spark, d)), SETTINGS)
    return parts.select("source", "min_index", "max_index", F.size("frames").alias("n_frames"), F.col("frames")[0]["source"].alias("first"), _round(F.element_at("frames", -1)["max_value"], 6).alias("last_max"), "settings")


def range_tree_updates(spark: SparkSession, d: str) -> DataFrame:
    """Each user's events as a part of a two-level fold: first those of half the days, then all, replaced in their branches."""
    users = tables.read(spark, d, "events").select(F.col("user_id").cast("string").alias("source"), "value", (F.dayofmonth("ts") % 2 == 0).alias("early"))
    tree = range_tree.RangeTree(spark, f"{_work(spark)}/tree-{uuid.uuid4().hex}")
    for rows in (users.where("early"), users):
        tree.update(rows.groupBy("source").agg(F.min("value").alias("min_value"), F.max("value").alias("max_value")))
    return tree.fold()


# --- selection ----------------------------------------------------------------------


def frame_select_stride(spark: SparkSession, d: str) -> DataFrame:
    return select.select_frames(tables.phase_frames(spark, d), 1, 3, 10).select("seq", "idx", "source_idx", "source_name")


def select_include_exclude(spark: SparkSession, d: str) -> DataFrame:
    kept = select.select_sequences(tables.phase_frames(spark, d), ["1", "2", "3", "5"], ["3"])
    return kept.groupBy("seq").agg(F.count("*").alias("frames"))


def short_sequences(spark: SparkSession, d: str) -> DataFrame:
    return select.short_sequences(tables.signal(spark, d), 66)


def gap_check(spark: SparkSession, d: str) -> DataFrame:
    lines = tables.read(spark, d, "lineitem").where("l_quantity > 10").select(F.col("l_orderkey").alias("seq"), F.col("l_linenumber").alias("source_idx"))
    return select.gaps(lines, first=1)


def nonfinite_guard(spark: SparkSession, d: str) -> DataFrame:
    frames = tables.phase_frames(spark, d)
    wide = F.transform("data", lambda v: F.when(F.col("idx") % 17 == 0, F.lit(1e300)).when(F.col("idx") % 19 == 0, F.lit(float("nan"))).otherwise(v))
    return select.nonfinite_frames(frames.withColumn("data", wide.cast("array<float>")))


def unit_conversion(spark: SparkSession, d: str) -> DataFrame:
    """The table's values as radians, metres and nanometres in turn, all taken to radians."""
    unit = F.element_at(F.array(F.lit("rad"), F.lit("m"), F.lit("nm")), (F.col("idx") % 3 + 1).cast("int"))
    radians = tables.phase_frames(spark, d).withColumn("data", px.to_radians(F.col("data"), unit, F.col("height_scale")))
    return radians.select("seq", "idx", _round(px.total(F.col("data").cast("array<double>")), 4).alias("total"))


def contents_manifest(spark: SparkSession, d: str) -> DataFrame:
    found = select.contents(tables.phase_frames(spark, d))
    return found.select("seq", F.col("n_source").cast("long").alias("n_source"), F.array_join("frames", ",").alias("frames"))


# --- manifests ----------------------------------------------------------------------


def coverage_counts(spark: SparkSession, d: str) -> DataFrame:
    contents = tables.read(spark, d, "nation").select(F.col("n_name").alias("seq"), F.col("n_nationkey").alias("ordinal"), F.col("n_regionkey").alias("r"))
    parts = contents.where("ordinal % 3 = 0").select(F.col("seq").alias("source"))
    row = incremental.coverage(contents, contents.where("r < 3"), parts, contents.where("ordinal % 6 = 0"))
    return row.select("found", "selected", "covered", "reused", F.array_join("skipped", ",").alias("skipped"), F.array_join("unselected", ",").alias("unselected"))


def unsourced_outputs(spark: SparkSession, d: str) -> DataFrame:
    outputs = tables.read(spark, d, "customer").select(F.col("c_custkey").alias("seq"))
    return incremental.unsourced(outputs, tables.read(spark, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("seq")))


def reuse_plan(spark: SparkSession, d: str) -> DataFrame:
    frames = tables.phase_frames(spark, d)
    parts = ranges.part_rows(ranges.frame_ranges(frames), SETTINGS)
    parts = parts.where("source <> '7'").withColumn("settings", F.when(F.col("source") == "5", "{}").otherwise(F.col("settings")))
    contents = select.content_digests(frames.where("not (seq = '3' and idx = 4)"))
    return incremental.reuse_plan(parts, contents, contents.where("seq <> '9'"), SETTINGS)


def part_faults(spark: SparkSession, d: str) -> DataFrame:
    parts = ranges.sequence_parts(ranges.frame_ranges(tables.phase_frames(spark, d)), SETTINGS)
    broken = parts.withColumn("min_value", F.when(F.col("source") == "1", F.lit(float("nan"))).when(F.col("source") == "2", F.col("max_value") + 1).otherwise(F.col("min_value")))
    broken = broken.withColumn("max_index", F.when(F.col("source") == "4", 1_000_000).otherwise(F.col("max_index"))).withColumn("filed_as", F.when(F.col("source") == "6", "other").otherwise(F.col("source")))
    return incremental.part_faults(broken)


def verdict_counts(spark: SparkSession, d: str) -> DataFrame:
    """Orders as outcomes: computed, unchanged and failed."""
    rows = tables.read(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("seq"), (F.col("o_orderstatus") == "F").alias("computed"), F.when(F.col("o_orderstatus") == "P", "pending").alias("reason"))
    return preprocess.verdict_counts(rows)


def preprocess_document(spark: SparkSession, d: str) -> DataFrame:
    """The whole job over strided frames, and its document as rows."""
    frames = tables.phase_frames(spark, d).withColumn("unit", F.lit("rad"))
    job = preprocess.Job(target=f"{_work(spark)}/job-{uuid.uuid4().hex}", exclude=["0"], step=2, filter={"kind": "identity"})
    part = "struct<source string, min_value double, max_value double, min_index int, max_index int, frames array<struct<source string>>>"
    shape = f"coverage struct<found long, selected long, covered long, unselected array<string>>, dataset struct<sequences array<{part}>>"
    done = spark.read.schema(shape).json(preprocess.run(frames, job).path, multiLine=True)
    rows = done.select("coverage", F.explode("dataset.sequences").alias("s"))
    return rows.select("s.source", "s.min_value", "s.max_value", "s.min_index", "s.max_index", F.size("s.frames").alias("frames"), "coverage.found", "coverage.selected", "coverage.covered", F.array_join("coverage.unselected", ",").alias("unselected"))


def frame_files(spark: SparkSession, d: str) -> DataFrame:
    """Every frame as nanometres written to an array file and read back: metres with their scale, taken to radians."""
    array_files.register(spark)
    root = f"{_work(spark)}/frames-{uuid.uuid4().hex}"
    tables.phase_frames(spark, d).withColumn("unit", F.lit("nm")).write.format("array_files").mode("append").save(root)
    back = spark.read.format("array_files").option("committed", "true").load(root)
    radians = px.to_radians(F.col("data"), F.col("unit"), F.col("height_scale")).cast("array<double>")
    return back.select("seq", "idx", "source_name", "height", "width", "unit", "pixel_size", _round(px.total(radians), 4).alias("total"))


def flow_files(spark: SparkSession, d: str) -> DataFrame:
    """Every flow written to an array file and read back."""
    root = f"{_work(spark)}/flows-{uuid.uuid4().hex}"
    files.write_flow_files(tables.flow_frames(tables.phase_frames(spark, d)), root)
    total = lambda c: _round(px.total(F.col(c).cast("array<double>")), 4).alias(c)
    return files.read_flows(spark, root).select("seq", "idx", total("dx"), total("dy"))


def cached_or_computed(spark: SparkSession, d: str) -> DataFrame:
    """The sequences of odd numbers from a table that holds them, the others computed, behind one name."""
    frames, kernel = tables.phase_frames(spark, d), filters.Median((1, 1, 0), "cuboid")
    sink = FrameTable(spark, f"{_work(spark)}/cache-{uuid.uuid4().hex}")
    sink.commit(sink.stage(filters.apply_filter(frames.where("cast(seq as int) % 2 = 1"), kernel), SETTINGS)[1])
    return _cells(views.cached_or_computed(sink, frames, kernel, SETTINGS))


def median3d_tiled(spark: SparkSession, d: str) -> DataFrame:
    """The median over tiles of 3 x 3 pixels with a halo."""
    cut = tiles.cut(tables.phase_frames(spark, d), 3)
    return _cells(tiles.whole(tiles.filter_tiles(cut, 3, filters.Median((2, 2, 2), "ellipsoid")), 3))


def warp_tiled(spark: SparkSession, d: str) -> DataFrame:
    """Each frame warped onto the one before, tile by tile."""
    pairs = _pairs(spark, d)
    following = pairs.select("seq", "idx", "height", "width", F.col("curr").alias("data")).where("data is not null")
    warped = tiles.warp_tiles(tiles.cut(following, 5), tiles.cut(pairs.select("seq", "idx", "height", "width", "dx", "dy"), 5, ("dx", "dy")), 5)
    return _cells(tiles.whole(warped.where("data is not null"), 5), 4)


def _work(spark: SparkSession) -> str:
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return found.rstrip("/") if found else "file://" + tempfile.mkdtemp(prefix="strobelake-")


# --- windows and filters ------------------------------------------------------------


def median_t_r2(spark: SparkSession, d: str) -> DataFrame:
    return windows.moving_median(tables.signal(spark, d), 2).withColumn("value", _round("value", 6))


def gauss_t(spark: SparkSession, d: str) -> DataFrame:
    return windows.moving_gaussian(tables.signal(spark, d), 1.0).withColumn("value", _round("value", 6))


def trim_spans(spark: SparkSession, d: str) -> DataFrame:
    return windows.trimmed(tables.signal(spark, d), 1, 2).select("seq", "idx", _round("value", 6).alias("value"))


def signal_difference(spark: SparkSession, d: str) -> DataFrame:
    rows = windows.in_blocks(tables.signal(spark, d), 1, 0, windows.SIGNAL_BLOCK)
    rows = windows.core(rows.withColumn("change", _round(F.col("value") - F.lag("value").over(windows.in_time()), 6)), windows.SIGNAL_BLOCK)
    return rows.where("change is not null").select("seq", "idx", "change")


def median3d_relational(spark: SparkSession, d: str) -> DataFrame:
    rows = filters.median_by_offsets(tables.phase_frames(spark, d), filters.Median((1, 1, 1), "cuboid"))
    return rows.select("seq", F.col("idx").cast("int").alias("idx"), F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"), _round(F.col("v").cast("double"), 5).alias("v"))


# --- normalisation ------------------------------------------------------------------


def _totals(frames: DataFrame, name: str = "data") -> DataFrame:
    levels = F.col(name).cast("array<double>")
    return frames.select("seq", "idx", px.total(levels).alias("total"), px.total(F.transform(levels, lambda v: v * v)).alias("squares"))


def normalize_perframe(spark: SparkSession, d: str) -> DataFrame:
    return _totals(normalize.per_frame(tables.phase_frames(spark, d)))


def normalize_pairwise(spark: SparkSession, d: str) -> DataFrame:
    return _totals(normalize.pairwise(tables.phase_frames(spark, d)), "curr")


def normalize_injected_dataset(spark: SparkSession, d: str) -> DataFrame:
    return _totals(normalize.injected(tables.phase_frames(spark, d), dataset_range(spark, d)))


def normalize_injected_sequence(spark: SparkSession, d: str) -> DataFrame:
    return _totals(normalize.injected(tables.phase_frames(spark, d), sequence_range(spark, d), "int16", scope="sequence"))


def normalize_clamped(spark: SparkSession, d: str) -> DataFrame:
    frames = normalize.injected(tables.phase_frames(spark, d), (-1.0, 1.0), "float32", (0.0, 10.0))
    return frames.select("seq", "idx", _round(px.total(F.col("data").cast("array<double>")), 3).alias("total"))


# --- motion and fields --------------------------------------------------------------


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    return flow.neighbours(tables.moving_frames(spark, d), "dx", "dy")


def _warped(padding: str) -> Query:
    return lambda spark, d: _cells(warp.warp_pairs(_pairs(spark, d), "curr", padding).withColumn("data", F.col("warped")), 4)


def pair_scores(spark: SparkSession, d: str) -> DataFrame:
    pairs = flow.neighbours(tables.phase_frames(spark, d))
    a, b = F.col("prev"), F.col("curr")
    return pairs.select("seq", "idx", _round(score.mse(a, b), 6).alias("mse"), _round(score.mae(a, b), 6).alias("mae"), _round(score.psnr(a, b, 8.0), 6).alias("psnr"))


def warp_consistency_mse(spark: SparkSession, d: str) -> DataFrame:
    scored = score.warp_consistency(_pairs(spark, d), 8.0)
    return scored.select("seq", "idx", _round("mse", 4).alias("mse"), _round("mae", 4).alias("mae"))


def warp_consistency_mean(spark: SparkSession, d: str) -> DataFrame:
    return score.reduced(score.warp_consistency(_pairs(spark, d), 8.0), "seq").select("seq", _round("mse", 4).alias("mse"), _round("mae", 4).alias("mae"))


def ssim(spark: SparkSession, d: str) -> DataFrame:
    """Four neighbouring frames tiled to 16 x 16, for SSIM's window does not fit into 8 x 8."""
    frames = tables.phase_frames(spark, d)
    row = lambda a, b: F.flatten(F.transform(F.sequence(F.lit(0), F.lit(7)), lambda y: F.concat(F.slice(a, y * 8 + 1, 8), F.slice(b, y * 8 + 1, 8))))
    rows = windows.in_blocks(frames.select("seq", "idx", "data"), 0, 4, windows.FRAME_BLOCK)
    tiled = windows.core(rows.select("*", *[F.lead("data", k).over(windows.in_time()).alias(f"d{k}") for k in range(5)]), windows.FRAME_BLOCK).where("d4 is not null")
    tile = lambda k: F.concat(row(F.col(f"d{k}"), F.col(f"d{k + 1}")), row(F.col(f"d{k + 2}"), F.col(f"d{k + 3}")))
    pairs = tiled.select("seq", "idx", F.lit(16).alias("height"), F.lit(16).alias("width"), tile(0).alias("a"), tile(1).alias("b"))
    return score.with_ssim(pairs, "a", "b", 8.0).select("seq", "idx", _round("ssim", 6).alias("ssim"))


def _ssim_sql() -> str:
    """Each window position by itself: weighted moments of 11 x 11 pixels, over the 36 positions inside 16 x 16."""
    side, c1, c2 = score.SSIM_SIDE // 2, (score.SSIM_K1 * 8.0) ** 2, (score.SSIM_K2 * 8.0) ** 2
    return f"""WITH {_CELLS}, sizes AS (SELECT seq, count(*) AS n FROM phase GROUP BY seq),
        tiled AS (SELECT a.seq, a.idx - q AS idx, (q // 2) * 8 + a.y AS y, (q % 2) * 8 + a.x AS x, a.v::DOUBLE AS a, b.v::DOUBLE AS b
            FROM cells a JOIN cells b ON b.seq = a.seq AND b.idx = a.idx + 1 AND b.y = a.y AND b.x = a.x JOIN sizes s ON s.seq = a.seq, range(4) t(q) WHERE a.idx >= q AND a.idx - q + 4 < n),
        weights AS (SELECT k, exp(-(k * k) / {2 * score.SSIM_SIGMA**2}) / sum(exp(-(k * k) / {2 * score.SSIM_SIGMA**2})) OVER () AS w FROM range(-{side}, {side + 1}) t(k)),
        moments AS (SELECT seq, idx, t.y - v.k AS cy, t.x - h.k AS cx, sum(v.w * h.w * a) AS ma, sum(v.w * h.w * b) AS mb, sum(v.w * h.w * a * a) AS aa, sum(v.w * h.w * b * b) AS bb, sum(v.w * h.w * a * b) AS ab
            FROM tiled t, weights v, weights h WHERE t.y - v.k BETWEEN {side} AND {15 - side} AND t.x - h.k BETWEEN {side} AND {15 - side} GROUP BY ALL)
        SELECT seq, idx::INTEGER AS idx, round(avg((2 * ma * mb + {c1!r}) * (2 * (ab - ma * mb) + {c2!r}) / ((ma * ma + mb * mb + {c1!r}) * (aa - ma * ma + bb - mb * mb + {c2!r}))), 6) + 0.0 AS ssim
        FROM moments GROUP BY seq, idx"""


def _estimated(kind: str) -> Query:
    def query(spark: SparkSession, d: str) -> DataFrame:
        pairs = flow.neighbours(normalize.injected(tables.phase_frames(spark, d), (-4.0, 4.0)))
        return flow.estimate(pairs, flow.estimator(kind)).select("seq", "idx", _round(px.mean(F.col("dx").cast("array<double>")), 3).alias("dx"), _round(px.mean(F.col("dy").cast("array<double>")), 3).alias("dy"))

    return query


def _plan(wanted: Sequence[str], three: bool = False) -> fields.Plan:
    return fields.Plan(fields.standard(PIXEL_SIZE, WAVELENGTH, ALPHA, RATE, DELTA if three else None), wanted)


def _field(*wanted: str, three: bool = False, aligned: bool = True) -> Query:
    def query(spark: SparkSession, d: str) -> DataFrame:
        found = fields.evaluate(_plan(wanted, three), tables.moving_frames(spark, d), aligned=aligned)
        return fields.signals(found).select("seq", "idx", "metric", _round("value", 5).alias("value"))

    return query


def field_means(spark: SparkSession, d: str) -> DataFrame:
    found = fields.signals(fields.evaluate(_plan(["dry_mass", "velocity"]), tables.moving_frames(spark, d)))
    return fields.weighted_means(found).select("metric", _round("value", 5).alias("value"))


_DRY = px.drymass_factor(PIXEL_SIZE, WAVELENGTH, ALPHA)
_SPEED = PIXEL_SIZE * RATE
_FIELD_SQL = {
    "drymass_signal": f"WITH {_CELLS} SELECT seq, idx, 'dry_mass' AS metric, round(sum(v::DOUBLE * {_DRY!r}), 5) + 0.0 AS value FROM cells GROUP BY ALL",
    "opd_variance": f"WITH {_CELLS}, changes AS (SELECT a.seq, a.idx, (b.v::DOUBLE - a.v::DOUBLE) * {WAVELENGTH / tau!r} AS c FROM cells a JOIN cells b ON b.seq = a.seq AND b.idx = a.idx + 1 AND b.y = a.y AND b.x = a.x) SELECT seq, idx, 'path_variance' AS metric, round(var_pop(c), 5) + 0.0 AS value FROM changes GROUP BY ALL",
    "velocity": f"WITH {_FLOW} SELECT seq, idx, 'velocity' AS metric, round(avg(sqrt(dx * dx + dy * dy) * {_SPEED!r}), 5) + 0.0 AS value FROM flow GROUP BY ALL",
    "acceleration": f"WITH {_FLOW} SELECT b.seq, b.idx, 'acceleration' AS metric, round(avg(sqrt((b.dx - a.dx) ** 2 + (b.dy - a.dy) ** 2) * {_SPEED * RATE!r}), 5) + 0.0 AS value FROM flow a JOIN flow b ON b.seq = a.seq AND b.idx = a.idx + 1 AND b.y = a.y AND b.x = a.x GROUP BY ALL",
    "force": f"WITH {_FLOW} SELECT b.seq, b.idx, 'force' AS metric, round(avg(abs(b.v::DOUBLE * {_DRY!r}) * sqrt((b.dx - a.dx) ** 2 + (b.dy - a.dy) ** 2) * {_SPEED * RATE!r}), 5) + 0.0 AS value FROM flow a JOIN flow b ON b.seq = a.seq AND b.idx = a.idx + 1 AND b.y = a.y AND b.x = a.x GROUP BY ALL",
    "kinetic_energy": f"WITH {_FLOW} SELECT seq, idx, 'kinetic_energy' AS metric, round(sum(v::DOUBLE * {_DRY!r} * (dx * dx + dy * dy) * {_SPEED**2!r}), 5) + 0.0 AS value FROM flow GROUP BY ALL",
    "field_means": f"WITH {_FLOW}, per AS (SELECT seq, idx, sum(v::DOUBLE * {_DRY!r}) AS m, avg(sqrt(dx * dx + dy * dy) * {_SPEED!r}) AS s FROM flow GROUP BY ALL) SELECT 'dry_mass' AS metric, round(avg(m), 5) + 0.0 AS value FROM per UNION ALL SELECT 'velocity', round(avg(s), 5) + 0.0 FROM per",
    "fields_aligned": f"WITH {_FLOW}, per AS (SELECT b.seq, b.idx, sum(b.v::DOUBLE * {_DRY!r}) AS m, avg(sqrt((b.dx - a.dx) ** 2 + (b.dy - a.dy) ** 2) * {_SPEED * RATE!r}) AS a FROM flow a JOIN flow b ON b.seq = a.seq AND b.idx = a.idx + 1 AND b.y = a.y AND b.x = a.x GROUP BY ALL) SELECT seq, idx, 'dry_mass' AS metric, round(m, 5) + 0.0 AS value FROM per UNION ALL SELECT seq, idx, 'acceleration', round(a, 5) + 0.0 FROM per",
}


def _warp_cte(padding: str) -> str:
    clip = {"border": "least(greatest({0}, 0), 7)", "zeros": "{0}", "reflection": "least(abs({0}) % 14, 14 - abs({0}) % 14)"}[padding]
    return f"""{_FLOW}, target AS (SELECT seq, idx, y, x, v, {clip.format("(x + dx)")} AS px, {clip.format("(y + dy)")} AS py FROM flow),
    taps AS (SELECT t.*, floor(px) + kx AS tx, floor(py) + ky AS ty, (CASE kx WHEN 0 THEN 1 - (px - floor(px)) ELSE px - floor(px) END) * (CASE ky WHEN 0 THEN 1 - (py - floor(py)) ELSE py - floor(py) END) AS w FROM target t, range(2) a(kx), range(2) b(ky)),
    warped AS (SELECT t.seq, t.idx, t.y, t.x, any_value(t.v) AS before, coalesce(sum(w * c.v::DOUBLE), 0)::FLOAT AS v FROM taps t LEFT JOIN cells c ON c.seq = t.seq AND c.idx = t.idx + 1 AND c.y = t.ty AND c.x = t.tx GROUP BY t.seq, t.idx, t.y, t.x)"""


def _warp_sql(padding: str) -> str:
    return f"WITH {_warp_cte(padding)} SELECT seq, idx, y::INTEGER AS y, x::INTEGER AS x, round(v::DOUBLE, 4) + 0.0 AS v FROM warped"


def _displacement3d_sql() -> str:
    z = px.height_factor(WAVELENGTH, DELTA)
    return f"WITH {_warp_cte('border')} SELECT w.seq, w.idx, 'displacement' AS metric, round(avg(sqrt((dx * {PIXEL_SIZE}) ** 2 + (dy * {PIXEL_SIZE}) ** 2 + ((w.v::DOUBLE - before::DOUBLE) * {z!r}) ** 2)), 5) + 0.0 AS value FROM warped w JOIN flow f ON f.seq = w.seq AND f.idx = w.idx AND f.y = w.y AND f.x = w.x GROUP BY ALL"


def strict_zip(spark: SparkSession, d: str) -> DataFrame:
    """Each frame against its filtered self."""
    frames = tables.phase_frames(spark, d)
    pairs = pairing.strict_zip(frames, filters.apply_filter(frames, filters.Median((1, 1, 0), "cuboid")))
    return pairs.select("seq", "idx", _round(score.mae(F.col("prev"), F.col("curr")), 5).alias("mae"))


def length_faults(spark: SparkSession, d: str) -> DataFrame:
    """Customers and their orders as two sides that should be equally long."""
    sides = [tables.read(spark, d, "orders").where(f"o_orderstatus = '{s}'").select(F.col("o_custkey").alias("seq")) for s in "FO"]
    return pairing.length_faults(*sides)


def _streamed(processor: push.Push, spark: SparkSession, d: str) -> DataFrame:
    root = f"{_work(spark)}/stream-{uuid.uuid4().hex}"
    frames = tables.phase_frames(spark, d).select("seq", "idx", "height", "width", "data")
    frames.repartition(4).write.parquet(f"{root}/in")
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        arriving = spark.readStream.schema(frames.schema).option("maxFilesPerTrigger", "2").parquet(f"{root}/in")
        stream = push.push(arriving, processor).writeStream.option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start(f"{root}/out")
        stream.awaitTermination()
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)
    return spark.read.schema("seq string, idx int, " + ", ".join(f"{n} array<float>" for n in processor.names)).parquet(f"{root}/out")


def stream_flow_push(spark: SparkSession, d: str) -> DataFrame:
    """Flow between frames as they arrive."""
    found = _streamed(push.FlowPush(flow.Farneback(levels=1)), spark, d)
    return found.select("seq", "idx", _round(px.mean(F.col("dx").cast("array<double>")), 3).alias("dx"), _round(px.mean(F.col("dy").cast("array<double>")), 3).alias("dy"))


def stream_push_diff(spark: SparkSession, d: str) -> DataFrame:
    """The frames as a stream of files: state holds one frame for each sequence."""
    found = _streamed(push.Difference(), spark, d)
    return found.select("seq", "idx", _round(px.total(F.col("change").cast("array<double>")), 4).alias("change"))


def _level_sql(value: str, tail: str = "", cells: str = "cells") -> str:
    return f"SELECT c.seq, c.idx, sum({value}) AS total, sum(({value}) ** 2) AS squares FROM {cells} c {tail} GROUP BY c.seq, c.idx"


def _share(low: str, high: str, span: float, base: float = 0.0) -> str:
    return f"round_even(least(greatest((c.v::DOUBLE - {low}) / ({high} - {low}), 0.0), 1.0) * {span!r} + {base!r}, 0)"


CATALOG: dict[str, tuple[Query, str | None]] = {
    "frame_range": (frame_range, f"WITH {_RANGES} SELECT * FROM frame_range"),
    "sequence_range": (sequence_range, f"WITH {_SEQUENCES} SELECT * FROM sequence_range"),
    "dataset_range": (dataset_range, f"WITH {_SEQUENCES}, ranked AS (SELECT *, (row_number() OVER (ORDER BY seq) - 1)::INTEGER AS r FROM sequence_range) SELECT min(min_value) AS min_value, max(max_value) AS max_value, arg_min(r, (min_value, r)) AS min_index, arg_min(r, (-max_value, r)) AS max_index, count(*) AS parts FROM ranked"),
    "range_rollup": (range_rollup, f"WITH {_RANGES} SELECT seq, min(min_value) AS min_value, max(max_value) AS max_value, count(*) AS frames FROM frame_range GROUP BY ROLLUP (seq)"),
    "sequence_part_frames": (sequence_part_frames, f"WITH {_SEQUENCES}, sizes AS (SELECT seq, count(*)::INTEGER AS n FROM phase GROUP BY seq) SELECT s.seq AS source, min_index, max_index, n AS n_frames, '00000_phase' AS first, round(f.max_value, 6) AS last_max, '{SETTINGS}' AS settings FROM sequence_range s JOIN sizes USING (seq) JOIN frame_range f ON f.seq = s.seq AND f.idx = n - 1"),
    "frame_select_stride": (frame_select_stride, f"WITH {_PHASE} SELECT seq, ((idx - 1) // 3)::INTEGER AS idx, idx AS source_idx, printf('%05d_phase', idx) AS source_name FROM phase WHERE idx >= 1 AND (idx - 1) % 3 = 0 AND idx < 31"),
    "select_include_exclude": (select_include_exclude, f"WITH {_PHASE} SELECT seq, count(*) AS frames FROM phase WHERE seq IN ('1', '2', '5') GROUP BY seq"),
    "short_sequences": (short_sequences, "SELECT user_id::VARCHAR AS seq, count(*) AS taken FROM events GROUP BY user_id HAVING count(*) < 66"),
    "gap_check": (gap_check, "SELECT l_orderkey AS seq, min(l_linenumber) AS first, max(l_linenumber) AS last, count(*) AS n FROM lineitem WHERE l_quantity > 10 GROUP BY l_orderkey HAVING max(l_linenumber) - min(l_linenumber) + 1 <> count(*) OR min(l_linenumber) <> 1 OR count(*) <> count(DISTINCT l_linenumber)"),
    "nonfinite_guard": (nonfinite_guard, f"WITH {_PHASE} SELECT seq, printf('%05d_phase', idx) AS source_name FROM phase WHERE idx % 17 = 0 OR idx % 19 = 0"),
    "unit_conversion": (unit_conversion, f"WITH {_CELLS} SELECT seq, idx, round(sum(CASE idx % 3 WHEN 0 THEN v WHEN 1 THEN (v::DOUBLE / 2.0e-7)::FLOAT ELSE (v::DOUBLE * 1e-9 / 2.0e-7)::FLOAT END::DOUBLE), 4) + 0.0 AS total FROM cells GROUP BY ALL"),
    "contents_manifest": (contents_manifest, f"WITH {_PHASE} SELECT seq, count(*) AS n_source, string_agg(printf('%05d_phase', idx), ',' ORDER BY idx) AS frames FROM phase GROUP BY seq"),
    "coverage_counts": (coverage_counts, "SELECT count(*) AS found, count(*) FILTER (n_regionkey < 3) AS selected, count(*) FILTER (n_nationkey % 3 = 0) AS covered, count(*) FILTER (n_nationkey % 6 = 0) AS reused, string_agg(n_name, ',' ORDER BY n_nationkey) FILTER (n_regionkey < 3 AND n_nationkey % 3 <> 0) AS skipped, string_agg(n_name, ',' ORDER BY n_nationkey) FILTER (n_regionkey >= 3 AND n_nationkey % 3 <> 0) AS unselected FROM nation"),
    "unsourced_outputs": (unsourced_outputs, "SELECT c_custkey AS seq FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')"),
    "reuse_plan": (reuse_plan, f"WITH {_PHASE} SELECT DISTINCT seq, CASE WHEN seq IN ('3', '5', '7') THEN 'compute' ELSE 'reuse' END AS action FROM phase WHERE seq <> '9'"),
    "part_faults": (part_faults, f"WITH {_PHASE} SELECT DISTINCT seq AS source, CASE seq WHEN '1' THEN 'a bound is not finite' WHEN '2' THEN 'the bounds are inverted' WHEN '4' THEN 'a position is outside its frames' ELSE 'filed under another name' END AS fault FROM phase WHERE seq IN ('1', '2', '4', '6')"),
    "verdict_counts": (verdict_counts, "SELECT count(*) FILTER (o_orderstatus = 'F') AS computed, count(*) FILTER (o_orderstatus NOT IN ('F', 'P')) AS unchanged, count(*) FILTER (o_orderstatus = 'P') AS failed FROM orders"),
    "preprocess_document": (preprocess_document, f"WITH {_RANGES}, strided AS (SELECT seq, (idx // 2)::INTEGER AS idx, min_value, max_value FROM frame_range WHERE idx % 2 = 0 AND seq <> '0') SELECT seq AS source, min(min_value) AS min_value, max(max_value) AS max_value, arg_min(idx, (min_value, idx)) AS min_index, arg_min(idx, (-max_value, idx)) AS max_index, count(*)::INTEGER AS frames, (SELECT count(DISTINCT seq) FROM phase) AS found, (SELECT count(DISTINCT seq) - 1 FROM phase) AS selected, (SELECT count(DISTINCT seq) - 1 FROM phase) AS covered, '0' AS unselected FROM strided GROUP BY seq"),
    "range_tree_updates": (range_tree_updates, "WITH users AS (SELECT user_id::VARCHAR AS seq, min(value) AS min_value, max(value) AS max_value FROM events GROUP BY user_id), ranked AS (SELECT *, (row_number() OVER (ORDER BY seq) - 1)::INTEGER AS r FROM users) SELECT min(min_value) AS min_value, max(max_value) AS max_value, arg_min(r, (min_value, r)) AS min_index, arg_min(r, (-max_value, r)) AS max_index, count(*) AS parts FROM ranked"),
    "frame_files": (frame_files, f"WITH {_CELLS} SELECT seq, idx, printf('%05d_phase.npy', idx) AS source_name, 8 AS height, 8 AS width, 'm' AS unit, 0.15::DOUBLE AS pixel_size, round(sum(v::DOUBLE * 1e-9 / 2.0e-7), 4) + 0.0 AS total FROM cells GROUP BY seq, idx"),
    "flow_files": (flow_files, f"WITH {_FLOW} SELECT seq, idx, round(sum(dx), 4) + 0.0 AS dx, round(sum(dy), 4) + 0.0 AS dy FROM flow GROUP BY seq, idx"),
    "cached_or_computed": (cached_or_computed, _median_sql(1, 1, 0, False)),
    "median3d_tiled": (median3d_tiled, _median_sql(2, 2, 2, True)),
    "warp_tiled": (warp_tiled, _warp_sql("border")),
    "median_t_r2": (median_t_r2, f"WITH {_SIGNAL} SELECT seq, idx, round(median(value) OVER (PARTITION BY seq ORDER BY idx ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 6) + 0.0 AS value FROM signal"),
    "gauss_t": (gauss_t, f"WITH {_SIGNAL} SELECT a.seq, a.idx, round(sum(exp(-((b.idx - a.idx) * (b.idx - a.idx)) / 2.0) * b.value) / sum(exp(-((b.idx - a.idx) * (b.idx - a.idx)) / 2.0)), 6) + 0.0 AS value FROM signal a JOIN signal b ON b.seq = a.seq AND b.idx BETWEEN a.idx - 4 AND a.idx + 4 GROUP BY ALL"),
    "trim_spans": (trim_spans, f"WITH {_SIGNAL}, sized AS (SELECT *, count(*) OVER (PARTITION BY seq) AS n FROM signal) SELECT seq, idx, round(value, 6) + 0.0 AS value FROM sized WHERE idx >= 1 AND idx < n - 2"),
    "signal_difference": (signal_difference, f"WITH {_SIGNAL}, changes AS (SELECT seq, idx, round(value - lag(value) OVER (PARTITION BY seq ORDER BY idx), 6) + 0.0 AS change FROM signal) SELECT * FROM changes WHERE change IS NOT NULL"),
    "identity_filter": (_filtered(filters.Identity()), f"WITH {_CELLS} SELECT seq, idx, y::INTEGER AS y, x::INTEGER AS x, round(v::DOUBLE, 5) + 0.0 AS v FROM cells"),
    "median3d_ellipsoid_222": (_filtered(filters.Median((2, 2, 2), "ellipsoid")), _median_sql(2, 2, 2, True)),
    "median3d_cuboid_111": (_filtered(filters.Median((1, 1, 1), "cuboid")), _median_sql(1, 1, 1, False)),
    "median3d_cuboid_110": (_filtered(filters.Median((1, 1, 0), "cuboid")), _median_sql(1, 1, 0, False)),
    "median3d_relational_111": (median3d_relational, _median_sql(1, 1, 1, False)),
    "gauss3d": (lambda spark, d: _cells(filters.apply_filter(tables.phase_frames(spark, d), filters.Gaussian((0.5, 0.5, 0.5))), 4), _gauss_sql(0.5, 0.5, 0.5)),
    "normalize_perframe": (normalize_perframe, f"WITH {_CELLS}, r AS (SELECT seq, idx, min(v)::DOUBLE AS lo, max(v)::DOUBLE AS hi FROM cells GROUP BY ALL) " + _level_sql(_share("r.lo", "r.hi", 255.0), "JOIN r ON r.seq = c.seq AND r.idx = c.idx")),
    "normalize_pairwise": (normalize_pairwise, f"WITH {_CELLS}, r AS (SELECT seq, idx, min(v)::DOUBLE AS lo, max(v)::DOUBLE AS hi FROM cells GROUP BY ALL), p AS (SELECT a.seq, a.idx, least(a.lo, b.lo) AS lo, greatest(a.hi, b.hi) AS hi FROM r a JOIN r b ON b.seq = a.seq AND b.idx = a.idx + 1), after AS (SELECT seq, (idx - 1)::INTEGER AS idx, v FROM cells) " + _level_sql(_share("p.lo", "p.hi", 255.0), "JOIN p ON p.seq = c.seq AND p.idx = c.idx", "after")),
    "normalize_injected_dataset": (normalize_injected_dataset, f"WITH {_CELLS}, r AS (SELECT min(v)::DOUBLE AS lo, max(v)::DOUBLE AS hi FROM cells) " + _level_sql(_share("r.lo", "r.hi", 255.0), "CROSS JOIN r")),
    "normalize_injected_sequence": (normalize_injected_sequence, f"WITH {_CELLS}, r AS (SELECT seq, min(v)::DOUBLE AS lo, max(v)::DOUBLE AS hi FROM cells GROUP BY seq) " + _level_sql(_share("r.lo", "r.hi", 65535.0, -32768.0), "JOIN r ON r.seq = c.seq")),
    "normalize_clamped": (normalize_clamped, f"WITH {_CELLS} SELECT seq, idx, round(sum((least(greatest((v::DOUBLE + 1.0) / 2.0, 0.0), 1.0) * 10.0)::FLOAT::DOUBLE), 3) + 0.0 AS total FROM cells GROUP BY ALL"),
    "warp_border": (_warped("border"), _warp_sql("border")),
    "warp_zeros": (_warped("zeros"), _warp_sql("zeros")),
    "warp_reflection": (_warped("reflection"), _warp_sql("reflection")),
    "pair_scores": (pair_scores, f"WITH {_CELLS}, pairs AS (SELECT a.seq, a.idx, avg((b.v::DOUBLE - a.v::DOUBLE) ** 2) AS mse, avg(abs(b.v::DOUBLE - a.v::DOUBLE)) AS mae FROM cells a JOIN cells b ON b.seq = a.seq AND b.idx = a.idx + 1 AND b.y = a.y AND b.x = a.x GROUP BY ALL) SELECT seq, idx, round(mse, 6) AS mse, round(mae, 6) AS mae, round(10 * log10(64.0::DOUBLE / mse), 6) AS psnr FROM pairs"),
    "warp_consistency_mse": (warp_consistency_mse, f"WITH {_warp_cte('border')} SELECT seq, idx, round(avg((v::DOUBLE - before::DOUBLE) ** 2), 4) AS mse, round(avg(abs(v::DOUBLE - before::DOUBLE)), 4) AS mae FROM warped GROUP BY ALL"),
    "warp_consistency_mean": (warp_consistency_mean, f"WITH {_warp_cte('border')}, per AS (SELECT seq, idx, avg((v::DOUBLE - before::DOUBLE) ** 2) AS mse, avg(abs(v::DOUBLE - before::DOUBLE)) AS mae FROM warped GROUP BY ALL) SELECT seq, round(avg(mse), 4) AS mse, round(avg(mae), 4) AS mae FROM per GROUP BY seq"),
    "strict_zip": (strict_zip, f"WITH {_CELLS}, smooth AS ({_median_sql(1, 1, 0, False)[len('WITH ' + _CELLS) + 2:].replace('offsets AS', 'WITH offsets AS', 1).replace('round(median(q.v)::DOUBLE, 5) + 0.0', 'median(q.v)')}) SELECT c.seq, c.idx, round(avg(abs(s.v::DOUBLE - c.v::DOUBLE)), 5) AS mae FROM cells c JOIN smooth s ON s.seq = c.seq AND s.idx = c.idx AND s.y = c.y AND s.x = c.x GROUP BY ALL"),
    "length_faults": (length_faults, "SELECT o_custkey AS seq, count(*) FILTER (o_orderstatus = 'F') AS \"left\", count(*) FILTER (o_orderstatus = 'O') AS \"right\" FROM orders WHERE o_orderstatus IN ('F', 'O') GROUP BY o_custkey HAVING count(*) FILTER (o_orderstatus = 'F') <> count(*) FILTER (o_orderstatus = 'O')"),
    "stream_flow_push": (stream_flow_push, None),
    "ssim": (ssim, _ssim_sql()),
    "flow_farneback": (_estimated("farneback"), None),
    "flow_tvl1": (_estimated("dual_tvl1"), None),
    "drymass_signal": (_field("dry_mass"), _FIELD_SQL["drymass_signal"]),
    "opd_variance": (_field("path_change"), _FIELD_SQL["opd_variance"]),
    "velocity": (_field("velocity"), _FIELD_SQL["velocity"]),
    "acceleration": (_field("acceleration"), _FIELD_SQL["acceleration"]),
    "force": (_field("force"), _FIELD_SQL["force"]),
    "kinetic_energy": (_field("kinetic_energy"), _FIELD_SQL["kinetic_energy"]),
    "fields_aligned": (_field("dry_mass", "acceleration"), _FIELD_SQL["fields_aligned"]),
    "field_means": (field_means, _FIELD_SQL["field_means"]),
    "displacement3d": (_field("displacement", three=True), _displacement3d_sql()),
    "stream_push_diff": (stream_push_diff, f"WITH {_CELLS} SELECT a.seq, a.idx, round(sum((b.v - a.v)::DOUBLE), 4) + 0.0 AS change FROM cells a JOIN cells b ON b.seq = a.seq AND b.idx = a.idx + 1 AND b.y = a.y AND b.x = a.x GROUP BY ALL"),
}


def queries() -> dict[str, Query]:
    return {name: query for name, (query, _) in CATALOG.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in CATALOG.items() if sql}
