"""Nearest neighbours of vectors: inverted lists scanned a few dimensions at a time.

Equal vectors are one class, which keeps the least ids that any answer can hold, so that a vector a third of all
rows share is searched, and found, once. Centroids are fitted by k-means on a bounded sample of classes; every class
goes to the list of its nearest centroid. Lists are cut into blocks of bounded rows, whose vectors are rotated
at random and stored in blocks of columns. A query scans the list of its nearest centroid first, which gives
it a limit, and then the lists that follow. Within a block, distances grow by one column block at a time; after each,
a candidate is left out if its partial distance, by a test on what is to be expected of a rotated
vector, says that the whole distance exceeds the limit. What is left is measured in double precision on the original vectors.

How many lists are probed is measured: a brute-force pass over all rows for some audited queries tells in which of their
lists the true neighbours lie, and after the search the same queries tell the recall. A run under ``WANTED`` is repeated
with twice the lists; one under ``LEAST_RECALL`` with all lists scanned fails.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components take no part, nor do rows without
vec_id; rows that repeat vec_id and vector are one; several vectors under one vec_id are queries and candidates of
their own, and the query's own row alone is no candidate; ties go to the smaller vec_id; vectors of different lengths are never compared; distances that
overflow or vanish in double precision are measured on scaled differences; other columns, labels too, are ignored, whatever their
names; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strobelake.llm.common import materialize, new_path, release, table

#: Values of the sample that centroids are fitted on, vectors of it for each list at least, rounds of k-means.
SAMPLE_VALUES, EACH_LIST, ROUNDS = 1 << 22, 48, 8
#: Rows of a stored block, queries scanned together, dimensions of a column block.
BLOCK_ROWS, TOGETHER, COLUMNS = 4096, 256, 16
#: How many standard errors a partial distance must lie beyond the limit before a candidate is left out.
SURE = 3.0
#: Queries audited, the share of their neighbours that the probed lists must hold, the recall aimed at and the least.
AUDITED, HELD, WANTED, LEAST_RECALL = 64, 0.99, 0.95, 0.9


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of rows of a and b in double precision."""
    difference = a.astype(np.float64) - b.astype(np.float64)
    with np.errstate(over="ignore", invalid="ignore", under="ignore"):
        out = np.sqrt(np.einsum("kd,kd->k", difference, difference))
        odd = ~((out > 1e-140) & (out < 1e140))
        if odd.any():
            some = a[odd].astype(np.float64) / 4 - b[odd].astype(np.float64) / 4
            top = np.abs(some).max(axis=1, keepdims=True)
            out[odd] = 4 * (top[:, 0] * np.sqrt(np.square(some / np.where(top > 0, top, 1)).sum(axis=1)))
    return out


@lru_cache(maxsize=4)
def rotation(dim: int) -> np.ndarray:
    """A random orthogonal matrix, the same in every task."""
    q, r = np.linalg.qr(np.random.default_rng(dim).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def column_blocks(v: np.ndarray, scale: float) -> list[np.ndarray]:
    """Rotated vectors of about unit size, cut into blocks of columns."""
    turned = (v * scale) @ rotation(v.shape[1]).astype(v.dtype)
    return [np.ascontiguousarray(turned[:, at : at + COLUMNS]) for at in range(0, v.shape[1], COLUMNS)]


def centroids(sample: np.ndarray, lists: int) -> np.ndarray:
    """k-means from distinct rows spread over the sample."""
    found = sample[np.linspace(0, len(sample) - 1, lists).astype(int)].copy()
    for _ in range(ROUNDS):
        nearest = ranked_lists(sample, found, 1)[:, 0]
        count = np.bincount(nearest, minlength=lists)
        sums = np.zeros_like(found)
        np.add.at(sums, nearest, sample)
        found = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], found)
    return found


def ranked_lists(v: np.ndarray, means: np.ndarray, most: int) -> np.ndarray:
    """The ``most`` lists nearest to each row, nearest first."""
    out = np.empty((len(v), most), dtype=np.int64)
    half, step = 0.5 * np.square(means).sum(axis=1), max(1, (1 << 22) // max(1, len(means)))
    for at in range(0, len(v), step):
        far = half - v[at : at + step] @ means.T
        out[at : at + step] = far.argmin(axis=1)[:, None] if most == 1 else np.argsort(far, axis=1, kind="stable")[:, :most]
    return out


def survivors(queries: list[np.ndarray], block: list[np.ndarray], limit: np.ndarray, nearest: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (row of the queries, row of the block) that may be among the ``nearest`` and within the limit (a squared distance)."""
    dim, done, partial = sum(b.shape[1] for b in block), 0, 0
    own, other = [np.square(q).sum(axis=1) for q in queries], [np.square(b).sum(axis=1) for b in block]
    margin = 1e-5 * (sum(own)[:, None] + sum(other).max()) if block[0].dtype == np.float32 else 1e-12 * (sum(own)[:, None] + sum(other).max())

    def bar(rows: np.ndarray | slice) -> np.ndarray:
        return limit[rows] * (done / dim) * ((1 + SURE / np.sqrt(done)) ** 2 if done < dim else 1)

    for k, (q, x) in enumerate(zip(queries, block)):
        partial = partial + own[k][:, None] + other[k] - 2 * (q @ x.T)
        done += x.shape[1]
        if done == dim:
            if len(other[0]) > nearest:
                limit = np.minimum(limit, np.partition(partial, nearest - 1, axis=1)[:, nearest - 1] + margin[:, 0])
            return np.nonzero(partial <= limit[:, None] + margin)
        alive = partial <= bar(slice(None))[:, None] + margin
        if alive.sum() * 4 < alive.size:
            break
    a, b = np.nonzero(alive)
    left = partial[a, b]
    for q, x in zip(queries[k + 1 :], block[k + 1 :]):
        done += x.shape[1]
        left = left + np.square(q[a] - x[b]).sum(axis=1)
        keep = left <= bar(a) + margin[a, 0]
        a, b, left = a[keep], b[keep], left[keep]
    return a, b


class Best:
    """The nearest found so far of each query: (distance, vec_id, class)."""

    def __init__(self, queries: int, most: int, limit: np.ndarray):
        self.most, self.limit = most, limit
        self.owner, self.score = np.zeros(0, dtype=np.int64), np.zeros(0)
        self.ids, self.reps = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        self.queries = queries

    def add(self, owner: np.ndarray, score: np.ndarray, ids: np.ndarray, reps: np.ndarray) -> None:
        owner, score = np.concatenate([self.owner, owner]), np.concatenate([self.score, score])
        ids, reps = np.concatenate([self.ids, ids]), np.concatenate([self.reps, reps])
        order = np.lexsort((reps, ids, score, owner))
        owner = owner[order]
        kept = order[np.arange(len(owner)) - np.searchsorted(owner, owner) < self.most]
        self.score, self.ids, self.reps = score[kept], ids[kept], reps[kept]
        self.owner = np.sort(owner)[np.arange(len(owner)) - np.searchsorted(owner, owner) < self.most]
        full = np.flatnonzero(np.bincount(self.owner, minlength=self.queries) == self.most)
        last = np.searchsorted(self.owner, full, side="right") - 1
        self.limit[full] = np.minimum(self.limit[full], self.score[last])


_BLOCK = pa.schema([("list", pa.int32()), ("dim", pa.int32()), ("reps", pa.binary()), ("many", pa.binary()), ("ids", pa.binary()), ("vectors", pa.binary()), ("columns", pa.list_(pa.binary()))])
_FOUND = "rep long, score double, vec_id long, other long"


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dim)


def _by_length(batch: pa.RecordBatch, at: str) -> Iterator[tuple[int, pa.RecordBatch]]:
    dims = batch.column(batch.schema.get_field_index(at)).to_numpy()
    for d in np.unique(dims).tolist():
        yield d, batch.take(pa.array(np.flatnonzero(dims == d)))


def vector_classes(embeddings: DataFrame, asked: Column, most: int) -> tuple[DataFrame, DataFrame]:
    """(rows that take part: vec_id, k1, k2, asked; classes, written: rep, k1, k2, dim, v, asked, and up to ``most`` least ids)."""
    kind = embeddings.schema["embedding"].dataType
    kind = "float" if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.FloatType) else "double"
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(f"array<{kind}>").alias("v")).where("vec_id is not null")
    limit = F.lit(1.7976931348623157e308)
    fine = F.coalesce(F.forall("v", lambda x: F.coalesce((x.cast("double") >= -limit) & (x.cast("double") <= limit), F.lit(False))) & F.exists("v", lambda x: x != 0), F.lit(False))
    fit = rows.where(fine).select("vec_id", F.transform("v", lambda x: x + F.lit(0.0).cast(kind)).alias("v"))  # one zero
    fit = fit.select("vec_id", F.xxhash64("v").alias("k1"), F.xxhash64(F.lit(7), "v").alias("k2"), "v", asked.alias("asked"))
    vectors = fit.groupBy("k1", "k2").agg(F.first("v").alias("v"), F.max("asked").alias("asked"))
    order = F.row_number().over(Window.partitionBy("k1", "k2").orderBy("vec_id"))
    least = fit.select("k1", "k2", "vec_id").distinct().withColumn("turn", order).where(F.col("turn") <= most)
    ids = least.groupBy(F.col("k1").alias("i1"), F.col("k2").alias("i2")).agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    both = vectors.join(ids, (F.col("k1") == F.col("i1")) & (F.col("k2") == F.col("i2")))
    classes = both.select(F.monotonically_increasing_id().alias("rep"), "k1", "k2", F.size("v").alias("dim"), "v", "asked", "ids")
    return fit.select("vec_id", "k1", "k2", "asked"), materialize(classes, "vector-classes")


class Index:
    """Lists and blocks over the classes of ``vector_classes``; ``means`` holds centroids by length, ``first`` the number of each length's first list."""

    def __init__(self, classes: DataFrame):
        self.spark = classes.sparkSession
        self.dtype = np.dtype("f4") if classes.schema["v"].dataType.elementType == T.FloatType() else np.dtype("f8")
        lengths = classes.groupBy("dim").agg(F.count("*").alias("n"), F.max(F.array_max(F.transform("v", F.abs))).cast("double").alias("top")).orderBy("dim").collect()  # a row a length
        self.counts = {r["dim"]: r["n"] for r in lengths}
        self.scale = {r["dim"]: float(np.ldexp(1.0, -max(-1000, min(1000, int(np.frexp(r["top"])[1]))))) for r in lengths}
        self.means, self.first, start = self._fit(classes), {}, 0
        for dim in sorted(self.means):
            self.first[dim] = start
            start += len(self.means[dim])
        self.lists = start
        self.placed = materialize(self._place(classes), "vector-lists")
        self.path = new_path(self.spark, "vector-blocks")
        self._store()

    def _fit(self, classes: DataFrame) -> dict[int, np.ndarray]:
        wanted = {d: max(1, round(n**0.5)) for d, n in self.counts.items()}
        values = sum(min(n, EACH_LIST * wanted[d]) * d for d, n in self.counts.items())
        share = min(1.0, SAMPLE_VALUES / max(1, values))
        shares = F.coalesce(*[F.when(F.col("dim") == d, F.lit(min(1.0, share * EACH_LIST * wanted[d] / n))) for d, n in self.counts.items()], F.lit(0.0)) if self.counts else F.lit(0.0)
        drawn = classes.where(F.pmod(F.xxhash64(F.lit(11), "k1", "k2"), F.lit(1 << 30)) < shares * (1 << 30)).select("dim", "v").toArrow()  # a bounded sample
        out = {}
        for batch in drawn.combine_chunks().to_batches():
            for d, some in _by_length(batch, "dim"):
                out.setdefault(d, []).append(_matrix(some.column(1), d))
        fitted = {}
        for d in self.counts:
            sample = np.concatenate(out.get(d) or [np.zeros((1, d))]).astype(self.dtype) * self.dtype.type(self.scale[d])
            sample = sample[np.lexsort(sample.T[:4])]
            lists = max(1, min(wanted[d], len(sample) // 8))
            shuffled = sample[np.random.default_rng(5).permutation(len(sample))]
            fitted[d] = centroids(shuffled, lists)
        return fitted

    def _place(self, classes: DataFrame) -> DataFrame:
        means, first, scale, dtype = self.means, self.first, self.scale, self.dtype

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for d, some in _by_length(batch, "dim"):
                    v = _matrix(some.column(2), d) * dtype.type(scale[d])
                    at = first[d] + ranked_lists(v, means[d], 1)[:, 0]
                    yield pa.RecordBatch.from_arrays([*some.columns, pa.array(at.astype(np.int32))], names=[*some.schema.names, "list"])
            release()

        kind = classes.schema["v"].dataType.simpleString()
        return classes.select("rep", "dim", "v", "ids", "asked").mapInArrow(run, f"rep long, dim int, v {kind}, ids array<long>, asked boolean, list int")

    def _store(self) -> None:
        """Blocks of at most about ``BLOCK_ROWS`` classes of one list, as rows of files by list."""
        scale, dtype = self.scale, self.dtype
        size = self.placed.groupBy("list").agg(F.ceil(F.count("*") / BLOCK_ROWS).alias("blocks"))
        total = size.agg(F.sum("blocks")).first()[0] or 0
        cut = self.placed.join(F.broadcast(size.withColumnRenamed("list", "_l")), F.col("list") == F.col("_l"))  # a row a list, as many as the sample allows
        cut = cut.select("list", F.pmod(F.xxhash64("rep"), "blocks").alias("block"), "dim", "rep", "v", "ids")

        def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held, key = [], None

            def row() -> pa.RecordBatch:
                t = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                dim = t.column(2)[0].as_py()
                v, ids = _matrix(t.column(4), dim).astype(dtype), t.column(5)
                blocks = column_blocks(v, dtype.type(scale[dim]))
                many = np.diff(ids.offsets.to_numpy()).astype(np.int64)
                found = {"list": key[0], "dim": dim, "reps": t.column(3).to_numpy().tobytes(), "many": many.tobytes(), "ids": ids.flatten().to_numpy().astype(np.int64).tobytes(), "vectors": v.tobytes(), "columns": [b.tobytes() for b in blocks]}
                return pa.RecordBatch.from_pylist([found], schema=_BLOCK)

            for batch in batches:
                keys = np.stack([batch.column(0).to_numpy(), batch.column(1).to_numpy()], axis=1)
                cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)] if len(keys) else []
                for a, b in zip(cuts, cuts[1:]):
                    now = tuple(keys[a].tolist())
                    if held and now != key:
                        yield row()
                        held = []
                    key = now
                    held.append(batch.slice(a, b - a))
            if held:
                yield row()
            release()

        parts = max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), -(-total // 16))
        stored = cut.repartition(parts, "list", "block").sortWithinPartitions("list", "block").mapInArrow(pack, "list int, dim int, reps binary, many binary, ids binary, vectors binary, columns array<binary>")
        stored.write.partitionBy("list").option("parquet.block.size", 8 << 20).parquet(self.path)

    def probes(self, classes: DataFrame, low: dict[int, int], high: dict[int, int]) -> DataFrame:
        """(list, dim, rep, v) for the lists numbered ``low`` to ``high`` - 1, by nearness, of each class that is asked."""
        means, first, scale, dtype = self.means, self.first, self.scale, self.dtype

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for d, some in _by_length(batch, "dim"):
                    a, b = low[d], high[d]
                    if a >= b:
                        continue
                    for at in range(0, some.num_rows, 256):
                        part = some.slice(at, 256)
                        near = ranked_lists(_matrix(part.column(2), d) * dtype.type(scale[d]), means[d], b)[:, a:]
                        rows = part.take(pa.array(np.repeat(np.arange(part.num_rows), b - a)))
                        yield pa.RecordBatch.from_arrays([pa.array((first[d] + near.ravel()).astype(np.int32)), *rows.columns], names=["list", *rows.schema.names])

        kind = classes.schema["v"].dataType.simpleString()
        return classes.where("asked").select("rep", "dim", "v").mapInArrow(run, f"list int, rep long, dim int, v {kind}")

    def scan(self, probes: DataFrame, most: int, limits: DataFrame | None = None) -> DataFrame:
        """The nearest found in each probed list, written: up to ``most`` (rep, score, vec_id, other) for each query and list."""
        path, scale, dtype = self.path, self.scale, self.dtype
        if limits is not None:
            probes = probes.join(limits.select(F.col("rep").alias("_rep"), "far"), F.col("rep") == F.col("_rep"), "left").drop("_rep")
        else:
            probes = probes.withColumn("far", F.lit(None).cast("double"))

        def searched(number: int, rows: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            fs, root = pyarrow.fs.FileSystem.from_uri(path)
            files = fs.get_file_info(pyarrow.fs.FileSelector(f"{root}/list={number}", allow_not_found=True))
            t = pa.Table.from_batches(rows).combine_chunks().to_batches()[0]
            dim = t.column(2)[0].as_py()
            own = dtype.type(scale[dim])
            q = _matrix(t.column(3), dim).astype(dtype)
            turned = column_blocks(q, own)
            far = t.column(4).to_numpy(zero_copy_only=False).astype(np.float64)
            best = Best(len(q), most, np.where(np.isnan(far), np.inf, far))
            for info in sorted(files, key=lambda i: i.path):
                if not info.base_name.endswith(".parquet"):
                    continue
                with fs.open_input_file(info.path) as file:
                    for batch in pyarrow.parquet.ParquetFile(file).iter_batches(1, columns=["reps", "many", "ids", "vectors", "columns"]):
                        row = batch.to_pylist()[0]
                        reps, many, ids = (np.frombuffer(row[c], np.int64) for c in ("reps", "many", "ids"))
                        n = len(reps)
                        blocks = [np.frombuffer(b, dtype).reshape(n, -1) for b in row["columns"]]
                        with np.errstate(over="ignore"):
                            limit = np.square(best.limit * float(own))
                        a, b = survivors(turned, blocks, limit, most)
                        score = distances(q[a], np.frombuffer(row["vectors"], dtype).reshape(n, dim)[b])
                        start = np.cumsum(many) - many
                        count = many[b]
                        spread = np.repeat(start[b] - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
                        best.add(np.repeat(a, count), np.repeat(score, count), ids[spread], np.repeat(reps[b], count))
            reps = t.column(1).to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(reps[best.owner]), pa.array(best.score), pa.array(best.ids), pa.array(best.reps)], names=["rep", "score", "vec_id", "other"])

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held, number, n = [], None, 0
            for batch in batches:
                lists = batch.column(0).to_numpy()
                cuts = [0, *(np.flatnonzero(lists[1:] != lists[:-1]) + 1).tolist(), len(lists)] if len(lists) else []
                for a, b in zip(cuts, cuts[1:]):
                    for low in range(a, b, TOGETHER):
                        high = min(b, low + TOGETHER)
                        if held and (lists[low] != number or n + high - low > TOGETHER):
                            yield from searched(number, held)
                            held, n = [], 0
                        number = int(lists[low])
                        held.append(batch.slice(low, high - low))
                        n += high - low
            if held:
                yield from searched(number, held)
            release()

        dealt = probes.select("list", "rep", "dim", "v", "far").repartitionByRange("list", "rep").sortWithinPartitions("list", "rep")
        return materialize(dealt.mapInArrow(run, _FOUND), "vectors-found")

    def audit(self, queries: pa.Table, most: int) -> dict[int, list[tuple[float, int]]]:
        """By brute force over all rows, the (distance, list) of the nearest classes of each query, itself included."""
        asked = {d: (some.column(0).to_numpy(), _matrix(some.column(2), d)) for batch in queries.combine_chunks().to_batches() for d, some in _by_length(batch, "dim")}

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best = {d: Best(len(q[0]), most, np.full(len(q[0]), np.inf)) for d, q in asked.items()}
            for batch in batches:
                for d, some in _by_length(batch, "dim"):
                    if d not in asked:
                        continue
                    v, lists = _matrix(some.column(2), d), some.column(3).to_numpy().astype(np.int64)
                    q = asked[d][1]
                    for k in range(len(q)):
                        far = distances(np.broadcast_to(q[k], v.shape), v)
                        near = np.flatnonzero(far <= best[d].limit[k])
                        best[d].add(np.full(len(near), k), far[near], lists[near], lists[near])
            for d, b in best.items():
                yield pa.RecordBatch.from_arrays([pa.array(asked[d][0][b.owner]), pa.array(b.score), pa.array(b.ids)], names=["rep", "score", "list"])
            release()

        found = self.placed.select("rep", "dim", "v", "list").mapInArrow(run, "rep long, score double, list long")
        order = F.row_number().over(Window.partitionBy("rep").orderBy("score", "list"))
        out: dict[int, list[tuple[float, int]]] = {}
        for r in found.withColumn("turn", order).where(F.col("turn") <= most).orderBy("rep", "turn").collect():  # of the audited queries alone
            out.setdefault(r["rep"], []).append((r["score"], r["list"]))
        return out


def _recall(truth: dict[int, list[tuple[float, int]]], found: DataFrame) -> float:
    """Of the true neighbours of the audited queries, the share whose distance a found one reaches."""
    if not truth:
        return 1.0
    got: dict[int, list[float]] = {}
    for r in found.where(F.col("rep").isin(list(truth))).select("rep", "score").collect():  # of the audited queries alone
        got.setdefault(r["rep"], []).append(r["score"])
    hits = sum(min(len(near), sum(s <= near[-1][0] for s in got.get(rep, []))) for rep, near in truth.items())
    return hits / sum(map(len, truth.values()))


def nearest(embeddings: DataFrame, asked: Column, k: int = 10) -> DataFrame:
    """(query_id, rank, vec_id, score) of the ``k`` nearest rows of each row for which ``asked``, a condition on vec_id, holds."""
    rows, classes = vector_classes(embeddings, asked, k + 1)
    index, most = Index(classes), k + 1
    sample = classes.where("asked").orderBy(F.xxhash64(F.lit(3), "k1", "k2")).limit(AUDITED).select("rep", "dim", "v").toArrow()
    truth = index.audit(sample, most)
    places = []
    for batch in sample.combine_chunks().to_batches():
        for d, some in _by_length(batch, "dim"):
            order = ranked_lists(_matrix(some.column(2), d) * index.dtype.type(index.scale[d]), index.means[d], len(index.means[d]))
            for rep, own in zip(some.column(0).to_pylist(), order):
                place = np.argsort(own)
                places += [(place[number - index.first[d]] + 1) / len(own) for _, number in truth[rep]]
    share = float(np.quantile(places, HELD)) if places else 1.0
    none, one = dict.fromkeys(index.means, 0), dict.fromkeys(index.means, 1)
    own = index.scan(index.probes(classes, none, one), most)
    limits = own.groupBy("rep").agg(F.when(F.count("*") == most, F.max("score")).alias("far"))
    while True:
        probed = {d: max(1, min(len(m), int(np.ceil(share * len(m))))) for d, m in index.means.items()}
        found = own.unionByName(index.scan(index.probes(classes, one, probed), most, limits))
        order = F.row_number().over(Window.partitionBy("rep").orderBy("score", "vec_id", "other"))
        found = materialize(found.withColumn("turn", order).where(F.col("turn") <= most), "vectors-nearest")
        recall = _recall(truth, found)
        if recall >= WANTED or share >= 1:
            break
        share = min(1.0, 2 * share)
    if recall < LEAST_RECALL:
        raise RuntimeError(f"only {recall:.3f} of the audited neighbours were found")
    answers = found.groupBy("rep").agg(F.sort_array(F.collect_list(F.struct("score", "vec_id", "other"))).alias("near"))
    named = classes.where("asked").select("k1", "k2", "rep").join(answers, "rep")
    queries = rows.where("asked").select("vec_id", "k1", "k2").distinct().withColumnRenamed("vec_id", "query_id")
    met = queries.join(named, ["k1", "k2"])
    others = F.filter("near", lambda e: ~((e["vec_id"] == F.col("query_id")) & (e["other"] == F.col("rep"))))
    listed = met.select("query_id", F.posexplode(F.slice(others, 1, k)).alias("at", "e"))
    return listed.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), "e.vec_id", "e.score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


SQL = """
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
fit AS (SELECT * FROM v WHERE list_dot_product(e, e) > 0),
pairs AS (SELECT q.vec_id AS query_id, c.vec_id, list_distance(q.e, c.e) AS score FROM fit q JOIN fit c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id)::INTEGER AS rank FROM pairs)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
"""
