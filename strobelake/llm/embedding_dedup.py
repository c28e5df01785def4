"""Near-duplicate embeddings: a hierarchical navigable small-world graph for each shard, every shard queried.

Equal vectors are one class with a multiplicity, named by a 128-bit digest. Classes are
dealt to shards of bounded bytes, and each shard is one file with its vectors and its
graph. A task loads one graph and streams the vectors of other shards past it, so that
nothing but a list of shards is shuffled. The beam of a block of vectors is widened until
two audits pass (links of some of its vectors against brute force, and vectors planted at
the least cosine from nodes of the shard, which must be found); a vector whose beam stays
full of near ones, and a block whose audits never pass, are compared with the whole shard
in bands. Links are confirmed by cosine in double precision and folded into counts
and a forest as they are found, so neither memory nor output grows with the number of pairs.
The audited vectors are compared with brute force once more at the end, and a run
whose recall is under ``LEAST_RECALL`` fails.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components
link with nothing and keep their row; all others are scaled by a power of two, so that
none is too long or too short; vectors of different lengths never link; equal
vectors link, also under one repeated vec_id (each row counts, whatever vectors it has);
ties at the least cosine link; a null vec_id is
ignored as a link target's name but its row is kept; other columns, labels too,
are ignored, whatever their names; very long vectors make smaller shards; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strobelake.llm.common import connected_components, materialize, new_path, release, table

#: Links of a node on upper layers and on the lowest, and the beam that looks for them.
LINKS, LOW_LINKS, BUILD_BEAM = 12, 24, 64
#: Vectors and bytes of a shard at most, shards of a large enough table at least, vectors of a block, shards that a task queries with at most.
SHARD_ROWS, SHARD_BYTES, LEAST_SHARDS, BLOCK_ROWS, CHUNK = 32_768, 32 << 20, 8, 8_192, 64
#: Rows searched together, candidates expanded in a step, vectors audited in a block, and planted in a shard.
TOGETHER, EXPAND, AUDITED, PLANTED = 512, 4, 48, 64
#: Shares of audited links and of planted vectors to be found; a beam is widened while its worst cosine is not this far under the least.
LINK_RECALL, PLANT_RECALL, SLACK = 0.99, 0.98, 0.05
#: How often a beam is doubled before the whole shard is compared, cosines of a band of that, and the recall that a run must reach.
DOUBLINGS, BAND, LEAST_RECALL = 3, 1_000_000, 0.9


class Graph:
    """The graph over unit vectors x, whose rows are ordered from high layers to low, so that each layer is a prefix."""

    def __init__(self, x: np.ndarray, sizes: list[int], layers: list[np.ndarray]):
        self.x, self.sizes, self.layers = x, sizes, layers

    @classmethod
    def build(cls, x: np.ndarray, levels: np.ndarray) -> Graph:
        """Insert rows in batches that double, each batch seeing what stands and itself."""
        n = len(x)
        sizes = [int((levels >= k).sum()) for k in range(int(levels.max(initial=0)) + 1)]
        graph = cls(x.astype(np.float32), sizes, [np.full((s, LOW_LINKS if k == 0 else LINKS), -1, dtype=np.int32) for k, s in enumerate(sizes)])
        low = 0
        while low < n:
            high = min(n, low + max(1, min(low, TOGETHER)))
            graph._insert(low, high)
            low = high
        return graph

    def _insert(self, low: int, high: int) -> None:
        q = self.x[low:high]
        entry = np.zeros((high - low, 1), dtype=np.int64)
        for layer in range(len(self.sizes) - 1, -1, -1):
            limit, own = min(low, self.sizes[layer]), min(high, self.sizes[layer]) - low
            ids = np.full((high - low, 1), -1)
            if limit:
                ids, sims = self.search(q, layer, entry, BUILD_BEAM if own > 0 else 8, limit)
                entry = np.where(ids[:, :8] >= 0, ids[:, :8], ids[:, :1])
            if own > 0:
                peers = q[:own] @ q[:own].T
                np.fill_diagonal(peers, -np.inf)
                k = min(own - 1, BUILD_BEAM)
                near = np.argsort(-peers, axis=1, kind="stable")[:, :k]
                ids = np.hstack([ids[:own], near + low])
                sims = np.hstack([sims[:own] if limit else np.full((own, 1), -np.inf, dtype=np.float32), np.take_along_axis(peers, near, axis=1)])
                best = np.argsort(-sims, axis=1, kind="stable")[:, :BUILD_BEAM]
                self._link(layer, np.arange(low, low + own), np.take_along_axis(ids, best, axis=1), np.take_along_axis(sims, best, axis=1))

    def _choose(self, ids: np.ndarray, sims: np.ndarray, most: int) -> np.ndarray:
        """The links kept of each row's candidates (best first): first those nearer to the row than to a link already kept, then the nearest others."""
        rows, width = ids.shape
        v = self.x[np.maximum(ids, 0)]
        between = v @ v.transpose(0, 2, 1)
        kept = np.zeros((rows, width), dtype=bool)
        closest = np.full((rows, width), -np.inf, dtype=np.float32)
        for j in range(width):
            ok = (ids[:, j] >= 0) & (closest[:, j] < sims[:, j]) & (kept.sum(axis=1) < most)
            kept[:, j] = ok
            closest = np.maximum(closest, np.where(ok[:, None], between[:, :, j], -np.inf))
        order = np.argsort(np.where(kept, 0, np.where(ids >= 0, 1, 2)), axis=1, kind="stable")[:, :most]
        out = np.take_along_axis(ids, order, axis=1)
        return np.pad(out, ((0, 0), (0, most - out.shape[1])), constant_values=-1)

    def _link(self, layer: int, rows: np.ndarray, ids: np.ndarray, sims: np.ndarray) -> None:
        adjacent = self.layers[layer]
        most = adjacent.shape[1]
        chosen = self._choose(np.where(np.isfinite(sims), ids, -1), sims, most)
        adjacent[rows] = chosen
        at, slot = np.nonzero(chosen >= 0)
        to, new = chosen[at, slot], rows[at]
        order = np.lexsort((new, to))
        to, new = to[order], new[order]
        place = np.arange(len(to)) - np.searchsorted(to, to)
        for turn in range(0, int(place.max(initial=-1)) + 1, 16):  # backward links, so many at a time for each node
            here = (place >= turn) & (place < turn + 16)
            nodes, row = np.unique(to[here], return_inverse=True)
            more = np.full((len(nodes), 16), -1, dtype=np.int64)
            more[row, place[here] - turn] = new[here]
            both = np.hstack([adjacent[nodes], np.where((more[:, :, None] == adjacent[nodes][:, None, :]).any(axis=2), -1, more)])
            s = np.where(both >= 0, np.einsum("nkd,nd->nk", self.x[np.maximum(both, 0)], self.x[nodes]), -np.inf)
            best = np.argsort(-s, axis=1, kind="stable")
            both, s = np.take_along_axis(both, best, axis=1), np.take_along_axis(s, best, axis=1)
            full = (both >= 0).sum(axis=1) > most
            kept = both[:, :most].copy()
            if full.any():
                kept[full] = self._choose(both[full], s[full], most)
            adjacent[nodes] = kept

    def search(self, q: np.ndarray, layer: int, entry: np.ndarray, beam: int, limit: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, similarities) of the ``beam`` nearest nodes found for each row of q, best first; -1 where there are none."""
        rows, adjacent = len(q), self.layers[layer]
        beam = min(beam, limit)
        stamp = np.full(rows * limit, -1, dtype=np.int32)
        ids = np.full((rows, beam), -1, dtype=np.int64)
        sims = np.full((rows, beam), -np.inf, dtype=np.float32)
        done = np.ones((rows, beam), dtype=bool)
        active = np.arange(rows)
        r, c = np.repeat(active, entry.shape[1]), entry.ravel()
        while True:
            keep = (c >= 0) & (c < limit)
            r, c = r[keep], c[keep]
            key = r * limit + c
            keep = stamp[key] < 0
            r, c, key = r[keep], c[keep], key[keep]
            turn = np.arange(len(key), dtype=np.int32)
            stamp[key] = turn
            keep = stamp[key] == turn
            r, c = r[keep], c[keep]
            if len(r):
                s = np.einsum("kd,kd->k", q[r], self.x[c])
                touched, row = np.unique(r, return_inverse=True)
                place = np.arange(len(r)) - np.searchsorted(r, r)
                width = int(place.max()) + 1
                new_ids = np.full((len(touched), width), -1, dtype=np.int64)
                new_sims = np.full((len(touched), width), -np.inf, dtype=np.float32)
                new_ids[row, place], new_sims[row, place] = c, s
                all_ids, all_sims = np.hstack([ids[touched], new_ids]), np.hstack([sims[touched], new_sims])
                all_done = np.hstack([done[touched], new_ids < 0])
                best = np.argsort(-all_sims, axis=1, kind="stable")[:, :beam]
                ids[touched] = np.take_along_axis(all_ids, best, axis=1)
                sims[touched] = np.take_along_axis(all_sims, best, axis=1)
                done[touched] = np.take_along_axis(all_done, best, axis=1)
            pending = ~done[active]
            active = active[pending.any(axis=1)]
            if not len(active):
                return ids, sims
            pending = ~done[active]
            pick = pending & (np.cumsum(pending, axis=1) <= EXPAND)
            a, slot = np.nonzero(pick)
            r = active[a]
            node = ids[r, slot]
            done[r, slot] = True
            near = adjacent[node]
            r, c = np.repeat(r, near.shape[1]), near.ravel().astype(np.int64)

    def nearest(self, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """Descend from the top layer, then search the lowest."""
        entry = np.zeros((len(q), 1), dtype=np.int64)
        for layer in range(len(self.sizes) - 1, 0, -1):
            ids, _ = self.search(q, layer, entry, 8, self.sizes[layer])
            entry = ids[:, :4]
        return self.search(q, 0, entry, beam, self.sizes[0])


def scaled(v: np.ndarray) -> np.ndarray:
    """Vectors in double precision, each times a power of two that brings its largest component to 0.5 .. 1."""
    v = v.astype(np.float64)
    _, power = np.frexp(np.abs(v).max(axis=1, keepdims=True))
    return np.ldexp(v, -power)


def _unit(v: np.ndarray) -> np.ndarray:
    return (v / np.linalg.norm(v, axis=1, keepdims=True)).astype(np.float32)


def _planted(x: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """(rows of x, vectors at cosine ``least`` from them): the farthest that a search must still reach."""
    rows = np.linspace(0, len(x) - 1, min(PLANTED, len(x))).astype(int)
    v = x[rows].astype(np.float64)
    side = np.random.default_rng(0).standard_normal(v.shape)
    side -= (side * v).sum(axis=1, keepdims=True) * v
    size = np.linalg.norm(side, axis=1, keepdims=True)
    out = np.where(size > 1e-9, least * v + np.sqrt(1 - least**2) * side / np.maximum(size, 1e-9), v)
    return rows, out.astype(np.float32)


class Shard:
    """A shard's vectors and graph; what the links found so far connect is kept as a root for each vector."""

    def __init__(self, ids: np.ndarray, many: np.ndarray, x: np.ndarray, sizes: list[int], layers: list[np.ndarray]):
        self.ids, self.many, self.x, self.length = ids, many, x, np.linalg.norm(x, axis=1)
        self.graph = Graph(_unit(x), sizes, layers)
        self.root = np.arange(len(ids))
        self.by_id = np.argsort(ids, kind="stable")
        #: Twice what a cosine of unit vectors in single precision can be off.
        self.margin = np.float32((x.shape[1] + 4) * 1.2e-7)

    def fold(self, q_ids: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Edges (id, id) that connect what the links of rows a of a block and rows b of the shard connect: one for each row of the block, one for each two roots that become one."""
        roots, code_b = np.unique(self.root[b], return_inverse=True)
        rows, code_a = np.unique(a, return_inverse=True)
        k = len(roots)
        low = np.arange(k + len(rows))  # roots first, so that a component's least node is a root
        code_a = code_a + k
        while True:
            new, least = low.copy(), np.minimum(low[code_a], low[code_b])
            for side in (low[code_a], low[code_b], code_a, code_b):
                np.minimum.at(new, side, least)
            new = new[new]
            if (new == low).all():
                break
            low = new
        moved = np.flatnonzero(low[:k] != np.arange(k))
        onto = np.arange(len(self.root))
        onto[roots] = roots[low[:k]]
        self.root = onto[self.root]
        left = np.concatenate([q_ids[rows], self.ids[roots[moved]]])
        return left, self.ids[np.concatenate([roots[low[k:]], roots[low[moved]]])]

    def exact(self, unit: np.ndarray, q: np.ndarray, q_ids: np.ndarray, least: float) -> np.ndarray:
        """Which vectors of the shard each row links with: single precision decides where it is sure, double precision elsewhere."""
        cosine = unit @ self.graph.x.T
        linked = cosine >= least + self.margin
        a, b = np.nonzero(np.abs(cosine - np.float32(least)) <= 2 * self.margin)
        linked[a, b] = self.cosines(q, a, b) >= least
        place = np.minimum(np.searchsorted(self.ids, q_ids, sorter=self.by_id), len(self.ids) - 1)
        own = self.by_id[place]
        linked[np.arange(len(q)), own] &= self.ids[own] != q_ids
        return linked

    def cosines(self, q: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.einsum("kd,kd->k", q[a], self.x[b]) / (np.linalg.norm(q, axis=1)[a] * self.length[b])


class Found:
    """Links of a block with a shard: a count for each row of the block, edges that connect, audited links and those found, the beam."""

    def __init__(self, rows: int):
        self.counts, self.edges = np.zeros(rows, dtype=np.int64), []
        self.wanted = self.got = self.beam = 0


def links_in(shard: Shard, q: np.ndarray, q_ids: np.ndarray, least: float, beam: int) -> Found:
    """Every link found between a block (scaled vectors and their ids) and a shard."""
    unit, n, out = _unit(q), len(shard.ids), Found(len(q))
    audit = np.linspace(0, len(q) - 1, min(AUDITED, len(q))).astype(int)
    linked = shard.exact(unit[audit], q[audit], q_ids[audit], least)
    source, plants = _planted(shard.graph.x, least)
    most = beam << DOUBLINGS
    while beam <= most:  # widen until the audits pass; rows that are widened later anyway don't count as missed
        (found, sims), (seen, near) = shard.graph.nearest(unit[audit], beam), shard.graph.nearest(plants, beam)
        settled, sure = sims[:, -1] < least - SLACK, near[:, -1] < least - SLACK
        want = linked[settled].sum()
        got = np.take_along_axis(linked, np.maximum(found, 0), axis=1)[settled][found[settled] >= 0].sum()
        if got >= LINK_RECALL * want and (seen == source[:, None]).any(axis=1)[sure].sum() >= PLANT_RECALL * sure.sum():
            break
        beam *= 2
    out.beam = beam
    todo, width = np.arange(len(q)), beam
    while len(todo) and width <= most:
        again = []
        step = max(1, min(TOGETHER, 8_000_000 // n))
        for at in range(0, len(todo), step):
            some = todo[at : at + step]
            found, sims = shard.graph.nearest(unit[some], width)
            full = (sims[:, -1] >= least - SLACK) & (width < n)
            again.append(some[full])
            a, b = np.nonzero((sims >= least - 1e-3) & (found >= 0) & ~full[:, None])
            a, b = some[a], found[a, b]
            good = (shard.cosines(q, a, b) >= least) & (q_ids[a] != shard.ids[b])
            if good.any():
                np.add.at(out.counts, a[good], shard.many[b[good]])
                out.edges.append(shard.fold(q_ids, a[good], b[good]))
        todo, width = np.concatenate(again), 2 * width
    _compare(shard, unit, q, q_ids, least, todo, out)
    out.wanted = int((linked @ shard.many).sum())
    if out.counts[audit].sum() < LINK_RECALL * out.wanted:  # the graph misses too many of this block's links
        _compare(shard, unit, q, q_ids, least, np.arange(len(q)), out)
    out.got = int(out.counts[audit].sum())
    return out


def _compare(shard: Shard, unit: np.ndarray, q: np.ndarray, q_ids: np.ndarray, least: float, rows: np.ndarray, out: Found) -> None:
    """All links of these rows with the shard, in bands of at most ``BAND`` cosines."""
    step = max(1, BAND // len(shard.ids))
    for at in range(0, len(rows), step):
        some = rows[at : at + step]
        linked = shard.exact(unit[some], q[some], q_ids[some], least)
        out.counts[some] = linked @ shard.many
        order = np.argsort(shard.root, kind="stable")  # links with one root are one edge
        first = np.flatnonzero(np.concatenate([[True], np.diff(shard.root[order]) != 0]))
        a, b = np.nonzero(np.logical_or.reduceat(linked[:, order], first, axis=1))
        if len(a):
            out.edges.append(shard.fold(q_ids, some[a], order[first[b]]))


def pack_shard(ids: np.ndarray, many: np.ndarray, v: np.ndarray, digest: np.ndarray) -> dict:
    """A shard as one row, its vectors ordered by layer; layers come from the digests, so that a rerun builds the same graph."""
    share = ((digest.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(11)).astype(np.float64) / 2**53
    levels = np.floor(-np.log(np.maximum(share, 1e-16)) / np.log(LINKS)).astype(int)
    order = np.lexsort((digest, -levels))
    ids, many, v, levels = ids[order], many[order], v[order], levels[order]
    graph = Graph.build(_unit(scaled(v)), levels)
    return {"dim": v.shape[1], "ids": ids.tobytes(), "many": many.tobytes(), "vectors": v.tobytes(), "sizes": graph.sizes, "layers": [x.tobytes() for x in graph.layers]}


_PACKED = "part int, dim int, ids binary, many binary, vectors binary, sizes array<long>, layers array<binary>"


def _open_part(fs: pyarrow.fs.FileSystem, root: str, part: int, columns: list[str]) -> Iterator[dict]:
    """The row of a shard's file, or nothing where hashing left the shard empty."""
    folder = pyarrow.fs.FileSelector(f"{root}/part={part}", allow_not_found=True)
    for info in sorted(fs.get_file_info(folder), key=lambda i: i.path):
        if info.base_name.endswith(".parquet"):
            with fs.open_input_file(info.path) as file:
                yield from pyarrow.parquet.read_table(file, columns=columns).to_pylist()


def _vectors(row: dict, dtype: np.dtype) -> np.ndarray:
    return scaled(np.frombuffer(row["vectors"], dtype=dtype).reshape(-1, row["dim"]))


def _dealt(embeddings: DataFrame, shard_rows: int) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, DataFrame]:
    """(all rows, those that can link, classes, classes with their shard, (dim, shards, first part)); the last three written."""
    wide = isinstance(embeddings.schema["embedding"].dataType, T.ArrayType) and isinstance(embeddings.schema["embedding"].dataType.elementType, T.FloatType)
    kind = "float" if wide else "double"  # floats stay floats on the way
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(f"array<{kind}>").alias("v"))
    limit = F.lit(1.7976931348623157e308)
    fine = F.coalesce(F.forall("v", lambda x: F.coalesce((x.cast("double") >= -limit) & (x.cast("double") <= limit), F.lit(False))) & F.exists("v", lambda x: x != 0), F.lit(False))
    fit = rows.where(fine).select("vec_id", F.transform("v", lambda x: x + F.lit(0.0).cast(kind)).alias("v"))  # one zero
    fit = fit.select("vec_id", F.xxhash64("v").alias("k1"), F.xxhash64(F.lit(7), "v").alias("k2"), "v")
    classes = fit.groupBy("k1", "k2").agg(F.min("vec_id").alias("low"), F.count("*").alias("many"), F.first("v").alias("v"))
    classes = materialize(classes.withColumn("rep", F.monotonically_increasing_id()).withColumn("dim", F.size("v")), "vector-classes")
    width = 4 if wide else 8
    most = F.least(F.lit(shard_rows), F.greatest(F.lit(1024), F.floor(F.lit(SHARD_BYTES) / (F.col("dim") * width))))
    dims = classes.groupBy("dim").agg(F.count("*").alias("n")).select("dim", F.greatest(F.ceil(F.col("n") / most), F.least(F.lit(LEAST_SHARDS), F.ceil(F.col("n") / 512))).cast("int").alias("shards"))
    before = F.coalesce(F.sum("shards").over(Window.orderBy("dim").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("int")
    dims = materialize(dims.select("dim", "shards", before.alias("start")), "vector-lengths")  # a row for each length of vectors
    parted = classes.join(dims, "dim").select("rep", "many", "k1", "v", (F.col("start") + F.pmod(F.xxhash64("k1", "k2"), "shards")).cast("int").alias("part"))
    return rows.withColumn("fine", fine), fit, classes, parted, dims


def find_links(parted: DataFrame, dims: DataFrame, least: float, beam: int, block_rows: int) -> DataFrame:
    """(rep, n, to, wanted, got), written: counts of a class's links, edges of a forest, and audits, by which of n, to and wanted is set."""
    spark = parted.sparkSession
    total = dims.agg(F.sum("shards")).first()[0] or 0
    if not total:
        return spark.createDataFrame([], "rep long, n long, to long, wanted long, got long")
    dtype = np.dtype("f4") if parted.schema["v"].dataType.elementType == T.FloatType() else np.dtype("f8")
    path = new_path(spark, "graphs")

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = [b for b in batches if b.num_rows]  # one shard, of bounded bytes
        if held:
            rows = pa.Table.from_batches(held)
            flat = rows.column("v").combine_chunks()
            v = flat.flatten().to_numpy(zero_copy_only=False).reshape(len(rows), -1)
            shard = pack_shard(rows.column("rep").to_numpy(), rows.column("many").to_numpy(), v, rows.column("k1").to_numpy())
            yield pa.RecordBatch.from_pylist([{"part": rows.column("part")[0].as_py(), **shard}], schema=pa.schema([("part", pa.int32()), ("dim", pa.int32()), ("ids", pa.binary()), ("many", pa.binary()), ("vectors", pa.binary()), ("sizes", pa.list_(pa.int64())), ("layers", pa.list_(pa.binary()))]))
        release()

    parted.repartitionById(total, "part").mapInArrow(pack, _PACKED).write.partitionBy("part").parquet(path)
    chunk = max(1, min(CHUNK, total // LEAST_SHARDS))
    spans = dims.select("start", (F.col("start") + F.col("shards")).alias("end"), F.explode(F.sequence(F.col("start"), F.col("start") + F.col("shards") - 1)).alias("part"))
    asked = spans.select("part", "end", F.explode(F.expr(f"sequence(start, end - 1, {chunk})")).alias("low")).select("part", "low", F.least("end", F.col("low") + chunk).alias("high"))
    asked = materialize(asked, "graph-tasks")
    tasks = asked.count()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, types = ["rep", "n", "to", "wanted", "got"], [pa.int64()] * 5
        fs, root = pyarrow.fs.FileSystem.from_uri(path)
        for batch in batches:
            for part, low, high in zip(*(c.to_pylist() for c in batch.columns)):
                for row in _open_part(fs, root, part, ["dim", "ids", "many", "vectors", "sizes", "layers"]):
                    layers = [np.frombuffer(b, dtype=np.int32).reshape(s, -1) for b, s in zip(row["layers"], row["sizes"])]
                    shard = Shard(np.frombuffer(row["ids"], np.int64), np.frombuffer(row["many"], np.int64), _vectors(row, dtype), list(row["sizes"]), layers)
                    for other in (o for k in range(low, high) for o in _open_part(fs, root, k, ["dim", "ids", "vectors"])):
                        q_ids, q = np.frombuffer(other["ids"], np.int64), _vectors(other, dtype)
                        for at in range(0, len(q), block_rows):
                            ids = q_ids[at : at + block_rows]
                            found = links_in(shard, q[at : at + block_rows], ids, least, beam)
                            some = np.flatnonzero(found.counts)
                            yield pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.array(found.counts[some]), *(pa.nulls(len(some), pa.int64()) for _ in range(3))], names=names)
                            for left, right in found.edges:
                                yield pa.RecordBatch.from_arrays([pa.array(left), pa.nulls(len(left), pa.int64()), pa.array(right), *(pa.nulls(len(left), pa.int64()) for _ in range(2))], names=names)
                            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((None, None, None, found.wanted, found.got), types)], names=names)
        release()

    spread = asked.repartition(tasks, "part", "low") if tasks > 10_000 else asked.withColumn("task", (F.row_number().over(Window.orderBy("part", "low")) - 1).cast("int")).repartitionById(tasks, "task").drop("task")
    return materialize(spread.mapInArrow(run, "rep long, n long, to long, wanted long, got long"), "found-links")


def recall(found: DataFrame) -> tuple[int, int]:
    """(links of the audited vectors by brute force, those found) over all blocks and shards."""
    row = found.where("wanted is not null").agg(F.coalesce(F.sum("wanted"), F.lit(0)), F.coalesce(F.sum("got"), F.lit(0))).first()
    return row[0], row[1]


def near_duplicates(embeddings: DataFrame, least: float = 0.95, beam: int = 16, shard_rows: int = SHARD_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of ``embeddings`` (vec_id, embedding)."""
    rows, fit, classes, parted, dims = _dealt(embeddings, shard_rows)
    found = find_links(parted, dims, least, beam, block_rows)
    wanted, got = recall(found)
    if got < LEAST_RECALL * wanted:
        raise RuntimeError(f"only {got} of {wanted} audited links were found")
    components = connected_components(found.where("to is not null").select("rep", "to"), "vector-links")
    counts = found.where("n is not null").groupBy("rep").agg(F.sum("n").alias("n"))
    named = classes.select("rep", "k1", "k2", "low", "many")
    labelled = named.join(counts, "rep", "left").join(components, F.col("rep") == F.col("id"), "left")
    labelled = labelled.select("k1", "k2", "low", (F.coalesce("n", F.lit(0)) + F.col("many") - 1).alias("n_links"), F.coalesce("component", "rep").alias("root"))
    lowest = labelled.groupBy("root").agg(F.min("low").alias("component_id"))
    known = labelled.join(lowest, "root").select("k1", "k2", "n_links", "component_id")
    plain = fit.select("vec_id", "k1", "k2").join(known, ["k1", "k2"]).select("vec_id", "n_links", "component_id")
    rest = rows.where("not fine").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return plain.unionByName(rest).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))


SQL = """
WITH RECURSIVE v AS (
    SELECT vec_id, embedding::DOUBLE[] AS e, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS size FROM embeddings),
links AS MATERIALIZED (
    SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id
    WHERE a.size > 0 AND b.size > 0 AND list_dot_product(a.e, b.e) / (a.size * b.size) >= 0.95),
reach(id, low) AS (SELECT vec_id, vec_id FROM v UNION SELECT links.b, reach.low FROM reach JOIN links ON reach.id = links.a),
lowest AS (SELECT id, min(low) AS component_id FROM reach GROUP BY id)
SELECT vec_id, (SELECT count(*) FROM links WHERE a = vec_id)::BIGINT AS n_links, component_id, vec_id = component_id AS kept
FROM v JOIN lowest ON vec_id = id
"""
