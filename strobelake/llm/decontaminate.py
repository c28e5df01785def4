"""Benchmark decontamination by greedy string tiling.

Words are lower-cased runs without white space, ASCII punctuation taken out. Running
Karp-Rabin hashes name every seed of ``seed_words`` words. One pass over the documents
keeps those with a seed in a bitmap of the benchmark's seeds (of fixed size, so that it
may saturate but not grow); an equi-join of these seeds with those of the benchmark
gives the pairs that share enough of them, and each pair of texts is tiled: running
Karp-Rabin scans for matches of falling lengths, and the longest unmarked match of words is
marked in both again and again until none of at least ``seed_words`` words is left. A document is contaminated if the tiles cover at least
``coverage`` of the item's words, in whatever order they stand.

Nothing of the benchmark passes through the driver but the bitmap and the few widths of
seeds. Documents, like items, are judged once for each distinct text. Of pairs of equal windows only those that begin a
longest match are kept, so a text of one repeated word holds no square of its length.

Defined cases: null texts count as empty; an item of fewer words than a seed is one
seed of its own length; an empty item matches nothing; items with equal texts are
all reported; of equally long matches the one earliest in the document, then in the
item, is marked; very long texts are read whole, one at a time; rows that repeat a doc_id are
each judged and give one row for each item; other columns are ignored, whatever
their names; empty tables give an empty result.
"""

from __future__ import annotations

import heapq
import string
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strobelake.llm.common import columns_of, fresh_names, materialize, release, table
from strobelake.llm.pieces import joined, text_blocks

#: Base of the Karp-Rabin hashes, modulo 2**64: odd, so that it has an inverse.
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
BLOCK_BYTES = 2_000_000
#: Pairs of windows with equal hashes that a scan looks at together.
PAIRS = 1 << 20
#: Bits of the map of seeds (4 MB at any size of the benchmark), and the parts of a hash that set them.
MAP_BITS, MAP_SHIFTS = 25, (0, 20, 39)
_PUNCTUATION = string.punctuation.encode()
_SPACES = np.zeros(256, dtype=bool)
_SPACES[list(b" \t\n\r\x0b\x0c")] = True
RESULT = "doc_id long, item_id long, covered long, item_words long, coverage double, tiles long"


def words_of(text: bytes) -> list[bytes]:
    return text.lower().translate(None, _PUNCTUATION).split()


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2**64."""
    out = np.ones(n, dtype=np.uint64)
    with np.errstate(over="ignore"):
        out[1:] = np.uint64(base)
        return np.cumprod(out, dtype=np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    """Hashes with their bits stirred."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        return x ^ (x >> np.uint64(29))


def rolling(codes: np.ndarray, width: int) -> np.ndarray:
    """The Karp-Rabin hash of every window of ``width`` codes."""
    if len(codes) < width:
        return np.zeros(0, dtype=np.uint64)
    n = len(codes) - width + 1
    with np.errstate(over="ignore"):
        out = np.full(n, width, dtype=np.uint64)
        for k in range(width):
            out = out * np.uint64(_BASE) + codes[k : k + n]
    return mixed(out)


def word_codes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(a hash of each word of all texts, the bounds of the texts in them), by running sums over all bytes."""
    data, bounds = joined([t.lower().translate(None, _PUNCTUATION) + b" " for t in texts])
    space = _SPACES[data]
    starts = np.flatnonzero(~space & np.concatenate([[True], space[:-1]])) if len(data) else np.zeros(0, dtype=np.int64)
    ends = np.flatnonzero(space & np.concatenate([[False], ~space[:-1]])) if len(data) else starts
    with np.errstate(over="ignore"):
        sums = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(_BASE, len(data)), out=sums[1:])
        codes = mixed((sums[ends] - sums[starts]) * powers(_INVERSE, len(data) + 1)[starts])
    return codes, np.searchsorted(starts, bounds)


def sums(codes: np.ndarray, ahead: np.ndarray) -> np.ndarray:
    """Running Karp-Rabin sums: the hash of any window is a difference of two, brought to the power of its start."""
    out = np.zeros(len(codes) + 1, dtype=np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum(mixed(codes.astype(np.uint64)) * ahead[: len(codes)], out=out[1:])
    return out


def room(usable: np.ndarray) -> np.ndarray:
    """How many usable places follow each other from each place on."""
    places = np.arange(len(usable))
    stop = np.where(usable, len(usable), places)
    return np.minimum.accumulate(stop[::-1])[::-1] - places


def stretches(free: np.ndarray, width: int) -> Iterator[tuple[int, int]]:
    """(start, end) of the runs of at least ``width`` true values."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], free.view(np.int8), [0]])))
    for low, high in edges.reshape(-1, 2).tolist():
        if high - low >= width:
            yield low, high


class Scan:
    """Two sequences of codes (0: a word that the other lacks) with their running hashes and what is marked in them."""

    def __init__(self, doc: np.ndarray, item: np.ndarray):
        n = max(len(doc), len(item)) + 1
        ahead, self.back = powers(_BASE, n), powers(_INVERSE, n)
        self.doc, self.item, self.doc_sums, self.item_sums = doc, item, sums(doc, ahead), sums(item, ahead)
        self.free_doc, self.free_item = doc > 0, np.ones(len(item), dtype=bool)

    def hashes(self, own: np.ndarray, at: np.ndarray, size: int | np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (own[at + size] - own[at]) * self.back[at]

    def matches(self, size: int) -> list[tuple[int, int, int]]:
        """(-words, start in doc, start in item) of every longest run of unmarked words with equal hashes, of ``size`` words at least."""
        doc_room, item_room = room(self.free_doc), room(self.free_item)
        d, i = np.flatnonzero(doc_room >= size), np.flatnonzero(item_room >= size)
        if not len(d) or not len(i):
            return []
        doc_hash, item_hash = self.hashes(self.doc_sums, d, size), self.hashes(self.item_sums, i, size)
        order = np.argsort(doc_hash, kind="stable")
        low, high = np.searchsorted(doc_hash[order], item_hash, "left"), np.searchsorted(doc_hash[order], item_hash, "right")
        runs: list[tuple[int, int, int]] = []
        ends = np.cumsum(high - low)
        begin = 0
        while begin < len(i):  # as many windows of the item at once as meet PAIRS windows of the document, or one
            before = ends[begin - 1] if begin else 0
            stop = max(begin + 1, int(np.searchsorted(ends, before + PAIRS, "right")))
            count = high[begin:stop] - low[begin:stop]
            shift = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
            x, y = d[order[np.repeat(low[begin:stop], count) + shift]], np.repeat(i[begin:stop], count)
            begin = stop
            inner = (x > 0) & (y > 0)
            inner[inner] = self.free_doc[x[inner] - 1] & self.free_item[y[inner] - 1] & (self.doc[x[inner] - 1] == self.item[y[inner] - 1])
            x, y = x[~inner], y[~inner]  # where a run begins
            most = np.minimum(doc_room[x], item_room[y])
            length = np.full(len(x), size)
            for step in (1 << k for k in reversed(range(int(most.max(initial=1)).bit_length()))):
                at = np.flatnonzero(length + step <= most)
                longer = length[at] + step
                at = at[self.hashes(self.doc_sums, x[at], longer) == self.hashes(self.item_sums, y[at], longer)]
                length[at] += step
            runs += zip((-length).tolist(), x.tolist(), y.tolist())
        return runs


def tile(doc: np.ndarray, item: np.ndarray, width: int) -> list[tuple[int, int, int]]:
    """Greedy tiling of two sequences of codes: (start in doc, start in item, words).

    Running Karp-Rabin looks for matches of at least some length, from the longest that can be down by halves to
    ``width``. The longest is marked first, if its words are equal as its hashes are; what a mark leaves of a match
    waits for its own length, or is found by a later scan.
    """
    scan, tiles = Scan(doc, item), []
    size = min(int(room(scan.free_doc).max(initial=0)), len(item))
    while size >= width:
        waiting = scan.matches(size)
        heapq.heapify(waiting)
        while waiting:
            length, d, i = heapq.heappop(waiting)
            same = scan.free_doc[d : d - length] & scan.free_item[i : i - length] & (doc[d : d - length] == item[i : i - length])
            if not same.all():
                for low, high in stretches(same, size):
                    heapq.heappush(waiting, (low - high, d + low, i + low))
                continue
            tiles.append((d, i, -length))
            scan.free_doc[d : d - length] = scan.free_item[i : i - length] = False
            if next(stretches(scan.free_item, width), None) is None:
                return tiles
        if size == width:
            break
        size = max(width, size // 2)
    return tiles


def judge(doc: list[bytes], item: list[bytes], width: int) -> tuple[int, int]:
    """(words covered, tiles) of an item in a document."""
    code = {w: k for k, w in enumerate(dict.fromkeys(item), 1)}
    get = code.get
    found = tile(np.array([get(w, 0) for w in doc], dtype=np.int64), np.array([code[w] for w in item], dtype=np.int64), width)
    return sum(t[2] for t in found), len(found)


def _digest(text: str | Column) -> Column:
    return F.sha2(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), 256)


def _items(benchmark: DataFrame, seed_words: int) -> DataFrame:
    """(item, text, n_words, width, seeds): each distinct text of the benchmark that has words, with its seeds."""
    texts = benchmark.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).distinct().select(_digest("text").alias("item"), "text")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, texts in text_blocks(batch.column(1), BLOCK_BYTES):
                codes, bounds = word_codes(texts)
                own = [codes[a:b] for a, b in zip(bounds, bounds[1:])]
                width = [min(seed_words, len(c)) for c in own]
                seeds = [rolling(c, w).view(np.int64) if w else c.view(np.int64) for c, w in zip(own, width)]
                some = batch.slice(low, high - low)
                yield pa.RecordBatch.from_arrays(
                    [*some.columns, pa.array([len(c) for c in own], pa.int64()), pa.array(width, pa.int32()), pa.array(seeds, pa.list_(pa.int64()))], names=["item", "text", "n_words", "width", "seeds"]
                )

    return texts.mapInArrow(run, "item string, text string, n_words long, width int, seeds array<long>").where("n_words > 0")


def _seed_map(seeds: DataFrame) -> np.ndarray:
    """The bits that the seeds set, packed in 64-bit words: at most 2 ** (MAP_BITS - 6) rows come to the driver."""
    mask = (1 << MAP_BITS) - 1
    bits = seeds.select(F.explode(F.array(*[F.expr(f"shiftrightunsigned(seed, {s}) & {mask}L") for s in MAP_SHIFTS])).alias("bit"))
    words = bits.groupBy(F.expr("shiftright(bit, 6)").alias("at")).agg(F.expr("bit_or(shiftleft(1L, cast(bit & 63 AS int)))").alias("word")).toArrow()
    out = np.zeros(1 << (MAP_BITS - 6), dtype=np.int64)
    out[words.column("at").to_numpy()] = words.column("word").to_numpy()
    return out.view(np.uint8)


def _candidates(docs: DataFrame, widths: list[int], seen: np.ndarray) -> DataFrame:
    """(doc_id, text, seeds): the documents with a seed in the map, and their distinct seeds in it."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(seen)  # MAP_BITS bits

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, mask = shared.value, np.uint64((1 << MAP_BITS) - 1)
        for batch in batches:
            for low, high, texts in text_blocks(batch.column(1), BLOCK_BYTES):
                codes, bounds = word_codes(texts)
                owners, found = [], []
                for width in widths:
                    seeds = rolling(codes, width)
                    met = np.ones(len(seeds), dtype=bool)
                    for shift in MAP_SHIFTS:
                        at = np.flatnonzero(met)
                        bit = (seeds[at] >> np.uint64(shift)) & mask
                        met[at] = (held[(bit >> np.uint64(3)).astype(np.int64)] >> (bit & np.uint64(7)).astype(np.uint8)) & 1
                    at = np.flatnonzero(met)
                    row = np.searchsorted(bounds, at, side="right") - 1
                    inside = at + width <= bounds[row + 1]  # no window goes over into the next text
                    owners.append(row[inside])
                    found.append(seeds[at[inside]])
                owner, seed = np.concatenate(owners), np.concatenate(found).view(np.int64)
                if not len(owner):
                    continue
                order = np.lexsort((seed, owner))
                owner, seed = owner[order], seed[order]
                new = np.concatenate([[True], (np.diff(owner) != 0) | (np.diff(seed) != 0)])
                rows, first = np.unique(owner[new], return_index=True)
                some = batch.slice(low, high - low).take(pa.array(rows))
                lists = np.split(seed[new], first[1:])
                yield pa.RecordBatch.from_arrays([*some.columns, pa.array(lists, pa.list_(pa.int64()))], names=["doc_id", "text", "seeds"])
        release()

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(run, "doc_id long, text string, seeds array<long>").withColumn("doc", _digest("text"))


def _tiled(pairs: DataFrame, coverage: float) -> DataFrame:
    """(doc, item, covered, item_words, coverage, tiles) of the pairs (doc, item, width, item_text, text) that pass."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, words = None, []
        for batch in batches:
            rows = []
            for k in range(batch.num_rows):  # pairs come by document: its words are cut once
                doc, item, width, benchmark, text = (batch.column(c)[k] for c in range(5))
                if doc.as_py() != last:
                    last, words = doc.as_py(), words_of(text.cast(pa.binary()).as_py())
                wanted = words_of(benchmark.cast(pa.binary()).as_py())
                covered, tiles = judge(words, wanted, width.as_py())
                if covered >= coverage * len(wanted):
                    rows.append((last, item.as_py(), covered, len(wanted), covered / len(wanted), tiles))
            types = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.float64(), pa.int64()]
            columns = list(zip(*rows)) or [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["doc", "item", "covered", "item_words", "coverage", "tiles"])

    return pairs.select("doc", "item", "width", "item_text", "text").mapInArrow(run, "doc string, item string, covered long, item_words long, coverage double, tiles long")


def _matched(docs: DataFrame, benchmark: DataFrame, seed_words: int, coverage: float) -> tuple[DataFrame, DataFrame]:
    """(candidates (doc_id, doc, ...), matches (doc, item, covered, ...)), both written; doc and item are digests of texts."""
    items = materialize(_items(benchmark, seed_words), "benchmark-items")
    seeds = materialize(items.select("item", "n_words", "width", F.explode("seeds").alias("seed")).groupBy("seed", "item", "n_words", "width").agg(F.count("*").alias("places")), "benchmark-seeds")
    widths = sorted(r["width"] for r in items.select("width").distinct().collect())  # 1 .. seed_words
    candidates = materialize(_candidates(docs, widths, _seed_map(seeds)), "candidates") if widths else docs.sparkSession.createDataFrame([], "doc_id long, text string, seeds array<long>, doc string")
    distinct = candidates.groupBy("doc").agg(F.first("seeds").alias("seeds"))  # equal texts have equal seeds
    shared = distinct.select("doc", F.explode("seeds").alias("seed")).join(seeds, "seed")
    # a tile of n words is n - width + 1 seeds, n / width at least: with fewer seeds in common no tiling covers enough
    enough = F.sum("places") * F.first("width") >= F.lit(coverage) * F.first("n_words")
    pairs = materialize(shared.groupBy("doc", "item").agg(enough.alias("enough")).where("enough").select("doc", "item"), "shared-seeds")
    texts = candidates.join(pairs.select("doc").distinct(), "doc", "left_semi").groupBy("doc").agg(F.first("text").alias("text"))
    known = items.select("item", "width", F.col("text").alias("item_text"))
    return candidates, materialize(_tiled(pairs.join(known, "item").join(texts, "doc"), coverage), "contaminated")


def contaminated(docs: DataFrame, benchmark: DataFrame, seed_words: int = 5, coverage: float = 0.8) -> DataFrame:
    """One row (doc_id, item_id, covered, item_words, coverage, tiles) for each document and item that it contains."""
    candidates, found = _matched(docs, benchmark, seed_words, coverage)
    named = benchmark.select(F.col("item_id").cast("long").alias("item_id"), _digest(F.col("text").cast("string")).alias("item"))
    rows = candidates.select("doc_id", "doc").join(found, "doc").join(named, "item")
    return rows.select("doc_id", "item_id", "covered", "item_words", "coverage", "tiles")


def clean(docs: DataFrame, benchmark: DataFrame, seed_words: int = 5, coverage: float = 0.8) -> DataFrame:
    """The rows of ``docs`` that contain no item."""
    _, found = _matched(docs, benchmark, seed_words, coverage)
    own, other = fresh_names(docs, "doc", "contaminated")
    bad = found.select(F.col("doc").alias(other)).distinct()
    keyed = docs.withColumn(own, _digest(F.col("text").cast("string")))
    return keyed.join(bad, F.col(own) == F.col(other), "left_anti").select(*columns_of(docs))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
