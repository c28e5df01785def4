"""Resampling documents towards a target distribution by the importance of hashed word features.

Features are runs of consecutive words; a feature's bucket is its CRC-32 modulo a number of buckets. Each task keeps a trie
of words: a node stands for the run that its path spells, holds how often it was met, and the CRC of what was spelt so far, from which
the CRC of a child goes on with a blank and one more word. When a trie is full, its counts are added to the task's
bucket totals and it begins anew; totals of all tasks are summed. To score, documents walk tries whose nodes have the
gains of their buckets attached, so a gain is looked up once a node and not once an occurrence.

Every document gets a Gumbel number from a hash of its id, and the largest sums of weight and number are drawn: a
sample in proportion to the weights, without replacement. Ranks are positions in ranges of the scores plus the counts before them, so no task sees all.

Defined cases: null and empty texts have no words; bytes that are no UTF-8 count as U+FFFD; a null doc_id is spelt as
nothing in the hash and comes last among ties; rows that repeat are documents of their own, in any order among themselves;
very long texts are read whole; an empty table gives an empty result, and an empty target has no features (every bucket's gain follows the
formula with zeros); other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strobelake.llm.common import materialize, release, table
from strobelake.llm.pieces import distinct_pieces, joined, text_blocks

BLOCK_BYTES = 2_000_000
#: Nodes and bytes of words of a trie before it begins anew.
TRIE_NODES, TRIE_BYTES = 400_000, 16 << 20

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD = np.zeros(256, dtype=bool)
_WORD[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True


class Trie:
    """Runs of up to ``longest`` words; node 0 is the root, whose children are the first words."""

    def __init__(self, longest: int, buckets: int, gains: np.ndarray | None = None):
        self.longest, self.buckets, self.gains = longest, buckets, gains
        self.clear()

    def clear(self) -> None:
        self.words: dict[bytes, int] = {}
        self.spelt: list[bytes] = []
        self.size, self.bytes = 1, 0
        #: Children by (node, word) in one sorted array, and by node: the child's CRC so far and its count or gain.
        self.keys, self.nodes = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        self.crc = np.zeros(1024, dtype=np.uint32)
        self.value = np.zeros(1024, dtype=np.int64)

    @property
    def full(self) -> bool:
        return self.size > TRIE_NODES or self.bytes > TRIE_BYTES

    def _numbers(self, words: list[bytes]) -> np.ndarray:
        known, spelt = self.words, self.spelt
        for w in words:
            if w not in known:
                known[w] = len(spelt)
                spelt.append(w)
                self.bytes += len(w)
        return np.array([known[w] for w in words], dtype=np.int64)

    def children(self, parents: np.ndarray, words: np.ndarray) -> np.ndarray:
        """The node that each (node, word) leads to; nodes that are not there yet grow."""
        wanted = (parents << 32) | words
        keys, back = np.unique(wanted, return_inverse=True)
        place = np.minimum(np.searchsorted(self.keys, keys), max(0, len(self.keys) - 1))
        there = self.keys[place] == keys if len(self.keys) else np.zeros(len(keys), dtype=bool)
        node = np.where(there, self.nodes[place], 0) if len(self.keys) else np.zeros(len(keys), dtype=np.int64)
        new = keys[~there]
        if len(new):
            node[~there] = grown = np.arange(self.size, self.size + len(new))
            self.size += len(new)
            if self.size > len(self.crc):
                more = max(self.size, 2 * len(self.crc)) - len(self.crc)
                self.crc, self.value = np.append(self.crc, np.zeros(more, np.uint32)), np.append(self.value, np.zeros(more, np.int64))
            above, last = (new >> 32).tolist(), (new & 0xFFFFFFFF).tolist()
            before = self.crc[new >> 32].tolist()
            self.crc[grown] = [zlib.crc32(b" " + self.spelt[w], c) if p else zlib.crc32(self.spelt[w]) for p, w, c in zip(above, last, before)]
            if self.gains is not None:
                self.value[grown] = self.gains[self.crc[grown] % np.uint32(self.buckets)]
            at = np.searchsorted(self.keys, new)
            self.keys, self.nodes = np.insert(self.keys, at, new), np.insert(self.nodes, at, grown)
        return node[back]

    def walks(self, texts: list[bytes]) -> tuple[np.ndarray, Iterator[tuple[np.ndarray, np.ndarray]]]:
        """(words of each text, for each number of words the nodes that its runs lead to and their texts)."""
        data, bounds = joined(texts)
        lower = _LOWER[data]
        inside, first = _WORD[lower], np.zeros(len(data) + 1, dtype=bool)
        first[bounds] = True  # a text ends where the next begins
        begin, end = inside.copy(), inside.copy()
        begin[1:] &= ~inside[:-1] | first[1:-1]
        end[:-1] &= ~inside[1:] | first[1:-1]
        starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
        owner = np.searchsorted(bounds, starts, side="right") - 1
        if len(starts):
            index, words = distinct_pieces(lower, starts, ends)
            word = self._numbers(words)[index]
        else:
            word = np.zeros(0, dtype=np.int64)

        def runs() -> Iterator[tuple[np.ndarray, np.ndarray]]:
            node, at = np.zeros(len(word), dtype=np.int64), np.arange(len(word))
            for size in range(self.longest):
                keep = at + size < len(word)
                at, node = at[keep], node[keep]
                keep = owner[at] == owner[at + size]
                at, node = at[keep], node[keep]
                if not len(at):
                    return
                node = self.children(node, word[at + size])
                yield node, owner[at]

        return np.bincount(owner, minlength=len(texts)), runs()

    def count(self, texts: list[bytes]) -> None:
        for node, _ in self.walks(texts)[1]:
            n = np.bincount(node, minlength=len(self.value))
            self.value[: len(n)] += n

    def add_to(self, totals: np.ndarray) -> None:
        used = slice(1, self.size)
        np.add.at(totals, self.crc[used] % np.uint32(self.buckets), self.value[used])

    def weigh(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(words, features, sum of gains) of each text."""
        words, runs = self.walks(texts)
        features, weight = np.zeros(len(texts), dtype=np.int64), np.zeros(len(texts), dtype=np.int64)
        for node, owner in runs:
            features += np.bincount(owner, minlength=len(texts))
            begin = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            weight[owner[begin]] += np.add.reduceat(self.value[node], begin)
        return words, features, weight


def bucket_totals(texts: DataFrame, longest: int, buckets: int) -> np.ndarray:
    """How many features fall into each bucket, over all rows of ``texts``."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, totals = Trie(longest, buckets), np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for _, _, some in text_blocks(batch.column(0), BLOCK_BYTES):
                trie.count(some)
                if trie.full:
                    trie.add_to(totals)
                    trie.clear()
        trie.add_to(totals)
        some = np.flatnonzero(totals)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(totals[some])], names=["bucket", "n"])
        release()

    rows = texts.select(F.col("text").cast("string")).mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, dtype=np.int64)
    for r in rows.collect():  # a row a bucket, at any size
        out[r["bucket"]] = r["n"]
    return out


def bucket_gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln of how much likelier a bucket is in the target), with one added to each bucket."""
    buckets, all_source, all_target = len(source), int(source.sum()), int(target.sum())
    return np.array([math.floor(1000 * math.log(float(t + 1) * float(all_source + buckets) / (float(s + 1) * float(all_target + buckets)))) for s, t in zip(source.tolist(), target.tolist())], dtype=np.int64)


def gumbel(doc_id: Column, seed: int) -> Column:
    """floor(-1000 ln(-ln u)) for a u in (0, 1) from the hash of seed and doc_id."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def weights(docs: DataFrame, gains: np.ndarray, longest: int) -> DataFrame:
    """(doc_id, n_words, n_features, weight) of every row."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Trie(longest, len(gains), gains)
        for batch in batches:
            for low, high, texts in text_blocks(batch.column(1), BLOCK_BYTES):
                found = trie.weigh(texts)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, high - low), *(pa.array(v, pa.int64()) for v in found)], names=["doc_id", "n_words", "n_features", "weight"])
                if trie.full:
                    trie.clear()
        release()

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def ranked(rows: DataFrame, most: int) -> DataFrame:
    """(row, rank) of the first ``most`` of rows (row, score, doc_id), by falling score, then doc_id, from 1."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, part, dtype=np.int32)), pa.array(np.arange(at + 1, at + n + 1)), batch.column(0)], names=["part", "place", "row"])
            at += n

    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("row").asc()]
    placed = materialize(rows.select("row", "score", "doc_id").repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, "part int, place long, row long"), "ranks")
    sums = placed.groupBy("part").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    base = F.broadcast(sums.select("part", before.alias("before")))  # a row a partition
    return placed.join(base, "part").select("row", (F.col("before") + F.col("place")).alias("rank")).where(F.col("rank") <= most)


def resample(docs: DataFrame, target: DataFrame, longest: int = 1, buckets: int = 10_000, percent: int = 10, least_words: int = 20, seed: int = 2024) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of every row; rank is null where a row isn't drawn."""
    gains = bucket_gains(bucket_totals(docs, longest, buckets), bucket_totals(target, longest, buckets))
    scored = weights(docs, gains, longest).withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed))
    scored = materialize(scored.withColumn("row", F.monotonically_increasing_id()), "importance")
    eligible = scored.where(F.col("n_words") >= least_words)
    drawn = ranked(eligible, percent * eligible.count() // 100).withColumnRenamed("row", "_row")
    return scored.join(drawn, F.col("row") == F.col("_row"), "left").select("doc_id", "n_features", "weight", "score", "rank")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
