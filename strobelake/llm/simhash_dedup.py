"""SimHash near-duplicates by the generalised pigeonhole principle.

A document's fingerprint holds, for each of 64 bits, whether over half of its
shingle hashes set it. Bits that vary together form the partitions; each partition
i gets its own threshold t_i, with sum(t_i) = radius - partitions + 1 (t_i = -1:
not probed), so that two fingerprints within the radius agree up to t_i bits in at
least one partition. A dynamic program picks the cheapest thresholds from the
candidate counts estimated over all fingerprints, with the bits' joint counts.

Defined cases: a null text counts as empty; documents without words have
fingerprint zero and are linked like any other; repeated rows and equal
fingerprints form one class; a null doc_id keeps its row and takes part in its
class, whose component is the smallest doc_id that is not null; very long texts are read whole;
bytes that are no UTF-8 count as U+FFFD; an empty table gives an empty result; other columns are
ignored, whatever their names. Of each class ``one_of_each`` keeps the row with the smallest doc_id, of
several texts under it the one with the least hash, of rows that repeat both one, and every row without doc_id.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce
from itertools import accumulate, combinations
from math import comb, exp, lgamma

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strobelake.llm.common import columns_of, connected_components, fresh_names, materialize, release, table
from strobelake.llm.pieces import text_blocks

BITS = 64
BLOCK_BYTES = 2_000_000
#: Relative cost of a probe key (it is shuffled and sorted) and of a candidate (one comparison in the join).
KEY_COST, CANDIDATE_COST = 1.0, 0.05
_BYTE_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)


def fingerprint(text: bytes, width: int = 4, seed: int = 42) -> int:
    """The unsigned 64-bit SimHash of one UTF-8 text."""
    words = text.lower().split()
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    joined = b" ".join(words)
    if len(words) <= width:
        return digest(joined, seed)
    ends = list(accumulate(len(w) + 1 for w in words))
    starts = [0, *ends]
    hashes = np.array([digest(joined[s : e - 1], seed) for s, e in zip(starts, ends[width - 1 :])], dtype=np.uint64)
    octets = hashes.astype("<u8").view(np.uint8).reshape(-1, 8)
    if len(hashes) < 256:
        ones = np.unpackbits(octets, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    else:
        ones = np.concatenate([np.bincount(octets[:, k], minlength=256) @ _BYTE_BITS for k in range(8)])
    return int.from_bytes(np.packbits(2 * ones > len(hashes), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, width: int = 4, seed: int = 42) -> DataFrame:
    """(doc_id, fp, text_hash) with fp as a signed long; rows with one doc_id and text_hash are one document."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, texts in text_blocks(batch.column(1), BLOCK_BYTES):
                found = np.array([fingerprint(t, width, seed) for t in texts], dtype=np.uint64)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, high - low), pa.array(found.view(np.int64)), batch.column(2).slice(low, high - low)], names=["doc_id", "fp", "text_hash"])
        release()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("text_hash", F.xxhash64("text"))
    return rows.mapInArrow(run, "doc_id long, fp long, text_hash long")


def bit_counts(prints: DataFrame) -> tuple[int, np.ndarray]:
    """How many fingerprints there are, and the 64 x 64 counts of bits set together, over all of them."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((BITS, BITS), dtype=np.int64)
        n = 0
        for batch in batches:
            octets = batch.column(0).to_numpy(zero_copy_only=False).astype("<i8").view(np.uint8).reshape(-1, 8)
            bits = np.unpackbits(octets, axis=1, bitorder="little").astype(np.float32)
            total += np.rint(bits.T @ bits).astype(np.int64)
            n += len(bits)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(BITS * BITS + 1)), pa.array(np.append(total.ravel(), n))], names=["at", "n"])

    rows = prints.select("fp").mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect()  # 4097 rows at any size
    flat = np.zeros(BITS * BITS + 1, dtype=np.int64)
    for r in rows:
        flat[r["at"]] = r["n"]
    return int(flat[-1]), flat[:-1].reshape(BITS, BITS)


def correlated_groups(n: int, together: np.ndarray, parts: int) -> list[list[int]]:
    """Deal the bits into groups of near equal size, each bit to the group it correlates with most."""
    p = np.diag(together) / max(n, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    phi = np.abs(together / max(n, 1) - np.outer(p, p)) / np.outer(spread, spread)
    np.fill_diagonal(phi, 0)
    left, groups = set(range(BITS)), []
    for k in range(parts):
        size = len(left) // (parts - k)
        group = [max(left, key=lambda b: (phi[b, list(left)].sum(), -b))]
        left -= {group[0]}
        while len(group) < size:
            b = max(left, key=lambda b: (phi[b, group].mean(), -b))
            group.append(b)
            left -= {b}
        groups.append(sorted(group))
    return groups


def distance_odds(n: int, together: np.ndarray, bits: list[int], most: int) -> np.ndarray:
    """P(two fingerprints differ in at most t of these bits), t = 0..most.

    The counts of bits set together give the exact mean and variance of that distance. Where the bits vary
    together its variance exceeds that of independent ones, and a beta-binomial with both moments serves.
    """
    q = together[np.ix_(bits, bits)] / max(n, 1)
    p = np.diag(q)
    both = 2 * (q * (1 - p[:, None] - p + q) + (p[:, None] - q) * (p - q))  # two fingerprints differ in either bit
    each, m = np.diag(both), len(bits)
    rate, variance = each.mean(), both.sum() - each.sum() ** 2
    alone = m * rate * (1 - rate)
    rho = min((variance / alone - 1) / (m - 1), 1 - 1e-6) if m > 1 and alone > 1e-12 else 0.0
    if rho > 1e-9:
        x, y = rate * (1 / rho - 1), (1 - rate) * (1 / rho - 1)
        beta = lambda u, v: lgamma(u) + lgamma(v) - lgamma(u + v)
        return np.cumsum([comb(m, k) * exp(beta(k + x, m - k + y) - beta(x, y)) if k <= m else 0.0 for k in range(most + 1)])
    odds = np.zeros(most + 1)
    odds[0] = 1
    for e in each:
        odds[1:] = odds[1:] * (1 - e) + odds[:-1] * e
        odds[0] *= 1 - e
    return np.cumsum(odds)


def allocate(n: int, together: np.ndarray, radius: int) -> tuple[float, list[tuple[list[int], int]]]:
    """(cost, [(bits, threshold)]): the cheapest number of partitions and thresholds."""
    best: tuple[float, list] = (float("inf"), [])
    for parts in range(2, radius + 2):
        groups = correlated_groups(n, together, parts)
        state: dict[int, tuple[float, tuple[int, ...]]] = {0: (0.0, ())}
        for bits in groups:
            odds, grown = distance_odds(n, together, bits, radius), {}
            for spent, (cost, chosen) in state.items():
                for t in range(-1, radius + 1):
                    keys = sum(comb(len(bits), j) for j in range(t + 1))
                    more = cost + (t >= 0) * (n * keys * KEY_COST + n * n / 2 * odds[max(t, 0)] * CANDIDATE_COST)
                    if more < grown.get(spent + t, (float("inf"),))[0]:
                        grown[spent + t] = (more, (*chosen, t))
            state = grown
        cost, chosen = state[radius - parts + 1]
        if cost < best[0]:
            best = (cost, [(bits, t) for bits, t in zip(groups, chosen) if t >= 0])
    return best


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def near_pairs(classes: DataFrame, plan: list[tuple[list[int], int]], radius: int, unlike: str | None = None) -> DataFrame:
    """(a, b), a < b: fingerprints at ``radius`` or fewer differing bits. ``unlike``: leave out pairs that agree in that column."""
    masks = [_signed(sum(1 << b for b in bits)) for bits, _ in plan]
    rest = [unlike] if unlike else []
    stored = F.array(*[F.struct(F.lit(i).alias("part"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for i, m in enumerate(masks)])
    index = classes.select("fp", *rest, F.explode(stored).alias("k")).select("k.*", F.col("fp").alias("b"), *[F.col(c).alias("class_b") for c in rest])

    def ball(i: int) -> object:
        bits, t = plan[i]
        flips = [_signed(sum(1 << b for b in some)) for j in range(t + 1) for some in combinations(bits, j)]
        return F.transform(F.array(*[F.lit(x).cast("long") for x in flips]), lambda x: F.struct(F.lit(i).alias("part"), F.col("fp").bitwiseAND(F.lit(masks[i])).bitwiseXOR(x).alias("key")))

    probes = classes.select("fp", *rest, F.explode(reduce(lambda x, y: F.concat(x, y), [ball(i) for i in range(len(plan))])).alias("k")).select("k.*", F.col("fp").alias("a"), *[F.col(c).alias("class_a") for c in rest])
    close = (F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius)
    if unlike:
        close = close & (F.col("class_a") != F.col("class_b"))
    return probes.alias("p").join(index.alias("i"), (F.col("p.part") == F.col("i.part")) & (F.col("p.key") == F.col("i.key")) & close).select("a", "b", *[f"class_{x}" for x in "ab" if unlike])


def pivot_links(classes: DataFrame, plan: list[tuple[list[int], int]], radius: int) -> DataFrame:
    """Links of each fingerprint with a few pivots of each of its partition buckets: as many rows as fingerprints, whatever a bucket holds."""
    masks = [_signed(sum(1 << b for b in bits)) for bits, _ in plan]
    keyed = classes.select("fp", "n", F.explode(F.array(*[F.struct(F.lit(i).alias("part"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for i, m in enumerate(masks)])).alias("k")).select("fp", "n", "k.*")
    pivots = keyed.groupBy("part", "key").agg(F.max_by("fp", F.struct("n", "fp")).alias("p0"), F.min("fp").alias("p1"), F.max("fp").alias("p2"), F.min_by("fp", F.xxhash64("fp")).alias("p3"), F.count("*").alias("m")).where("m > 1").drop("m")
    met = keyed.select("fp", "part", "key").join(pivots, ["part", "key"])
    near = F.filter(F.array("p0", "p1", "p2", "p3"), lambda q: (q != F.col("fp")) & (F.bit_count(q.bitwiseXOR(F.col("fp"))) <= radius))
    return met.select("fp", F.explode(F.array_distinct(near)).alias("b")).select(F.col("fp").alias("a"), "b").distinct()


def _grouped(docs: DataFrame, width: int, radius: int) -> tuple[DataFrame, DataFrame]:
    """(fingerprints of ``docs``, (fp, first): the least (doc_id, text_hash) of each fingerprint's component)."""
    prints = materialize(fingerprints(docs, width), "prints")
    least = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "text_hash")))
    classes = materialize(prints.groupBy("fp").agg(least.alias("first"), F.count("*").alias("n")), "print-classes")
    n, together = bit_counts(classes)
    _, plan = allocate(n, together, radius)
    first = connected_components(pivot_links(classes, plan, radius), "pivot-links")
    labelled = materialize(classes.join(first, classes.fp == first.id, "left").select("fp", "first", F.coalesce("component", "fp").alias("label")), "labelled")
    links = near_pairs(labelled.select("fp", "label"), plan, radius, unlike="label").select("class_a", "class_b").distinct()
    second = connected_components(links, "links")
    final = labelled.join(second, labelled.label == second.id, "left").select("fp", "first", F.coalesce("component", "label").alias("root"))
    lowest = final.groupBy("root").agg(F.min("first").alias("first"))
    return prints, final.select("fp", "root").join(lowest, "root").select("fp", "first")


def components(docs: DataFrame, width: int = 4, radius: int = 4) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of ``docs``."""
    prints, named = _grouped(docs, width, radius)
    return prints.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("first.doc_id").alias("component_id"))


def one_of_each(docs: DataFrame, width: int = 4, radius: int = 4) -> DataFrame:
    """One row of each group of near-duplicates, and all rows without doc_id."""
    prints, named = _grouped(docs, width, radius)
    known = prints.where("doc_id is not null")
    gone_id, gone_hash, own_hash = fresh_names(docs, "gone_id", "gone_hash", "own_hash")
    others = known.join(named, "fp").where(F.struct("doc_id", "text_hash") != F.col("first"))
    dropped = materialize(others.select(F.col("doc_id").alias(gone_id), F.col("text_hash").alias(gone_hash)).distinct(), "near-duplicates")
    repeated = materialize(known.groupBy(F.col("doc_id").alias(gone_id), F.col("text_hash").alias(gone_hash)).count().where("count > 1").select(gone_id, gone_hash), "repeated-rows")
    keyed = docs.withColumn(own_hash, F.xxhash64(F.col("text").cast("string")))
    same = (F.col("doc_id").cast("long") == F.col(gone_id)) & (F.col(own_hash) == F.col(gone_hash))
    kept = keyed.join(dropped, same, "left_anti")
    if repeated.isEmpty():
        return kept.select(*columns_of(docs))
    more = kept.join(repeated, same, "left_semi").dropDuplicates(["doc_id", own_hash])
    return kept.join(repeated, same, "left_anti").unionByName(more).select(*columns_of(docs))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components(table(spark, sf_dir, "documents"))
