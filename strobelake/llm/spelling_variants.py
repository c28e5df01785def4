"""Spelling variants: words one edit apart, found by two-dimensional range reporting.

Words are counted over whole texts. The pairs that differ by one inserted, deleted or replaced code point agree before
the edit and after it. Words of one length stand in forward order and in reverse order; what begins like a word
is an interval of the one, what ends like it an interval of the other, and a wavelet tree over the reverse ranks in
forward order reports the words in both, for each place of the edit.

The edit lies in one half of the longer word, and the other half is untouched: words meet in a task by that half, so
that no word is compared with all others. A half that too many words share is refined: the
segment that holds the edit is halved until few rows share a key, at the least a single place, which at most an alphabet can fill.
Every pair is reported once, in the segment of its last possible place.

A word's form is the near word that is most frequent, if it is frequent enough; roots follow forms by doubling.

Defined cases: null and empty texts have no words; bytes that are no UTF-8 count as U+FFFD, which is no letter; a null doc_id is
spelt as nothing before the colon of the hash; rows that repeat count each time; very long texts and words are read whole;
words of equal counts are taken in code-point order; an empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strobelake.llm.common import materialize, release, table
from strobelake.llm.pieces import distinct_pieces, joined, text_blocks

BLOCK_BYTES = 2_000_000
#: Entries and bytes of words that a task counts before it passes them on.
HELD_WORDS, HELD_BYTES = 100_000, 16 << 20
#: Rows that may share a key before its segment is halved, rows and bytes of a task, and values worked on at once.
KEY_ROWS, TASK_ROWS, TASK_BYTES, TOGETHER = 20_000, 300_000, 16 << 20, 2_000_000
#: Words up to so many bytes are hashed by the tables of ``_shifts``.
SHORT = 64


# --- words and their counts -----------------------------------------------------------

_LETTER = np.zeros(256, dtype=bool)
_LETTER[[*range(65, 91), *range(97, 123), 0xC3]] = True  # U+00C0 to U+00FF are the byte C3 and one more
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def letter_runs(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) of the maximal runs of letters in UTF-8 texts laid end to end."""
    inside = _LETTER[data]
    inside[1:] |= data[:-1] == 0xC3
    first = np.zeros(len(data) + 1, dtype=bool)
    first[bounds] = True  # a text ends where the next begins
    begin = inside.copy()
    begin[1:] &= ~inside[:-1] | first[1:-1]
    end = inside.copy()
    end[:-1] &= ~inside[1:] | first[1:-1]
    return np.flatnonzero(begin), np.flatnonzero(end) + 1


def _shifts() -> np.ndarray:
    """For each length up to ``SHORT``, what so many more bytes make of each byte of a CRC: crc(a + b) is the shifted crc(a) xor crc(b)."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> np.uint32(1)) ^ np.uint32(0xEDB88320), table >> np.uint32(1))
    out = np.zeros((SHORT + 1, 4, 256), dtype=np.uint32)
    values = np.stack([np.arange(256, dtype=np.uint32) << np.uint32(8 * k) for k in range(4)])
    for length in range(SHORT + 1):
        out[length] = values
        values = (values >> np.uint32(8)) ^ table[values & np.uint32(255)]
    return out


_SHIFTS = _shifts()


def prefixed_crcs(prefixes: list[bytes], words: list[bytes], owner: np.ndarray, index: np.ndarray) -> np.ndarray:
    """The unsigned CRC-32 of prefixes[owner] + words[index], pair by pair."""
    before = np.array([zlib.crc32(p) for p in prefixes], dtype=np.uint32)[owner]
    sizes, own = np.array([len(w) for w in words], dtype=np.int64), np.array([zlib.crc32(w) for w in words], dtype=np.uint32)
    size = sizes[index]
    near = np.minimum(size, SHORT)
    out = own[index]
    for k in range(4):
        out = out ^ _SHIFTS[near, k, (before >> np.uint32(8 * k)) & np.uint32(255)]
    for at in np.flatnonzero(size > SHORT).tolist():
        out[at] = zlib.crc32(words[index[at]], zlib.crc32(prefixes[owner[at]]))
    return out


def counted_words(texts: list[bytes], ids: list[int | None], least: int, one_in: int) -> Iterator[tuple[bytes, int]]:
    """(word, how often) of a block of texts; of one run in ``one_in``, by a hash of doc_id and run, a code point is left out."""
    data, bounds = joined(texts)
    if not len(data):
        return
    lower = _LOWER[data]
    starts, ends = letter_runs(lower, bounds)
    points = np.append(0, np.cumsum(lower != 0xC3))
    long = points[ends] - points[starts] >= least
    starts, ends = starts[long], ends[long]
    if not len(starts):
        return
    index, words = distinct_pieces(lower, starts, ends)
    owner = np.searchsorted(bounds, starts, side="right") - 1
    h = prefixed_crcs([b"%s:" % (b"" if i is None else b"%d" % i) for i in ids], words, owner, index)
    hit = h % np.uint32(one_in) == 0
    for word, n in zip(words, np.bincount(index[~hit], minlength=len(words)).tolist()):
        if n:
            yield word, n
    for k, crc in zip(index[hit].tolist(), h[hit].tolist()):
        run = words[k].decode()
        at = crc % len(run)
        if len(run) > least:
            yield (run[:at] + run[at + 1 :]).encode(), 1


def word_counts(docs: DataFrame, least_length: int = 6, least_count: int = 5, one_in: int = 199) -> DataFrame:
    """(word, n), written: the words of at least so many code points that occur so often over all texts."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[bytes] = Counter()
        size = 0

        def rows() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([w.decode() for w in held], pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])

        for batch in batches:
            ids = batch.column(0).to_pylist()
            for low, high, texts in text_blocks(batch.column(1), BLOCK_BYTES):
                for word, n in counted_words(texts, ids[low:high], least_length, one_in):
                    size += len(word) * (word not in held)
                    held[word] += n
                if len(held) > HELD_WORDS or size > HELD_BYTES:
                    yield rows()
                    held, size = Counter(), 0
        if held:
            yield rows()
        release()

    counts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "word string, n long")
    return materialize(counts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count), "word-counts")


# --- range reporting ------------------------------------------------------------------


class WaveletTree:
    """Which of the values at places lo to hi - 1 are in a range of values; the values are 0 to n - 1, each once."""

    def __init__(self, values: np.ndarray):
        self.n, self.zeros = len(values), []
        for bit in range(max(1, (self.n - 1).bit_length()) - 1, -1, -1):
            low = (values >> bit) & 1 == 0
            self.zeros.append(np.concatenate([[0], np.cumsum(low)]).astype(np.int32))
            values = np.concatenate([values[low], values[~low]])

    def report(self, lo: np.ndarray, hi: np.ndarray, least: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, value) for each value at places lo to hi - 1 of a query that is in least to end - 1."""
        query, value = np.flatnonzero(hi > lo), np.zeros(int((hi > lo).sum()), dtype=np.int64)
        lo, hi = lo[query].astype(np.int64), hi[query].astype(np.int64)
        for level, zeros in enumerate(self.zeros):
            half = 1 << (len(self.zeros) - 1 - level)
            a, b, count = zeros[lo].astype(np.int64), zeros[hi].astype(np.int64), int(zeros[-1])
            left = (b > a) & (value < end[query]) & (value + half > least[query])
            right = (hi - b > lo - a) & (value + half < end[query]) & (value + 2 * half > least[query])
            lo, hi = np.concatenate([a[left], count + (lo - a)[right]]), np.concatenate([b[left], count + (hi - b)[right]])
            query, value = np.concatenate([query[left], query[right]]), np.concatenate([value[left], value[right] + half])
        return query, value


def intervals(ordered: np.ndarray, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, end) by depth and query: the rows of a sorted matrix of letters that begin with so many letters of the query."""
    depth, m = min(ordered.shape[1], queries.shape[1]), len(queries)
    first, end = np.zeros((depth + 1, m), dtype=np.int32), np.zeros((depth + 1, m), dtype=np.int32)
    end[0] = len(ordered)
    group, alive, at = np.zeros(len(ordered), dtype=np.int64), np.arange(m), np.zeros(m, dtype=np.int64)
    for k in range(depth):
        key = group * 256 + ordered[:, k]
        begin = np.concatenate([[0], np.flatnonzero(key[1:] != key[:-1]) + 1, [len(key)]])
        known, wanted = key[begin[:-1]], at * 256 + queries[alive, k]
        place = np.minimum(np.searchsorted(known, wanted), len(known) - 1)
        met = known[place] == wanted
        alive, at = alive[met], place[met]
        if not len(alive):
            break
        first[k + 1, alive], end[k + 1, alive] = begin[at], begin[at + 1]
        group = np.repeat(np.arange(len(known)), np.diff(begin))
    return first, end


def _letters(words: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(words), dtype=np.uint8).reshape(len(words), -1)


def _order(letters: np.ndarray) -> np.ndarray:
    letters = np.ascontiguousarray(letters)
    return np.argsort(letters.view(f"S{letters.shape[1]}")[:, 0], kind="stable")


class Words:
    """Words of one length (a byte a code point, U+00C0 to U+00FF as they are in Latin-1) for range reporting."""

    def __init__(self, counts: dict[bytes, int]):
        words, n = list(counts), np.array(list(counts.values()), dtype=np.int64)
        letters = _letters(words)
        order = _order(letters)
        self.letters, self.n = letters[order], n[order]
        backward = self.letters[:, ::-1]
        self.by_end = _order(backward)
        self.backward = np.ascontiguousarray(backward[self.by_end])
        rank = np.empty(len(order), dtype=np.int64)
        rank[self.by_end] = np.arange(len(order))
        self.tree = WaveletTree(rank)

    def near(self, queries: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, word): words of this length that a replaced code point makes of a query as long, or an inserted one of a query that is shorter by one, at a place from low to high - 1."""
        length, size = self.letters.shape[1], queries.shape[1]
        first, end = intervals(self.letters, queries)
        least, most = intervals(self.backward, np.ascontiguousarray(queries[:, ::-1]))
        query = np.repeat(np.arange(len(queries)), high - low)
        place = np.arange(len(query)) - np.repeat(np.cumsum(high - low) - high, high - low)
        a, b = first[place, query], end[place, query]
        c, d = least[length - 1 - place, query], most[length - 1 - place, query]
        some = np.flatnonzero((b > a) & (d > c))
        hit, value = self.tree.report(a[some], b[some], c[some], d[some])
        query, place, word = query[some][hit], place[some][hit], self.by_end[value]
        last = (place >= size) | (self.letters[word, place] != queries[query, np.minimum(place, size - 1)])
        return query[last], word[last]


def _best(owner: np.ndarray, n: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owner, rows of it, the row with its largest n, of ties the first in order)."""
    ranked = np.lexsort((order, -n, owner))
    owner = owner[ranked]
    begin = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]])) if len(owner) else np.zeros(0, dtype=np.int64)
    return owner[begin], np.diff(np.append(begin, len(owner))), ranked[begin]


# --- Spark ----------------------------------------------------------------------------


def _key(length: Column, low: Column, high: Column, word: Column, shorter: Column) -> Column:
    """A hash of what a word of ``length`` has outside its places low to high - 1; ``shorter`` is 1 for a word that lacks one of them."""
    return F.xxhash64(length, low, high, F.substring(word, F.lit(1), low), F.substring(word, high + 1 - shorter, F.length(word) + 1))


def _segments(rows: DataFrame, cuts: Column) -> DataFrame:
    """Rows (kind, length, word, n) once for each segment (low, high) of ``cuts`` in which an edit may lie, with its key."""
    shorter = (F.col("length") - F.length("word")).cast("int")
    each = rows.select("kind", "length", "word", "n", F.explode(cuts).alias("s")).select("kind", "length", F.col("s.low").alias("low"), F.col("s.high").alias("high"), "word", "n")
    return each.withColumn("key", _key(F.col("length"), F.col("low"), F.col("high"), F.col("word"), shorter))


def _halves(low: Column, high: Column) -> Column:
    middle = F.floor((low + high) / 2).cast("int")
    return F.array(F.struct(low.alias("low"), middle.alias("high")), F.struct(middle.alias("low"), high.alias("high")))


def meeting_rows(words: DataFrame, key_rows: int = KEY_ROWS) -> DataFrame:
    """(kind, length, low, high, word, n, key), written: words (kind 0) and queries (kind 1) that may be one edit apart share a key."""
    size = F.length("word")
    kinds = F.array(*[F.struct(F.lit(kind).alias("kind"), (size + more).alias("length")) for kind, more in ((0, 0), (1, 0), (1, 1))])
    rows = words.select("word", "n", F.explode(kinds).alias("k")).select("k.kind", "k.length", "word", "n")
    rows = materialize(_segments(rows, _halves(F.lit(0), F.col("length"))), "spelling-keys")
    while True:
        hot = rows.groupBy("key").agg(F.count("*").alias("many"), F.max(F.col("high") - F.col("low")).alias("places")).where((F.col("many") > key_rows) & (F.col("places") > 1))
        hot = materialize(hot.select("key"), "spelling-hot-keys")
        if hot.isEmpty():
            return rows
        wide = F.col("high") - F.col("low") > 1
        again = _segments(rows.where(wide).join(hot, "key", "left_semi"), _halves(F.col("low"), F.col("high")))
        rest = rows.join(hot, "key", "left_anti").unionByName(rows.where(~wide).join(hot, "key", "left_semi"))
        rows = materialize(rest.unionByName(again), "spelling-keys")


def near_counts(words: DataFrame, key_rows: int = KEY_ROWS) -> DataFrame:
    """(word, n_near, form_n, near) of the words (word, n) that have near ones: how many, and the most frequent with its count."""
    spark, rows = words.sparkSession, meeting_rows(words, key_rows)
    size = rows.agg(F.count("*"), F.coalesce(F.sum(F.length("word")), F.lit(0))).first()
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size[0] // TASK_ROWS), -(-size[1] // TASK_BYTES))

    def found(own: Words, batch: list[tuple[bytes, int, int, int]]) -> Iterator[pa.RecordBatch]:
        names = ["word", "n_near", "form_n", "near"]
        queries, n = _letters([b[0] for b in batch]), np.array([b[1] for b in batch], dtype=np.int64)
        low, high = (np.array([b[k] for b in batch], dtype=np.int64) for k in (2, 3))
        query, word = own.near(queries, low, high)
        if not len(query):
            return
        spelt = lambda letters, rows: pa.array([letters[r].tobytes().decode("latin-1") for r in rows.tolist()], pa.string())
        owner, many, best = _best(query, own.n[word], word)
        yield pa.RecordBatch.from_arrays([spelt(queries, owner), pa.array(many), pa.array(own.n[word[best]]), spelt(own.letters, word[best])], names=names)
        if queries.shape[1] < own.letters.shape[1]:  # what an insertion makes of one, a deletion undoes
            rank = np.argsort(_order(queries))
            owner, many, best = _best(word, n[query], rank[query])
            yield pa.RecordBatch.from_arrays([spelt(own.letters, owner), pa.array(many), pa.array(n[query[best]]), spelt(queries, query[best])], names=names)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[int, dict[bytes, int]] = {}
        tree: Words | None = None
        held: list[tuple[bytes, int, int, int]] = []
        now = (0, 0)
        for batch in batches:
            for kind, length, low, high, word, n in zip(*(batch.column(k).to_pylist() for k in range(6))):
                own = word.encode("latin-1")
                if kind == 0:
                    counts.setdefault(length, {})[own] = n
                elif length in counts:
                    if held and (now != (length, len(own)) or len(held) * length > TOGETHER):
                        yield from found(tree, held)
                        held = []
                    if tree is None or now[0] != length:  # queries come by length: one tree is held at a time
                        tree = Words(counts[length])
                    now = (length, len(own))
                    held.append((own, n, low, high))
        if held:
            yield from found(tree, held)
        release()

    # words come before the queries that ask for them
    dealt = rows.repartition(parts, "key").drop("key").withColumn("size", F.length("word")).sortWithinPartitions("kind", "length", "size").drop("size")
    partial = dealt.mapInArrow(run, "word string, n_near long, form_n long, near string")
    best = F.min(F.struct((-F.col("form_n")).alias("less"), F.col("near"))).alias("best")
    return partial.groupBy("word").agg(F.sum("n_near").alias("n_near"), best).select("word", "n_near", (-F.col("best.less")).alias("form_n"), F.col("best.near").alias("near"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) from (word, form), in which no word leads back to itself: pointers are doubled until none moves."""
    at = materialize(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        onward = at.select(F.col("word").alias("via"), F.col("root").alias("further"))
        moved = materialize(at.join(onward, at.root == onward.via, "left").select("word", F.coalesce("further", "root").alias("root"), F.col("via").isNotNull().alias("on")), "spelling-roots")
        if moved.where("on").isEmpty():
            return moved.select("word", "root")
        at = moved.select("word", "root")


def variants(docs: DataFrame, ratio: int = 5, least_length: int = 6, least_count: int = 5, one_in: int = 199, key_rows: int = KEY_ROWS) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word."""
    words = word_counts(docs, least_length, least_count, one_in)
    near = near_counts(words, key_rows)
    joined_ = words.join(near.withColumnRenamed("word", "_word"), F.col("word") == F.col("_word"), "left")
    frequent = F.col("form_n") >= ratio * F.col("n")
    rows = materialize(joined_.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(frequent, F.col("near")).alias("form"), F.when(frequent, F.col("form_n")).alias("form_n")), "spelling-forms")
    last = roots(rows.where("form is not null").select("word", "form")).withColumnRenamed("word", "_word")
    return rows.join(last, F.col("word") == F.col("_word"), "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(table(spark, sf_dir, "documents"))
