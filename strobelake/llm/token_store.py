"""Token ids in ORC: sorted, integer-run-length coded, with row indexes and Bloom filters on doc_id.

Documents are range-partitioned and sorted by doc_id before they are encoded, so each
file holds one range of ids and each stripe's statistics bound them; a read with a
filter on doc_id skips files and stripes by their statistics and then by the Bloom
filters, and a full read splits files at stripes. Each row holds its offset within
its file, so that the offset in the whole corpus needs only one sum a file.

Ids are those of the tokenizers library as it is loaded: a text that holds one of the
tokenizer's added tokens, such as an end-of-text mark, is encoded whole by it.

Defined cases: a null text counts as empty and yields the end id alone; a null
doc_id sorts first; rows that repeat a doc_id are all kept, ordered by text; very long texts
are encoded whole, one at a time; an empty
table writes and returns nothing; bytes that are no UTF-8 count as U+FFFD; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strobelake.llm.common import new_path, table
from strobelake.llm.pieces import valid

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "part int, doc_id long, local_start long, n_tokens long, ids array<int>"
#: Pieces of text remembered with their ids in each Python worker, and the longest such piece.
CACHE_ENTRIES, CACHE_LENGTH = 500_000, 48

#: Kinds of bytes: ASCII white space, ASCII letters, other ASCII, and what starts and goes on Latin letters of two bytes.
_SPACE, _LETTER, _OTHER, _LEAD, _NEXT = 1, 2, 4, 8, 16
_KIND = np.zeros(256, dtype=np.uint8)
_KIND[:128] = _OTHER
_KIND[[9, 10, 11, 12, 13, 32]] = _SPACE
_KIND[[*range(65, 91), *range(97, 123)]] = _LETTER
_KIND[0xC3:0xCA] = _LEAD
_KIND[0x80:0xC0] = _NEXT


def cut_points(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Where pieces begin in texts laid end to end.

    Cuts only where the byte-level pre-tokenizer cuts whatever else the text holds: where
    white space begins; before the last of several white spaces, and after it unless it
    is a space; and after letters that other ASCII follows. Next to other white space or
    scripts there is no cut.
    """
    kind = _KIND[data]
    blank = kind == _SPACE
    latin = np.zeros(len(data), dtype=bool)
    latin[1:] = (kind[1:] == _NEXT) & (kind[:-1] == _LEAD)
    sign = np.zeros(len(data), dtype=bool)
    sign[1:] = (data[:-1] == 0xC3) & ((data[1:] == 0x97) | (data[1:] == 0xB7))
    solid = (kind & (_LETTER | _OTHER)).astype(bool) | latin
    letter = (kind == _LETTER) | (latin & ~sign)
    opens = (kind & (_LETTER | _OTHER | _LEAD)).astype(bool)
    before_open = np.zeros(len(data), dtype=bool)
    before_open[:-1] = opens[1:]
    before_open[ends[ends > starts] - 1] = False
    cut = np.zeros(len(data), dtype=bool)
    cut[1:] = (blank[1:] & solid[:-1]) | (blank[1:] & blank[:-1] & before_open[1:]) | (opens[1:] & blank[:-1] & (data[:-1] != 32)) | (letter[:-1] & (kind[1:] == _OTHER))
    cut[starts[ends > starts]] = True
    return np.flatnonzero(cut)


class Encoder:
    """The tokenizers library behind a bounded memory of pieces already encoded."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        own = json.loads(self.tokenizer.to_str())
        self.added = [t["content"].encode() for t in own["added_tokens"]]
        before = own["pre_tokenizer"] or {}
        #: Whether ``cut_points`` knows where this tokenizer cuts; else each text is one piece.
        self.cuttable = own["normalizer"] is None and before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space")
        self.known: dict[bytes, bytes] = {}
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.widths = np.zeros(max(vocabulary.values()) + 1, dtype=np.int64)  # bytes of each token, one character of its byte alphabet for each
        for token, i in vocabulary.items():
            self.widths[i] = len(token)

    def _learn(self, pieces: list[bytes]) -> dict[bytes, bytes]:
        """Ids of each piece. Words that begin with a space are encoded joined, for the pre-tokenizer cuts before that space."""
        joined = [p for p in pieces if self.cuttable and p[0] == 32 and len(p) > 1 and _KIND[p[1]] == _LETTER and _KIND[p[-1]] in (_LETTER, _OTHER) and not any(t in p for t in self.added)]
        alone = list(set(pieces).difference(joined))
        found = self.tokenizer.encode_batch_fast([p.decode() for p in alone], add_special_tokens=False)
        out = {p: np.array(e.ids, dtype="<i4").tobytes() for p, e in zip(alone, found)}
        groups = [joined[at : at + 256] for at in range(0, len(joined), 256)]
        for group, e in zip(groups, self.tokenizer.encode_batch_fast([b"".join(g).decode() for g in groups], add_special_tokens=False)):
            ids = np.array(e.ids, dtype="<i4")
            cuts = np.searchsorted(np.cumsum(self.widths[ids]), np.cumsum([len(p) for p in group])) + 1
            raw, low = ids.tobytes(), 0
            for piece, high in zip(group, (4 * cuts).tolist()):
                out[piece] = raw[low:high]
                low = high
        return out

    def _cuts(self, raw: pa.Array, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Where pieces begin; a text with an added token is a single piece."""
        starts = bounds[:-1][np.diff(bounds) > 0]
        if not self.cuttable:
            return starts
        cuts = cut_points(data, bounds[:-1], bounds[1:])
        whole = np.zeros(len(raw), dtype=bool)
        for token in self.added:
            whole |= pc.match_substring(raw, token).to_numpy(zero_copy_only=False)
        if not whole.any():
            return cuts
        return cuts[~whole[np.searchsorted(bounds, cuts, side="right") - 1] | np.isin(cuts, starts)]

    def encode(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another, each with ``end_id`` at its end; how many each text has)."""
        raw = valid(texts).cast(pa.binary()).fill_null(b"")
        raw = pa.concat_arrays([raw]) if raw.offset == 0 else pa.array(raw.to_pylist(), pa.binary())
        bounds = np.frombuffer(raw.buffers()[1], dtype=np.int32)[: len(raw) + 1].astype(np.int64)
        data = np.frombuffer(raw.buffers()[2] or b"", dtype=np.uint8)[: bounds[-1]]
        cuts = self._cuts(raw, data, bounds)
        owner = np.searchsorted(bounds, cuts, side="right") - 1
        offsets = np.append(cuts, len(data)).astype(np.int32)
        pieces = pa.Array.from_buffers(pa.binary(), len(cuts), [None, pa.py_buffer(offsets), pa.py_buffer(data)]).dictionary_encode()
        index, wanted = pieces.indices.to_numpy(), pieces.dictionary.to_pylist()
        known = self.known
        if len(known) > CACHE_ENTRIES:  # what this block uses again stays
            self.known = known = {p: known[p] for p in wanted if p in known}
        fresh = [p for p in wanted if p not in known]
        long = [p for p in fresh if len(p) > CACHE_LENGTH]
        known.update(self._learn([p for p in fresh if len(p) <= CACHE_LENGTH]))
        look = known if not long else known | self._learn(long)
        values = [look[p] for p in wanted]
        size = np.array([len(v) // 4 for v in values], dtype=np.int64)
        flat = np.frombuffer(b"".join(values), dtype="<i4")
        first = np.cumsum(size) - size
        count = size[index]
        total = int(count.sum())
        spread = np.arange(total)
        source = spread + np.repeat(first[index] - (np.cumsum(count) - count), count)
        out = np.full(total + len(raw), end_id, dtype=np.int32)
        out[spread + np.repeat(owner, count)] = flat[source]
        return out, np.bincount(owner, weights=count, minlength=len(raw)).astype(np.int64) + 1


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def write_tokens(docs: DataFrame, path: str, tokenizer: str = TOKENIZER, end_id: int = 0, stripe_bytes: int = 64 << 20, block_chars: int = 4_000_000) -> None:
    """Encode (doc_id, text), append ``end_id`` to each document, and write ORC in ascending doc_id order."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, start, own = TaskContext.get().partitionId(), 0, encoder(tokenizer)
        for batch in batches:
            low = 0
            lengths = np.cumsum(batch.column(2).to_numpy(zero_copy_only=False))
            while low < batch.num_rows:
                high = max(low + 1, int(np.searchsorted(lengths, (lengths[low - 1] if low else 0) + block_chars, side="right")))
                block = batch.slice(low, high - low)
                low = high
                ids, sizes = own.encode(block.column(1), end_id)
                starts = start + np.cumsum(sizes) - sizes
                start += int(sizes.sum())
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(sizes), part, dtype=np.int32)), block.column(0), pa.array(starts), pa.array(sizes), pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32)), pa.array(ids))], names=["part", "doc_id", "local_start", "n_tokens", "ids"])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    rows = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text").withColumn("n", F.coalesce(F.length("text"), F.lit(0)).cast("long"))
    options = {"compression": "zstd", "orc.stripe.size": str(stripe_bytes), "orc.row.index.stride": "1000", "orc.create.index": "true", "orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01", "orc.rows.between.memory.checks": "100"}
    rows.mapInArrow(run, SCHEMA).write.options(**options).orc(path)


def read_tokens(spark: SparkSession, path: str, doc_ids: list[int] | None = None) -> DataFrame:
    """(doc_id, start, n_tokens, ids); ``doc_ids`` reads only stripes that may hold them. start counts the ids of all documents before."""
    rows = spark.read.schema(SCHEMA).orc(path)
    sums = rows.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    base = sums.select("part", before.alias("base"))  # one row for each file written
    if doc_ids is not None:
        rows = rows.where(F.col("doc_id").isin(list(doc_ids)))
    return rows.join(F.broadcast(base), "part").select("doc_id", (F.col("base") + F.col("local_start")).alias("start"), "n_tokens", "ids")


def digests(tokens: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) from (doc_id, start, ids), the ids as little-endian unsigned 32-bit integers."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(2)
            ends = ids.offsets.to_numpy()
            raw = memoryview(ids.values.to_numpy(zero_copy_only=False).astype("<u4")).cast("B")
            crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(ends, ends[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.diff(ends).astype(np.int64)), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return tokens.select("doc_id", "start", "ids").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "tokens")
    write_tokens(table(spark, sf_dir, "documents"), path)
    return digests(read_tokens(spark, path))
