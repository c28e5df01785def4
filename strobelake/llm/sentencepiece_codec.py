"""SentencePiece ids by streaming Viterbi, and texts back from ids.

The lattice has an edge for each piece of the vocabulary (or single character). For a
byte-pair model an edge may follow another only if encoding the two pieces together
gives just these two; with that, each reachable position has exactly one best
predecessor and the path to the end is the library's own encoding. Positions that may
still be extended span no more than the longest piece. A back pointer is dropped once no
path from there leads back to it, and an id is committed once all paths do, so that
what is held is this window and the branches that have not met. Where no piece spans two
neighbouring characters all paths meet at
once, so texts are cut there and each distinct part is encoded once.

Defined cases: null and empty texts have no ids; a character that is no piece becomes
its UTF-8 bytes; the model marks spaces with U+2581, so that character comes back as
a space; ids outside the vocabulary raise an error; bytes that form no character decode
to U+FFFD; rows that repeat are encoded alike; very long texts are encoded whole; an empty
table gives an empty result; other columns are ignored, whatever their names, but for the names of
the output, which are refused; a model of another kind than byte pairs is refused.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strobelake.llm.common import release, table
from strobelake.llm.pieces import Memory, block_ranges, distinct_pieces, joined, spell, text_blocks

MODEL = public_tokenizers.path("piece_bpe_32k.model")
SPACE = "▁"
_MARK = SPACE.encode()
PIECE_ENTRIES, PIECE_LENGTH, PAIR_ENTRIES = 200_000, 48, 400_000
BLOCK_BYTES = 2_000_000


class Codec:
    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.vocab_size()
        self.byte = {int(model.id_to_piece(i)[3:5], 16): i for i in range(size) if model.is_byte(i)}
        plain = [i for i in range(size) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        self.ids = {model.id_to_piece(i): i for i in plain}
        self.scores = {model.id_to_piece(i): model.get_score(i) for i in plain}
        self.longest = max(map(len, self.ids))
        self.pairs: dict[int, bool] = {}
        self.names = {i: p for p, i in self.ids.items()}
        self.trie: dict = {}  # a node's children by character; its piece's id under the empty string
        for piece, i in self.ids.items():
            node = self.trie
            for c in piece:
                node = node.setdefault(c, {})
            node[""] = i
        self.memory = Memory(self._learn, PIECE_ENTRIES, PIECE_LENGTH)
        self.spelt = [b""] * size
        for piece, i in self.ids.items():
            self.spelt[i] = piece.replace(SPACE, " ").encode()
        for value, i in self.byte.items():
            self.spelt[i] = bytes([value])
        for i in range(size):
            if model.is_unknown(i):
                self.spelt[i] = " ⁇ ".encode()
        self.spelt_size = np.array([len(b) for b in self.spelt], dtype=np.int64)
        self.spelt_first = np.cumsum(self.spelt_size) - self.spelt_size
        self.spelt_flat = np.frombuffer(b"".join(self.spelt), dtype=np.uint8)
        spans = {p[k : k + 2] for p in self.ids for k in range(len(p) - 1)}
        inside = {c for p in self.ids if len(p) > 1 for c in p}
        self.alone = np.zeros(256, dtype=bool)  # ASCII in no longer piece
        self.alone[[c for c in range(128) if chr(c) not in inside and c != 32]] = True
        letters = [chr(c) for c in range(256) if chr(c).isascii() and chr(c).isalpha()]
        self.letter = np.zeros(256, dtype=bool)
        self.letter[[ord(c) for c in letters]] = True
        self.ends_word = np.zeros(256, dtype=bool)  # ASCII that no piece has after a letter
        self.ends_word[[c for c in range(33, 127) if not chr(c).isalpha() and not any(a + chr(c) in spans for a in letters)]] = True
        step = max(1, len(plain) // 500)
        trial = [model.id_to_piece(i) + model.id_to_piece(j) for i, j in zip(plain[::step], plain[::-step])]
        trial = [t.replace(SPACE, " ") for t in trial if not t.startswith(SPACE)]
        ids, sizes = self.encode([t.encode() for t in trial])
        if ids.tolist() != [i for own in model.encode(trial) for i in own]:
            raise ValueError(f"{path} is no byte-pair model that this codec encodes for")

    def merge(self, text: str) -> list[str]:
        """Byte-pair merging by score, the first of equals first; for two pieces at a time."""
        parts = list(text)
        while True:
            best, at = None, -1
            for k in range(len(parts) - 1):
                s = self.scores.get(parts[k] + parts[k + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, k
            if best is None:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def follows(self, a: int, b: int) -> bool:
        """Whether byte-pair encoding leaves piece b apart after piece a."""
        one, two = self.names[a], self.names[b]
        known = self.merge(one + two) == [one, two]
        if len(self.pairs) > PAIR_ENTRIES:
            self.pairs.clear()
        self.pairs[a << 20 | b] = known
        return known

    def viterbi(self, text: str, held: list[int] | None = None) -> Iterator[tuple[int | None, int, int]]:
        """(id, start, end) of the pieces of ``text``, each as soon as it is sure; the id is None for a character that is no piece.

        ``held`` collects how many back pointers are kept after each character.
        """
        trie, pairs, follows = self.trie, self.pairs, self.follows
        back: dict[int, tuple[int | None, int]] = {0: (None, 0)}  # position -> (piece that ends there, where it starts)
        heirs: dict[int, int] = {0: 0}  # how many positions point back to one
        heir: dict[int, int] = {0: 0}  # their sum: the position itself where there is one
        base, n = 0, len(text)
        for start in range(n):
            here = back.get(start)
            if here is None:
                continue
            before = here[0]
            node = trie.get(text[start])
            if node is None or "" not in node:  # no piece: nothing merges with it
                back[start + 1] = (None, start)
                heirs[start], heir[start], heirs[start + 1], heir[start + 1] = heirs[start] + 1, heir[start] + start + 1, 0, 0
            end = start + 1
            while node is not None:
                i = node.get("")
                if i is not None and end not in back:
                    known = True if before is None else pairs.get(before << 20 | i)
                    if known is None:
                        known = follows(before, i)
                    if known:
                        back[end] = (i, start)
                        heirs[start], heir[start], heirs[end], heir[end] = heirs[start] + 1, heir[start] + end, 0, 0
                if end == n:
                    break
                node = node.get(text[end])
                end += 1
            dead = start
            while not heirs[dead] and dead != base:  # no path goes on from here
                _, before_it = back.pop(dead)
                del heirs[dead], heir[dead]
                heirs[before_it] -= 1
                heir[before_it] -= dead
                dead = before_it
            while base <= start and heirs[base] == 1:  # all paths lead through one boundary
                to = heir[base]
                yield back[to][0], base, to
                del back[base], heirs[base], heir[base]
                base = to
            if held is not None:
                held.append(len(back))

    def _learn(self, parts: list[bytes]) -> dict[bytes, bytes]:
        out = {}
        for part in parts:
            ids: list[int] = []
            text = part.decode().replace(" ", SPACE)
            for i, start, end in self.viterbi(text):
                if i is None:
                    ids += [self.byte[b] for b in text[start:end].encode()]
                else:
                    ids.append(i)
            out[part] = np.array(ids, dtype="<i4").tobytes()
        return out

    def cuts(self, data: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Where parts begin: before spaces that follow others, around characters in no longer piece, after letters that no piece goes on from."""
        cut = np.zeros(len(data), dtype=bool)
        marked = np.zeros(len(data), dtype=bool)  # the last byte of a literal U+2581
        if len(data) > 2:
            marked[2:] = (data[:-2] == _MARK[0]) & (data[1:-1] == _MARK[1]) & (data[2:] == _MARK[2])
        alone = self.alone[data]
        whole = (data & 0xC0) != 0x80
        cut[1:] = ((data[1:] == 32) & (data[:-1] != 32) & ~marked[:-1]) | alone[1:] | (alone[:-1] & whole[1:]) | (self.letter[data[:-1]] & self.ends_word[data[1:]])
        cut[starts] = True
        return np.flatnonzero(cut)

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another, ids of each text)."""
        data, bounds = joined([b" " + t if t else b"" for t in texts])  # the model's own leading space
        starts = self.cuts(data, bounds[:-1][np.diff(bounds) > 0])
        owner = np.searchsorted(bounds, starts, side="right") - 1
        index, wanted = distinct_pieces(data, starts)
        return spell(index, self.memory.values(wanted), owner, len(texts))

    def decode(self, ids: np.ndarray, sizes: np.ndarray) -> list[str]:
        count = self.spelt_size[ids]
        spread = np.arange(int(count.sum()))
        raw = self.spelt_flat[spread + np.repeat(self.spelt_first[ids] - (np.cumsum(count) - count), count)].tobytes()
        ends = np.append(0, np.cumsum(count))[np.append(0, np.cumsum(sizes))]
        texts = [raw[a:b].decode("utf-8", "replace") for a, b in zip(ends, ends[1:])]
        return [t[1:] if t.startswith(" ") else t for t in texts]


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def _schema(frame: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in frame.schema.fields)


def crc32s(ids: np.ndarray, sizes: np.ndarray) -> list[int]:
    """The CRC-32 of each row's ids as little-endian unsigned 32-bit integers."""
    ends, raw = np.append(0, np.cumsum(sizes)), memoryview(np.ascontiguousarray(ids, dtype="<u4")).cast("B")
    return [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(ends, ends[1:])]


def encode(docs: DataFrame, keep: list[str], model: str = MODEL, digests: bool = False) -> DataFrame:
    """The columns ``keep`` and ids array<int> of each text; with ``digests`` also n_tokens and ids_crc32."""
    names = [*keep, "ids", *(["n_tokens", "ids_crc32"] if digests else [])]
    if len({n.lower() for n in names}) < len(names):
        raise ValueError(f"the columns {keep} clash with those of the result")
    chosen = docs.select(F.col("text").cast("string").alias("text"), *[F.col(f"`{c}`").alias(f"kept{k}") for k, c in enumerate(keep)])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model)
        for batch in batches:
            for low, high, texts in text_blocks(batch.column(0), BLOCK_BYTES):
                ids, sizes = own.encode(texts)
                lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32)), pa.array(ids))
                more = [pa.array(sizes, pa.int64()), pa.array(crc32s(ids, sizes), pa.int64())] if digests else []
                yield pa.RecordBatch.from_arrays([*batch.slice(low, high - low).columns[1:], lists, *more], names=names)
        release()

    return chosen.mapInArrow(run, f"{_schema(docs.select(*[F.col(f'`{c}`') for c in keep]))}, ids array<int>" + ", n_tokens long, ids_crc32 long" * digests)


def decode(tokens: DataFrame, keep: list[str], model: str = MODEL) -> DataFrame:
    """The columns ``keep`` and the text of each row's ids."""
    if "text" in map(str.lower, keep):
        raise ValueError("the result has a text of its own")
    chosen = tokens.select(F.col("ids"), *[F.col(f"`{c}`").alias(f"kept{k}") for k, c in enumerate(keep)])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model)
        for batch in batches:
            column = batch.column(0)
            lengths = np.diff(column.offsets.to_numpy()).astype(np.int64)
            for low, high in block_ranges(lengths, BLOCK_BYTES):
                part = column.slice(low, high - low)
                ids = part.flatten().to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays([*batch.slice(low, high - low).columns[1:], pa.array(own.decode(ids, lengths[low:high]), pa.string())], names=[*keep, "text"])

    return chosen.mapInArrow(run, f"{_schema(tokens.select(*[F.col(f'`{c}`') for c in keep]))}, text string")


def checked(tokens: DataFrame, model: str = MODEL) -> DataFrame:
    """(doc_id, n_tokens, ids_crc32, decoded_sha256, round_trip) from (doc_id, sha256, ids): the ids decoded, and whether the text has that digest."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model)
        for batch in batches:
            column = batch.column(2)
            lengths = np.diff(column.offsets.to_numpy()).astype(np.int64)
            for low, high in block_ranges(lengths, BLOCK_BYTES):
                ids = column.slice(low, high - low).flatten().to_numpy(zero_copy_only=False)
                crc = crc32s(ids, lengths[low:high])
                found = [hashlib.sha256(t.encode()).hexdigest() for t in own.decode(ids, lengths[low:high])]
                same = [a == b for a, b in zip(found, batch.column(1).slice(low, high - low).to_pylist())]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, high - low), pa.array(lengths[low:high]), pa.array(crc, pa.int64()), pa.array(found), pa.array(same)], names=["doc_id", "n_tokens", "ids_crc32", "decoded_sha256", "round_trip"])

    return tokens.select("doc_id", "sha256", "ids").mapInArrow(run, "doc_id long, n_tokens long, ids_crc32 long, decoded_sha256 string, round_trip boolean")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text encoded, its ids decoded and compared with it."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.sha2(F.translate(F.coalesce("text", F.lit("")), SPACE, " "), 256).alias("sha256"))
    return checked(encode(docs, ["doc_id", "sha256"]))
