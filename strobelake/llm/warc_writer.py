"""A deterministic sharded WARC writer, and its reader.

Records are cut into shards by ranges of page_id whose bounds come from exact running
sums of their sizes, so the same rows give the same files, byte for byte. Each
task sorts its shards by page_id and streams gzip members (one for each record) into
files under temporary names, starting another when the compressed size is reached.
A task's files count only once its row of the manifest is committed: files are then
renamed, leftovers of failed attempts are deleted, and the manifest goes last.

Of pages with equal payloads, that with the smallest page_id is the response; the
others become revisit records without payload. Which is which travels to the writer
as small rows sorted in front of their pages, so that the payloads are shuffled once.

Defined cases: a null html is an empty payload; a null page_id sorts first and never
serves as the target of a revisit when a page with an id has the same payload; of
rows that repeat page_id and payload, one is the response and the others revisit it;
a null URL becomes ``urn:page:<id>``; other columns are ignored; an empty table writes
an empty manifest.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator
from urllib.parse import quote

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strobelake.llm.common import materialize, new_path, table

MANIFEST = "shard int, seq int, temporary string, name string, records long, bytes long, sha256 string"
#: Shards at most (they grow beyond that), and bytes that a record weighs besides its payload.
MAX_SHARDS, RECORD_BYTES = 16_384, 512
_DATE = "2000-01-01T00:00:00Z"
_BAD = re.compile(r"[\x00-\x20\x7f]")


def _b32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def shard_starts(keys: DataFrame, target: int) -> list[int]:
    """The first page_id of each shard.

    Pages in order of id are cut where the exact sum of their sizes passes a multiple of
    ``target``, whatever gaps the ids leave; at most MAX_SHARDS + 1 ids come to the driver.
    """
    sizes = keys.where("page_id is not null").groupBy("page_id").agg(F.sum(F.col("size") + RECORD_BYTES).alias("w"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held = TaskContext.get().partitionId(), 0
        for batch in batches:
            w = batch.column(1).to_numpy()
            before = held + np.cumsum(w) - w
            held += int(w.sum())
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(w), part, dtype=np.int32)), batch.column(0), pa.array(before), batch.column(1)], names=["part", "page_id", "before", "w"])

    placed = materialize(sizes.repartitionByRange("page_id").sortWithinPartitions("page_id").mapInArrow(run, "part int, page_id long, before long, w long"), "warc-sums")
    sums = placed.groupBy("part").agg(F.sum("w").alias("n"))
    total = sums.agg(F.sum("n")).first()[0] or 0
    earlier = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    base = F.broadcast(sums.select("part", earlier.alias("base")))  # a row a partition
    step = F.lit(max(target, total // MAX_SHARDS + 1))
    cut = placed.join(base, "part").groupBy(F.floor((F.col("before") + F.col("base")) / step).alias("shard")).agg(F.min("page_id").alias("start"))
    return sorted(r["start"] for r in cut.collect())


def _record(kind: str, record_id: str, url: str, payload: bytes, digest: str, refers: str | None) -> bytes:
    fields = [("WARC-Type", kind), ("WARC-Record-ID", f"<{record_id}>"), ("WARC-Date", _DATE), ("WARC-Target-URI", url)]
    if kind == "response":
        head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
        block = head + payload
    else:
        fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", f"<{refers}>"), ("X-Payload-Length", str(len(payload)))]
        block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    fields += [("WARC-Payload-Digest", f"sha1:{digest}"), ("WARC-Block-Digest", f"sha1:{_b32(hashlib.sha1(block).digest())}"), ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n" + block + b"\r\n\r\n"


def _member(record: bytes, level: int) -> bytes:
    pack = zlib.compressobj(level, zlib.DEFLATED, 31)
    return pack.compress(record) + pack.flush()


class _File:
    """One WARC file under a temporary name."""

    def __init__(self, fs: pyarrow.fs.FileSystem, root: str, shard: int, seq: int, level: int):
        self.shard, self.seq, self.name = shard, seq, f"pages-{shard:06d}-{seq:05d}.warc.gz"
        self.temporary = f"_tmp/{self.name}.{uuid.uuid4().hex}"
        self.out, self.sha, self.bytes, self.records = fs.open_output_stream(f"{root}/{self.temporary}"), hashlib.sha256(), 0, 0
        info = f"format: WARC File Format 1.1\r\nfilename: {self.name}\r\n".encode()
        head = f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:file:{self.name}>\r\nWARC-Date: {_DATE}\r\nWARC-Filename: {self.name}\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(info)}\r\n\r\n".encode()
        self.write(_member(head + info + b"\r\n\r\n", level))

    def write(self, member: bytes) -> None:
        self.out.write(member)
        self.sha.update(member)
        self.bytes += len(member)

    def close(self) -> dict:
        self.out.close()
        return {"shard": self.shard, "seq": self.seq, "temporary": self.temporary, "name": self.name, "records": self.records, "bytes": self.bytes, "sha256": self.sha.hexdigest()}


def write_warc(pages: DataFrame, uri: str, roll_bytes: int = 16 << 20, shard_bytes: int = 64 << 20, min_bytes: int = 0, level: int = 4) -> DataFrame:
    """Write a record for each row of (page_id, url, html) under ``uri`` and return the manifest, one row a file.

    ``uri`` is a folder that all executors reach, in a scheme that pyarrow.fs opens.
    ``shard_bytes`` of records go to a shard; payloads under ``min_bytes`` are never revisits.
    """
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    size = F.octet_length("html").cast("long")
    keys = materialize(rows.select("page_id", F.sha1(F.col("html").cast("binary")).alias("digest"), size.alias("size")), "warc-keys")
    starts = np.array(shard_starts(keys, shard_bytes) or [0], dtype=np.int64)

    @F.arrow_udf("int")
    def place(ids: pa.Array) -> pa.Array:
        at = np.searchsorted(starts, ids.fill_null(int(starts[0])).to_numpy(zero_copy_only=False), side="right") - 1
        return pa.array(at.astype(np.int32))

    first = keys.where(F.col("size") >= min_bytes).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    roles = keys.select("page_id", "digest").distinct().join(first, "digest").select("page_id", F.lit(0).alias("kind"), F.lit(None).cast("string").alias("url"), F.unhex("digest").alias("data"), "first")
    every = roles.unionByName(rows.select("page_id", F.lit(1).alias("kind"), "url", F.col("html").cast("binary").alias("data"), F.lit(None).cast("long").alias("first")))
    every = every.withColumn("shard", place("page_id"))
    parts = len(starts)  # a task a shard

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pyarrow.fs.FileSystem.from_uri(uri)
        fs.create_dir(f"{root}/_tmp", recursive=True)
        file, page, seen, met, done = None, object(), {}, {}, []
        for batch in batches:
            for shard, page_id, kind, url, data, target in zip(*(c.to_pylist() for c in batch.columns)):
                if page_id != page:
                    page, seen, met = page_id, {}, {}
                if kind == 0:
                    seen[data] = target
                    continue
                if file is None or file.shard != shard or file.bytes >= roll_bytes:
                    seq = file.seq + 1 if file is not None and file.shard == shard else 0
                    if file is not None:
                        done.append(file.close())
                    file = _File(fs, root, shard, seq, level)
                digest = hashlib.sha1(data).digest()
                own = "null" if page_id is None else str(page_id)
                copy = met[digest] = met.get(digest, -1) + 1
                refers = None
                if digest in seen and (seen[digest] != page_id or copy):
                    refers = f"urn:page:{'null' if seen[digest] is None else seen[digest]}"
                record_id = f"urn:page:{own}" + (f":{sum(met.values()) + len(met) - 1}" if len(met) > 1 or copy else "")
                address = f"urn:page:{own}" if url is None else _BAD.sub(lambda m: quote(m[0]), url)
                file.write(_member(_record("revisit" if refers else "response", record_id, address, data, _b32(digest), refers), level))
                file.records += 1
        if file is not None:
            done.append(file.close())
        if done:
            yield pa.RecordBatch.from_pylist(done, schema=pa.schema([("shard", pa.int32()), ("seq", pa.int32()), ("temporary", pa.string()), ("name", pa.string()), ("records", pa.int64()), ("bytes", pa.int64()), ("sha256", pa.string())]))

    sorted_rows = every.repartitionById(parts, "shard").sortWithinPartitions("shard", "page_id", "kind", "data", "url").select("shard", "page_id", "kind", "url", "data", "first")
    written = materialize(sorted_rows.mapInArrow(run, MANIFEST), "warc-written")
    return _commit(written, uri)


def _commit(written: DataFrame, uri: str) -> DataFrame:
    """Rename what the manifest names, see that each file has its size, then write the manifest. Doing it again changes nothing."""

    def rename(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pyarrow.fs.FileSystem.from_uri(uri)
        for batch in batches:
            for temporary, name in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                if fs.get_file_info(f"{root}/{temporary}").type == pyarrow.fs.FileType.File:
                    fs.move(f"{root}/{temporary}", f"{root}/{name}")
            for name, size in zip(batch.column(3).to_pylist(), batch.column(5).to_pylist()):
                found = fs.get_file_info(f"{root}/{name}")
                if found.type != pyarrow.fs.FileType.File or found.size != size:
                    raise OSError(f"{name} is not there with its {size} bytes")
            yield batch

    path = f"{uri}/manifest.parquet"
    written.mapInArrow(rename, MANIFEST).write.mode("overwrite").parquet(path)
    fs, root = pyarrow.fs.FileSystem.from_uri(uri)
    if fs.get_file_info(f"{root}/_tmp").type == pyarrow.fs.FileType.Directory:
        fs.delete_dir(f"{root}/_tmp")
    return written.sparkSession.read.schema(MANIFEST).parquet(path)


def _members(stream: pa.NativeFile, chunk: int = 1 << 20) -> Iterator[bytes]:
    """Each gzip member of a file, one at a time."""
    unpack, parts = zlib.decompressobj(31), []
    while data := stream.read(chunk):
        while data:
            parts.append(unpack.decompress(data))
            data = unpack.unused_data
            if unpack.eof:
                yield b"".join(parts)
                unpack, parts = zlib.decompressobj(31), []
    if any(parts):
        raise ValueError("a WARC file ends within a record")


def read_warc(manifest: DataFrame, uri: str, with_payload: bool = False) -> DataFrame:
    """(page_id, url, payload_bytes, payload_digest, record_type, refers_to[, payload]) of every record in the manifest's files."""
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"] + ["payload"] * with_payload
    types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()] + [pa.binary()] * with_payload

    def page(urn: bytes) -> int | None:
        own = urn.decode().strip("<>").split(":")[2]
        return None if own == "null" else int(own)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pyarrow.fs.FileSystem.from_uri(uri)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                rows: list[tuple] = []
                with fs.open_input_stream(f"{root}/{name}", compression=None) as stream:
                    for record in _members(stream):
                        head, _, rest = record.partition(b"\r\n\r\n")
                        fields = dict(line.split(b": ", 1) for line in head.split(b"\r\n")[1:])
                        if not head.startswith(b"WARC/") or b"Content-Length" not in fields:
                            raise ValueError(f"{name}: no WARC record")
                        block = rest[: int(fields[b"Content-Length"])]
                        kind = fields[b"WARC-Type"].decode()
                        if kind == "warcinfo":
                            continue
                        payload = block.partition(b"\r\n\r\n")[2]
                        digest = fields[b"WARC-Payload-Digest"].decode().removeprefix("sha1:")
                        if kind == "response" and _b32(hashlib.sha1(payload).digest()) != digest or "sha1:" + _b32(hashlib.sha1(block).digest()) != fields[b"WARC-Block-Digest"].decode():
                            raise ValueError(f"{name}: a digest does not match its record")
                        length = len(payload) if kind == "response" else int(fields[b"X-Payload-Length"])
                        refers = page(fields[b"WARC-Refers-To"]) if kind == "revisit" else None
                        rows.append((page(fields[b"WARC-Record-ID"]), fields[b"WARC-Target-URI"].decode(), length, digest, kind, refers, payload)[: len(names)])
                        if len(rows) == (64 if with_payload else 4096):
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)
                            rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    files = max(1, manifest.count())
    spread = manifest.select("name").repartition(min(files, 10_000))
    return spread.mapInArrow(run, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * with_payload)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    uri = new_path(spark, "warc")
    manifest = write_warc(table(spark, sf_dir, "pages"), uri)
    return read_warc(manifest, uri).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = r"""
WITH digests AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex FROM pages),
spelt AS (
    SELECT page_id, strlen(html)::BIGINT AS payload_bytes, hex,
        array_to_string(list_transform(range(8), lambda i: array_to_string(list_transform(range(4), lambda j:
            substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(hex, (5 * i + 1)::INT, 5))::INT >> (15 - 5 * j)::INT) & 31) + 1, 1)), '')), '') AS payload_digest
    FROM digests),
firsts AS (SELECT *, min(page_id) OVER (PARTITION BY hex) AS first, row_number() OVER (PARTITION BY hex ORDER BY page_id) AS k FROM spelt)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN k = 1 THEN 'response' ELSE 'revisit' END AS record_type,
    CASE WHEN k > 1 THEN first END AS refers_to
FROM firsts
"""
