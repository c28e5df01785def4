"""Frame and flow files as a data source: ``spark.read.format("array_files")`` and ``df.write.format("array_files")``.

Reading lists names on the driver, deals them to tasks by bytes, and each task opens its own files, so pixels
are never shuffled. Conditions on seq and idx are pushed: folders of other sequences are not listed, other files not opened.
Without ``pixels`` only headers are read.

Writing follows a commit protocol. A task writes under ``_staging/<run>/<attempt>`` and a list of its files beside them; its
message names that list. Once all tasks are done the driver holds the lists together (gaps, sequences that are there already),
moves the files to their places and writes the run's manifest, last and by one rename. A task or a commit that fails leaves nothing:
what was moved goes back, and the staging folder is deleted. Units, pixel sizes and height scales are in the manifest.

Options: path; channels (1: frames, 2: flows); subpath; pixels (true); committed (false: every file; true: what manifests name);
task_bytes; suffix of names that are written.
"""

from __future__ import annotations

import contextlib
import time
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet
from pyspark.sql import SparkSession
from pyspark.sql import datasource as ds
from pyspark.sql import types as T

from strobelake.sources.files import described, file_number, npy_bytes, read_head

#: Bytes and files of a read task, and bytes of a batch that it passes on.
TASK_BYTES, TASK_FILES, BATCH_BYTES = 64 << 20, 4096, 16 << 20
_HEAD = "seq string, idx int, source_name string, height int, width int, dtype string, fault string, unit string, pixel_size double, height_scale double"
_COMPARE = {ds.EqualTo: lambda a, b: a == b, ds.GreaterThan: lambda a, b: a > b, ds.GreaterThanOrEqual: lambda a, b: a >= b, ds.LessThan: lambda a, b: a < b, ds.LessThanOrEqual: lambda a, b: a <= b, ds.In: lambda a, b: a in b}
_MANIFEST = pa.schema([("seq", pa.string()), ("idx", pa.int32()), ("name", pa.string()), ("bytes", pa.int64()), ("height", pa.int32()), ("width", pa.int32()), ("unit", pa.string()), ("pixel_size", pa.float64()), ("height_scale", pa.float64()), ("ordinal", pa.int64())])


@dataclass
class Files(ds.InputPartition):
    """Files of one task: (seq, idx, name, path in the file system, bytes, unit, pixel_size, height_scale)."""

    rows: list[tuple]


class Place:
    """The root of a data set and its file system."""

    def __init__(self, options: dict):
        if not options.get("path"):
            raise ValueError("array_files needs a path")
        self.uri, self.subpath = options["path"].rstrip("/"), (options.get("subpath") or "").strip("/")
        self.channels = int(options.get("channels", 1))
        if self.channels not in (1, 2):
            raise ValueError(f"channels is 1 for frames or 2 for flows, not {self.channels}")

    def open(self) -> tuple[pyarrow.fs.FileSystem, str]:
        return pyarrow.fs.FileSystem.from_uri(self.uri)

    def folder(self, base: str, seq: str) -> str:
        return "/".join(x for x in (base, seq, self.subpath) if x)

    def manifests(self, fs: pyarrow.fs.FileSystem, base: str) -> dict[str, pa.Table]:
        """The newest list of each sequence that committed runs wrote."""
        found: dict[str, tuple[int, pa.Table]] = {}
        for info in fs.get_file_info(pyarrow.fs.FileSelector(f"{base}/_manifest", allow_not_found=True)):
            if not info.base_name.startswith(".") and info.base_name.endswith(".parquet"):
                rows = pyarrow.parquet.read_table(info.path, filesystem=fs).sort_by("seq")
                names = rows.column("seq").to_numpy(zero_copy_only=False)
                cuts = [0, *(np.flatnonzero(names[1:] != names[:-1]) + 1).tolist(), len(names)]
                for a, b in zip(cuts, cuts[1:]):
                    own, ordinal = rows.slice(a, b - a), rows.column("ordinal")[a].as_py()
                    if ordinal >= found.get(names[a], (0, None))[0]:
                        found[names[a]] = (ordinal, own)
        return {seq: rows for seq, (_, rows) in found.items()}


class ArrayReader(ds.DataSourceReader):
    def __init__(self, options: dict, schema: T.StructType):
        self.place, self.schema = Place(options), schema
        self.pixels = options.get("pixels", "true").lower() == "true"
        self.committed = options.get("committed", "false").lower() == "true"
        self.task_bytes = int(options.get("task_bytes", TASK_BYTES))
        self.tests: list[tuple[str, type, object]] = []

    def pushFilters(self, filters: list[ds.Filter]) -> Iterable[ds.Filter]:
        for f in filters:
            name = ".".join(getattr(f, "attribute", ()))
            if name in ("seq", "idx") and type(f) in _COMPARE:
                self.tests.append((name, type(f), f.value))
            elif name == "seq" and isinstance(f, ds.IsNotNull):
                continue
            else:
                yield f

    def _keeps(self, seq: str, idx: int | None) -> bool:
        return all((value := seq if name == "seq" else idx) is not None and _COMPARE[kind](value, wanted) for name, kind, wanted in self.tests)

    def _named(self) -> set[str] | None:
        """The only sequences that can pass, if conditions name them."""
        sets = [{w} if kind is ds.EqualTo else set(w) for name, kind, w in self.tests if name == "seq" and kind in (ds.EqualTo, ds.In)]
        return set.intersection(*sets) if sets else None

    def listed(self) -> Iterator[tuple]:
        """The rows of ``Files`` that pass, in no order."""
        fs, base = self.place.open()
        known, named = self.place.manifests(fs, base), self._named()
        facts = {seq: tuple(rows.column(c)[0].as_py() for c in ("unit", "pixel_size", "height_scale")) for seq, rows in known.items()}
        if self.committed:
            for seq, rows in known.items():
                if named is None or seq in named:
                    for idx, name, size in zip(*(rows.column(c).to_pylist() for c in ("idx", "name", "bytes"))):
                        if self._keeps(seq, idx):
                            yield (seq, idx, name, f"{self.place.folder(base, seq)}/{name}", size, *facts[seq])
            return
        tail = self.place.subpath
        tops = [base] if named is None else [self.place.folder(base, seq) for seq in sorted(named)]
        found: dict[str, list[pyarrow.fs.FileInfo]] = {}
        for top in tops:
            for info in fs.get_file_info(pyarrow.fs.FileSelector(top, recursive=True, allow_not_found=True)):
                parts = info.path[len(base) :].strip("/").split("/")
                if info.type != pyarrow.fs.FileType.File or not info.base_name.endswith(".npy") or any(p[:1] in "._" for p in parts):
                    continue
                folder = "/".join(parts[:-1])
                if tail and folder != tail and not folder.endswith("/" + tail):
                    continue
                found.setdefault(folder[: -len(tail)].rstrip("/") if tail else folder, []).append(info)
        for seq, infos in found.items():
            if tail and any("/".join(seq.split("/")[:k]) in found for k in range(seq.count("/") + 1) if seq):
                continue  # it lies inside a sequence
            for info in infos:
                idx = file_number(info.base_name)
                if (named is None or seq in named) and self._keeps(seq, idx):
                    yield (seq, idx, info.base_name, info.path, info.size, *facts.get(seq, (None, None, None)))

    def partitions(self) -> list[Files]:
        out, held, size = [], [], 0
        for row in sorted(self.listed(), key=lambda r: (r[0], r[1] if r[1] is not None else -1, r[2])):
            more = row[4] if self.pixels else 0
            if held and (size + more > self.task_bytes or len(held) >= TASK_FILES):
                out.append(Files(held))
                held, size = [], 0
            held.append(row)
            size += more
        return [*out, Files(held)] if held else out or [Files([])]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        fs, _ = self.place.open()
        columns = self.schema.names
        types = {"idx": pa.int32(), "height": pa.int32(), "width": pa.int32(), "pixel_size": pa.float64(), "height_scale": pa.float64(), **dict.fromkeys(("data", "dx", "dy"), pa.list_(pa.float32()))}
        held: list[dict] = []
        size = 0

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r.get(c) for r in held], types.get(c, pa.string())) for c in columns], names=columns)

        for seq, idx, name, path, length, unit, pixel_size, height_scale in partition.rows:
            with fs.open_input_stream(path, compression=None, buffer_size=0) as file:
                raw = file.read() if self.pixels else read_head(file)
            height, width, dtype, fault, data = described(raw, self.place.channels, self.pixels, length)
            row = dict(seq=seq, idx=idx, source_name=name, height=height, width=width, dtype=dtype, fault=fault, unit=unit, pixel_size=pixel_size, height_scale=height_scale)
            if data is not None and fault is None:
                row |= {"data": data} if self.place.channels == 1 else {"dx": data[: len(data) // 2], "dy": data[len(data) // 2 :]}
            held.append(row)
            size += len(raw) + 256
            if size >= BATCH_BYTES:
                yield batch()
                held, size = [], 0
        if held:
            yield batch()


@dataclass
class Written(ds.WriterCommitMessage):
    """The list of a task's files, and how many there are."""

    path: str
    files: int


class ArrayWriter(ds.DataSourceArrowWriter):
    def __init__(self, options: dict, schema: T.StructType, overwrite: bool):
        self.place, self.overwrite, self.run = Place(options), overwrite, uuid.uuid4().hex
        self.suffix = options.get("suffix", "_phase.npy" if self.place.channels == 1 else "_flow.npy")
        wanted = ["seq", "idx", "height", "width", *(["data"] if self.place.channels == 1 else ["dx", "dy"])]
        if missing := [c for c in wanted if c not in schema.names]:
            raise ValueError(f"array files need columns {', '.join(wanted)}; {', '.join(missing)} are missing")
        if not self.suffix.endswith(".npy") or "/" in self.suffix:
            raise ValueError(f"{self.suffix!r} is no suffix of an array file")

    def _staging(self, base: str) -> str:
        return f"{base}/_staging/{self.run}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        from strobelake.sinks.tables import check_name

        fs, base = self.place.open()
        own, rows, folders = f"{self._staging(base)}/{uuid.uuid4().hex}", [], set()
        channels = ["data"] if self.place.channels == 1 else ["dx", "dy"]
        for batch in iterator:
            at = {c: batch.schema.get_field_index(c) for c in batch.schema.names}
            for k in range(batch.num_rows):
                value = lambda c: batch.column(at[c])[k].as_py() if c in at else None  # noqa: B023, E731
                if any(not batch.column(at[c])[k].is_valid for c in channels):
                    continue  # a frame without value is left out
                seq, idx, height, width, unit = value("seq"), value("idx"), value("height"), value("width"), value("unit")
                field = np.stack([np.asarray(batch.column(at[c])[k].values, dtype=np.float64) for c in channels])
                if field.size != len(channels) * height * width:
                    raise ValueError(f"{seq}, frame {idx}: the data does not fill {height} x {width}")
                if unit == "nm":
                    field, unit = field * 1e-9, "m"
                with np.errstate(over="ignore"):
                    field = field.astype(np.float32).reshape(*([2] if len(channels) == 2 else []), height, width)
                if not np.isfinite(field).all():
                    raise ValueError(f"{seq}, frame {idx}: non-finite values")
                if (folder := f"{own}/{check_name(seq)}") not in folders:
                    fs.create_dir(folder, recursive=True)
                    folders.add(folder)
                raw = npy_bytes(field)
                with fs.open_output_stream(f"{folder}/{idx}.npy") as out:
                    out.write(raw)
                rows.append((seq, idx, f"{seq}/{idx}.npy", len(raw), height, width, unit, value("pixel_size"), value("height_scale"), 0))
        fs.create_dir(own, recursive=True)
        pyarrow.parquet.write_table(pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(list(zip(*rows)) or [[]] * len(_MANIFEST), _MANIFEST)], schema=_MANIFEST), f"{own}/files.parquet", filesystem=fs)
        return Written(own, len(rows))

    def commit(self, messages: list[Written | None]) -> None:
        fs, base = self.place.open()
        moved: list[tuple[str, str]] = []
        try:
            lists = [pyarrow.parquet.read_table(f"{m.path}/files.parquet", filesystem=fs).append_column("task", pa.array([m.path] * m.files)) for m in messages if m is not None and m.files]
            if not lists:
                raise ValueError("there is no array to write")
            rows = pa.concat_tables(lists)
            spans = rows.group_by("seq").aggregate([("idx", "min"), ("idx", "max"), ("idx", "count"), ("idx", "count_distinct")])
            first = dict(zip(spans.column("seq").to_pylist(), spans.column("idx_min").to_pylist()))
            torn = [s for s, a, b, n, d in zip(*(spans.column(c).to_pylist() for c in ("seq", "idx_min", "idx_max", "idx_count", "idx_count_distinct"))) if b - a + 1 != n or d != n]
            if torn:
                raise ValueError("a gap between frames, or frames twice: " + ", ".join(sorted(torn)[:5]))
            present = [s for s in sorted(first) if any(i.base_name.endswith(".npy") for i in fs.get_file_info(pyarrow.fs.FileSelector(self.place.folder(base, s), allow_not_found=True)))]
            if present and not self.overwrite:
                raise ValueError("already written: " + ", ".join(present[:5]))
            for seq in present:
                fs.create_dir(f"{self._staging(base)}/old/{seq}", recursive=True)
                moved.append(self._move(fs, self.place.folder(base, seq), f"{self._staging(base)}/old/{seq}/frames"))
            names = []
            for seq in sorted(first):
                fs.create_dir(self.place.folder(base, seq), recursive=True)
            for seq, idx, name, task in zip(*(rows.column(c).to_pylist() for c in ("seq", "idx", "name", "task"))):
                names.append(f"{idx - first[seq]:05d}{self.suffix}")
                moved.append(self._move(fs, f"{task}/{name}", f"{self.place.folder(base, seq)}/{names[-1]}"))
            index = pa.array([i - first[s] for s, i in zip(rows.column("seq").to_pylist(), rows.column("idx").to_pylist())], pa.int32())
            ready = rows.drop_columns(["task"]).set_column(1, "idx", index).set_column(2, "name", pa.array(names)).set_column(9, "ordinal", pa.array([time.time_ns()] * len(names)))
            fs.create_dir(f"{base}/_manifest", recursive=True)
            pyarrow.parquet.write_table(ready.cast(_MANIFEST), f"{base}/_manifest/.{self.run}.tmp", filesystem=fs)
            fs.move(f"{base}/_manifest/.{self.run}.tmp", f"{base}/_manifest/{self.run}.parquet")
        except Exception:
            for old, new in reversed(moved):
                with contextlib.suppress(OSError):
                    fs.move(new, old)
            self.abort(messages)
            raise
        self._clear(fs, base)

    @staticmethod
    def _move(fs: pyarrow.fs.FileSystem, old: str, new: str) -> tuple[str, str]:
        if fs.get_file_info(new).type != pyarrow.fs.FileType.NotFound:
            raise FileExistsError(f"{new} was written meanwhile")
        fs.move(old, new)
        return old, new

    def _clear(self, fs: pyarrow.fs.FileSystem, base: str) -> None:
        for path in (self._staging(base), f"{base}/_manifest/.{self.run}.tmp"):
            with contextlib.suppress(OSError):
                (fs.delete_file if path.endswith(".tmp") else fs.delete_dir)(path)

    def abort(self, messages: list[Written | None]) -> None:
        self._clear(*self.place.open())


class ArrayFiles(ds.DataSource):
    """Frames (channels 1) or flows (channels 2) as ``.npy`` files under <path>/<seq>/<subpath>."""

    @classmethod
    def name(cls) -> str:
        return "array_files"

    def schema(self) -> str:
        pixels = {"1": ", data array<float>", "2": ", dx array<float>, dy array<float>"}[self.options.get("channels", "1")]
        return _HEAD + (pixels if self.options.get("pixels", "true").lower() == "true" else "")

    def reader(self, schema: T.StructType) -> ArrayReader:
        return ArrayReader(dict(self.options), schema)

    def writer(self, schema: T.StructType, overwrite: bool) -> ArrayWriter:
        return ArrayWriter(dict(self.options), schema, overwrite)


def register(spark: SparkSession) -> None:
    """Make ``array_files`` known to a session, with filters pushed."""
    spark.dataSource.register(ArrayFiles)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
