"""Archives of audio and feature matrices as a data source, and audio looked up by the paths of a manifest.

An archive is a row of records: a key, a blank, and either a RIFF file of 16-bit samples or a binary matrix of floats or
doubles.  A plain .wav file is one record without a key.  An index (.scp) has a line `key path:offset` for each record.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import ArrayType, FloatType, IntegerType, StructField, StructType

RECORDS = "key string, path string, offset long, rate int, samples array<float>, features array<array<float>>"
#: Samples are 16-bit integers over this, so they lie in -1 to 1.
SCALE = 32768


class Damaged(ValueError):
    """What stands at a place of a file is not a whole record."""


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def split_place(place: str) -> tuple[str, int]:
    """The path and offset of `path:offset`; without a number behind the last colon the offset is 0."""
    path, sep, at = place.rpartition(":")
    return (path, int(at)) if sep and at.isdigit() else (place, 0)


def _take(f, n: int, what: str) -> bytes:
    data = f.read(n)
    if len(data) < n:
        raise Damaged(f"{what} ends after {len(data)} of {n} bytes")
    return data


def read_record(f, where: str, data: bool = True) -> dict:
    """rate and samples, or features, of the record that begins where the file stands; without data only what the header says.

    Channels are averaged.  The file stands behind the record afterwards.
    """
    begin = f.tell()
    head = _take(f, 2, where)
    if head == b"RI":
        size = struct.unpack("<I", _take(f, 6, where)[2:])[0]
        end, form = begin + 8 + size, None
        if _take(f, 4, where) != b"WAVE":
            raise Damaged(f"{where} is no wave file")
        while f.tell() + 8 <= end:
            name, n = struct.unpack("<4sI", _take(f, 8, where))
            if name == b"fmt ":
                form = struct.unpack("<HHIIHH", _take(f, n, where)[:16])
            elif name == b"data":
                if form is None or form[0] not in (1, 0xFFFE) or form[5] != 16:
                    raise Damaged(f"{where} has no 16-bit samples")
                out = {"rate": form[2], "samples": None, "features": None}
                if data:
                    x = np.frombuffer(_take(f, n, where), "<i2").astype(np.float32) / SCALE
                    if len(x) % form[1]:
                        raise Damaged(f"{where} has {len(x)} samples for {form[1]} channels")
                    out["samples"] = x if form[1] == 1 else x.reshape(-1, form[1]).mean(1, dtype=np.float32)
                elif f.size() < f.tell() + n:
                    raise Damaged(f"{where} ends within its {n} bytes of samples")
                f.seek(end)
                return out
            else:
                f.seek(f.tell() + n + n % 2)
        raise Damaged(f"{where} has no samples")
    if head == b"\0B":
        name, _, kind = _take(f, 3, where).partition(b" ")[0], None, None
        if name not in (b"FM", b"DM", b"FV", b"DV"):
            raise Damaged(f"{where} has a matrix of kind {name!r}")
        kind = np.dtype("<f4" if name[:1] == b"F" else "<f8")
        shape = []
        for _ in range(2 if name[1:] == b"M" else 1):
            mark, n = struct.unpack("<bi", _take(f, 5, where))
            if mark != 4 or n < 0:
                raise Damaged(f"{where} has no sizes")
            shape.append(n)
        n = int(np.prod(shape)) * kind.itemsize
        if not data:
            if f.size() < f.tell() + n:
                raise Damaged(f"{where} ends within its {n} bytes of numbers")
            f.seek(f.tell() + n)
            return {"rate": None, "samples": None, "features": None}
        x = np.frombuffer(_take(f, n, where), kind).astype(np.float32)
        return {"rate": None, "samples": None, "features": x.reshape(shape if len(shape) == 2 else (1, -1))}
    raise Damaged(f"{where} has neither a wave file nor a matrix")


def read_key(f, where: str) -> str | None:
    """The key in front of a record, None at the end of the file."""
    key = bytearray()
    while (c := f.read(1)) not in (b"", b" "):
        key += c
        if len(key) > 4096:
            raise Damaged(f"{where} has no key")
    if c == b"" and key.strip():
        raise Damaged(f"{where} ends within a key")
    return key.decode().strip() if c else None


def wave_bytes(samples, rate: int) -> bytes:
    """A RIFF file of one channel from samples in -1 to 1."""
    x = np.clip(np.rint(np.asarray(samples, float) * SCALE), -SCALE, SCALE - 1).astype("<i2").tobytes()
    return b"RIFF" + struct.pack("<I", 36 + len(x)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, rate, 2 * rate, 2, 16) + b"data" + struct.pack("<I", len(x)) + x


def matrix_bytes(features) -> bytes:
    x = np.asarray(features, "<f4")
    return b"\0BFM " + b"".join(struct.pack("<bi", 4, n) for n in x.shape) + x.tobytes()


@dataclass
class Range(InputPartition):
    """Records of a file from one offset to before another (None: its end); with keyed, keys stand before them."""

    path: str
    begin: int = 0
    end: int | None = None
    keyed: bool = True
    keys: tuple[str, ...] = ()
    places: tuple[int, ...] = ()


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict, schema: StructType):
        self.options, self.names = options, schema.names
        self.schema = schema

    def partitions(self) -> list[Range]:
        out = []
        most = int(self.options.get("split", 128 << 20))
        for path in self.options["path"].split(","):
            fs, where = opened(path.strip())
            info = fs.get_file_info(where)
            if info.type == pafs.FileType.NotFound:
                raise FileNotFoundError(path)
            files = [info] if info.type == pafs.FileType.File else sorted(fs.get_file_info(pafs.FileSelector(where, recursive=True)), key=lambda i: i.path)
            for f in files:
                if f.path.endswith(".scp"):
                    out += self._ranges(fs, f.path, most)
                elif f.path.endswith(".wav"):
                    out.append(Range(f.path, keyed=False))
                elif f.path.endswith(".ark") and (info.type == pafs.FileType.File or not any(g.path == f.path[:-4] + ".scp" for g in files)):
                    out.append(Range(f.path))
        return out

    @staticmethod
    def _ranges(fs, index: str, most: int) -> list[Range]:
        """Neighbouring records of an index, in parts of `most` bytes; a record is never cut."""
        with fs.open_input_stream(index) as f:
            lines = [x.split(None, 1) for x in f.read().decode().splitlines() if x.strip()]
        if any(len(x) < 2 for x in lines):
            raise Damaged(f"{index} has a line without a path")
        places = sorted((*split_place(place.strip()), key) for key, place in lines)
        out: list[list[tuple[str, int, str]]] = []
        for p in places:
            if not out or out[-1][0][0] != p[0] or p[1] - out[-1][0][1] >= most:
                out.append([])
            out[-1].append(p)
        return [Range(g[0][0], g[0][1], None, False, tuple(x[2] for x in g), tuple(x[1] for x in g)) for g in out]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        fs, where = opened(partition.path)
        wanted = bool({"samples", "features"} & set(self.names))
        form, rows, held = to_arrow_schema(self.schema), [], 0
        with fs.open_input_file(where) as f:
            for key, at in self._places(f, partition):
                f.seek(at)
                row = read_record(f, f"{partition.path}:{at}", wanted) | {"key": key, "path": partition.path, "offset": at}
                rows.append([row[n] if n != "features" or row[n] is None else list(row[n]) for n in self.names])
                held += 0 if not wanted else sum(0 if row[n] is None else row[n].size for n in ("samples", "features"))
                if held > 4_000_000 or len(rows) >= 10_000:
                    yield self._batch(rows, form)
                    rows, held = [], 0
        if rows:
            yield self._batch(rows, form)

    @staticmethod
    def _batch(rows: list, form: pa.Schema) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), form, strict=True)], schema=form)

    @staticmethod
    def _places(f, partition: Range) -> Iterator[tuple[str | None, int]]:
        if partition.places:
            yield from zip(partition.keys, partition.places, strict=True)
        elif not partition.keyed:
            yield None, partition.begin
        else:
            f.seek(partition.begin)
            while (key := read_key(f, f"{partition.path}:{f.tell()}")) is not None:
                yield key, f.tell()


@dataclass
class Written(WriterCommitMessage):
    name: str


class ArchiveWriter(DataSourceWriter):
    """Each task writes an archive and its index under a name of its own; they get their names when all tasks are through."""

    def __init__(self, folder: str, schema: StructType):
        self.folder, self.names = folder.rstrip("/"), schema.names

    def write(self, rows: Iterator) -> Written:
        name = f"part-{uuid.uuid4().hex}"
        fs, folder = opened(self.folder)
        fs.create_dir(folder, recursive=True)
        at, index = 0, []
        with fs.open_output_stream(f"{folder}/_{name}.ark.tmp") as out:
            for r in rows:
                r = r.asDict()
                if r.get("key") is None or " " in r["key"]:
                    raise ValueError(f"{r.get('key')!r} is no key")
                body = wave_bytes(r["samples"], r["rate"]) if r.get("samples") is not None else matrix_bytes(r["features"])
                head = f"{r['key']} ".encode()
                index.append(f"{r['key']} {folder}/{name}.ark:{at + len(head)}\n")
                out.write(head + body)
                at += len(head) + len(body)
        with fs.open_output_stream(f"{folder}/_{name}.scp.tmp") as out:
            out.write("".join(index).encode())
        return Written(name)

    def _each(self, messages):
        fs, folder = opened(self.folder)
        for m in messages:
            if m is not None:
                for kind in ("ark", "scp"):
                    yield fs, f"{folder}/_{m.name}.{kind}.tmp", f"{folder}/{m.name}.{kind}"

    def commit(self, messages) -> None:
        for fs, old, new in self._each(messages):
            fs.move(old, new)

    def abort(self, messages) -> None:
        for fs, old, _ in self._each(messages):
            fs.delete_file(old)


class Archive(DataSource):
    """spark.read.format("ark").load(path): records of .ark and .wav files, or of the .scp files that index them.

    path: a file, a folder, or several with commas between.  An indexed archive is read in ranges of `split` bytes, one
    without an index by one task.  Under a schema with some of the columns only those are made: without samples and
    features the headers alone are read.  A damaged record fails the read.  df.write.format("ark") writes key, rate and
    samples, or key and features.
    """

    @classmethod
    def name(cls) -> str:
        return "ark"

    def schema(self) -> str:
        return RECORDS

    def reader(self, schema: StructType) -> ArchiveReader:
        return ArchiveReader(dict(self.options), schema)

    def writer(self, schema: StructType, overwrite: bool) -> ArchiveWriter:
        return ArchiveWriter(self.options["path"], schema)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Archive)


def load(rows: DataFrame, place: str = "path", least: float = 0.0, most: float = float("inf")) -> DataFrame:
    """Adds rate and samples of the record that `place` (path or path:offset) names; rows of `least` to `most` seconds stay.

    Rows are dealt by path and offset, so a task reads neighbouring records of few files.  A null place gives nulls and
    stays; a missing file or a damaged record fails.
    """
    named = [c for c in rows.columns if c not in ("rate", "samples")]
    at = F.coalesce(F.regexp_extract(place, r":(\d+)$", 1).try_cast("long"), F.lit(0))
    dealt = rows.select(*named).withColumn("_at", at).repartitionByRange(F.regexp_replace(place, r":\d+$", ""), "_at").sortWithinPartitions(F.regexp_replace(place, r":\d+$", ""), "_at").drop("_at")
    form = StructType([*dealt.schema.fields, StructField("rate", IntegerType()), StructField("samples", ArrayType(FloatType()))])

    def run(batches):
        last, f = None, None
        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                part = batch.slice(i, 64)
                rate, samples, kept = [], [], []
                for k, p in enumerate(part.column(place).to_pylist()):
                    one = {"rate": None, "samples": None}
                    if p is not None:
                        path, at = split_place(p)
                        if path != last:
                            fs, where = opened(path)
                            last, f = path, fs.open_input_file(where)
                        f.seek(at)
                        one = read_record(f, p)
                        if one["samples"] is None:
                            raise Damaged(f"{p} has no samples")
                        if not least <= len(one["samples"]) / one["rate"] <= most:
                            continue
                    kept.append(k)
                    rate.append(one["rate"])
                    samples.append(one["samples"])
                part = part.take(pa.array(kept, pa.int64()))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(rate, pa.int32()), pa.array(samples, pa.list_(pa.float32()))], [*part.schema.names, "rate", "samples"])

    return dealt.mapInArrow(run, form)
