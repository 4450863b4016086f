"""What the operators share: scratch tables, bounded blocks, words and hashes."""

from __future__ import annotations

import atexit
import contextlib
import gc
import os
import tempfile
import uuid
from urllib.parse import urlparse

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII separators of white-space words (0x20 and 0x09 to 0x0D), as bytes.split() has them.
#: Bytes that belong to a word of letters and digits: ASCII alphanumerics and all of UTF-8 beyond ASCII.
_WORD_TABLE = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))


def scratch(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir, which driver and executors share.

    Where that setting is unset (tests, local mode) a temporary folder takes its place.
    The folder goes when the driver ends.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="quern-")
        spark.conf.set("spark.checkpoint.dir", base)
    path = f"{base.rstrip('/')}/quern-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


def _remove(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def drop(spark: SparkSession, *paths: str) -> None:
    """Removes scratch tables that no later step reads."""
    for path in paths:
        _remove(spark, path)


def release(spark: SparkSession) -> None:
    """Has Spark remove the shuffle files of plans that nothing refers to any more."""
    gc.collect()
    spark._jvm.System.gc()


def fresh(taken, *names: str) -> list[str]:
    """The names, lengthened until none of them is taken (Spark ignores case)."""
    taken, out = {x.lower() for x in taken}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def keep(df: DataFrame, path: str, codec: str = "snappy") -> DataFrame:
    """Writes df to path and reads it again: cuts the lineage in a way that survives lost executors."""
    df.write.mode("overwrite").option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def filesystem(path: str):
    """The pyarrow file system of a path or URI and the path in it."""
    import pyarrow.fs as pafs

    if urlparse(path).scheme in ("", "file"):
        return pafs.LocalFileSystem(), urlparse(path).path
    return pafs.FileSystem.from_uri(path)


def publish(path: str, write) -> None:
    """Creates a file whole or not at all: write(stream) fills a file of its own, which then takes its place.

    Repeated and speculative attempts of a task write the same bytes, so the last rename may win.
    """
    fs, where = filesystem(path)
    fs.create_dir(where.rpartition("/")[0], recursive=True)
    part = f"{where}.{uuid.uuid4().hex}.tmp"
    with fs.open_output_stream(part) as out:
        write(out)
    fs.move(part, where)


def mapped(path: str) -> np.ndarray:
    """The bytes of a file in the shared folder as a memory map.

    A folder that cannot be mapped in place is copied to an unlinked file first, which leaves nothing behind.
    """
    fs, where = filesystem(path)
    if not (urlparse(path).scheme in ("", "file")):
        with tempfile.TemporaryFile() as copy, fs.open_input_stream(where) as source:
            while block := source.read(1 << 22):
                copy.write(block)
            copy.flush()
            return np.memmap(copy, np.uint8, "r") if copy.tell() else np.zeros(0, np.uint8)
    return np.memmap(where, np.uint8, "r") if os.path.getsize(where) else np.zeros(0, np.uint8)


def held_out(divisor: int, remainder: int, col: str = "doc_id"):
    """True where crc32 of the id as text leaves the remainder; false for a null id."""
    return F.coalesce(F.crc32(F.col(col).cast("string").cast("binary")) % divisor == remainder, F.lit(False))


def space_words(text: str | None) -> list[bytes]:
    """A-Z lower-cased, split at ASCII white space."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def alnum_words(text: str | None) -> list[bytes]:
    """A-Z lower-cased; runs of ASCII letters and digits and of everything beyond ASCII."""
    return text.encode("utf-8", "surrogatepass").translate(_WORD_TABLE).split() if text else []


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """splitmix64 of uint64s."""
    with np.errstate(over="ignore"):
        x = x + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) & (2**64 - 1))
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def spans(lengths: np.ndarray) -> np.ndarray:
    """Where each run of the given lengths starts, and the end of the last."""
    return np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)]).astype(np.int64)


def text_batches(batches, chars: int = 4_000_000):
    """Slices Arrow batches with a column `text` so that no slice holds many more characters than asked for."""
    import pyarrow.compute as pc

    for batch in batches:
        if not batch.num_rows:
            continue
        size = np.cumsum(np.nan_to_num(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False)).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            end = int(np.searchsorted(size, (size[at - 1] if at else 0) + chars, "right"))
            end = max(at + 1, end)
            yield batch.slice(at, end - at)
            at = end
        batch = size = None  # gone before the next one is read
    trim()


def trim() -> None:
    """Gives memory that is free back to the system, so that a worker that waits for its next task holds little."""
    import ctypes

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


#: Bytes whose words are hashed at a time.
_CHUNK = 1 << 17
#: Bytes of the longest words that are hashed by sums.  Sums modulo 2 ** 64 cannot part certain long words (those whose
#: letters alternate as the digit sums of their places do, from some 1,024 bytes on), so longer ones go to xxh3.
SHORT = 32


def long_hashes(hashes: np.ndarray, data: np.ndarray, starts: np.ndarray, word: np.ndarray, fold: bool = True) -> None:
    """Puts xxh3 of the bytes (A-Z lower-cased if fold says so) in place of the hashes of all words of over SHORT bytes.

    word: 0 for bytes that belong to no word.  A word ends before such a byte or where the next one starts.
    """
    import xxhash

    for k in np.flatnonzero(np.diff(starts, append=len(data)) > SHORT).tolist():
        i, j = int(starts[k]), int(starts[k + 1]) if k + 1 < len(starts) else len(data)
        gap = np.flatnonzero(word[i:j] == 0)
        j = i + int(gap[0]) if len(gap) else j
        if j - i > SHORT:
            own = data[i:j].tobytes()
            hashes[k] = xxhash.xxh3_64_intdigest(own.lower() if fold else own, 6)


def _values(word: bytes) -> np.ndarray:
    """An odd number for each byte that belongs to a word, the same for both cases of a letter; 0 for others."""
    each = np.random.default_rng(20).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return np.array([each[c + 32 if 65 <= c <= 90 else c] if word[c] else 0 for c in range(256)], np.uint64)


#: Words of letters and digits (with everything beyond ASCII), and words between ASCII white space.
ALNUM = _values(bytes(c >= 128 or chr(c).isalnum() for c in range(256)))
SPACE = _values(bytes(c != 32 and not 9 <= c <= 13 for c in range(256)))
_BASE = 0x9E3779B97F4A7C15
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> list[np.ndarray]:
    """The powers of an odd base and of its inverse modulo 2 ** 64, at least n."""
    if len(_powers[0]) < n:
        n = max(n, _CHUNK)
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            x = np.full(n, base, np.uint64)
            x[0] = 1
            _powers[k] = np.multiply.accumulate(x)
    return _powers


def text_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts of an Arrow column one after another, and where each starts and the last ends; nulls are empty."""
    import pyarrow as pa
    import pyarrow.compute as pc

    column = pc.fill_null(column, "").cast(pa.large_binary())
    _, offsets, data = column.buffers()
    cuts = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    every = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return every[cuts[0] : cuts[-1]], cuts - cuts[0]


def word_hashes(data: np.ndarray, cuts: np.ndarray, values: np.ndarray = ALNUM) -> tuple[np.ndarray, np.ndarray]:
    """Where each word starts and its 64-bit hash, A-Z lower-cased; no word crosses a cut.

    A short word's hash is a polynomial in its bytes' values: one pass of sums over all bytes, without a step a word.
    A word of over SHORT bytes has xxh3 of its bytes.
    """
    starts, hashes, at, n = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)], 0, len(data)
    edges = np.zeros(n + 1, bool)
    edges[cuts] = True
    while at < n:
        end = min(n, at + _CHUNK)
        while end < n:  # to the end of the word
            more = np.flatnonzero((values[data[end : end + 4096]] == 0) | edges[end : min(n, end + 4096)])
            if len(more):
                end += int(more[0])
                break
            end = min(n, end + 4096)
        v = values[data[at:end]]
        word = v != 0
        first = word.copy()
        first[1:] &= ~word[:-1] | edges[at + 1 : end]
        first = np.flatnonzero(first)
        if len(first):
            up, down = powers(len(v))
            h = mix(np.add.reduceat(v * up[: len(v)], first) * down[first], 6)
            long_hashes(h, data[at:end], first, v)
            hashes.append(h)
            starts.append(first + at)
        at = end
    return np.concatenate(starts), np.concatenate(hashes)


#: Bits of a word's hash that tell words within a group apart, and groups that are sorted at a time.
WORD_BITS, GROUPS = 44, 1 << 20


def distinct(of: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct pairs of a group's number (ascending from 0) and the leading WORD_BITS of a hash, in order."""
    parts, low, last = [], np.uint64(64 - WORD_BITS), int(of[-1]) + 1 if len(of) else 0
    for base in range(0, last, GROUPS):
        i, j = np.searchsorted(of, [base, base + GROUPS])
        key = np.sort(((of[i:j] - base).astype(np.uint64) << np.uint64(WORD_BITS)) | (h[i:j] >> low))
        new = np.ones(len(key), bool)
        new[1:] = key[1:] != key[:-1]
        key = key[new]
        parts.append(((key >> np.uint64(WORD_BITS)).astype(np.int64) + base, key & np.uint64((1 << WORD_BITS) - 1)))
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return parts[0] if len(parts) == 1 else tuple(np.concatenate(x) for x in zip(*parts, strict=True))


class Table:
    """The rows (k, salt, v) that hold a table of fixed size, compressed and in chunks, and how to add them up."""

    FORM = "k int, salt int, v binary"

    def __init__(self, size: int, kind, combine, chunk: int = 1 << 15):
        self.size, self.kind, self.combine, self.chunk = size, kind, combine, min(chunk, size)

    def rows(self, table: np.ndarray):
        """k, salt and v of a task's table."""
        import zlib

        from pyspark import TaskContext

        salt = TaskContext.get().partitionId() // 64
        parts = ((k, table[k * self.chunk : (k + 1) * self.chunk]) for k in range(self.size // self.chunk))
        found = [(k, salt, zlib.compress(part.astype(self.kind).tobytes(), 1)) for k, part in parts if part.any()]
        return [list(x) for x in zip(*found, strict=True)] or [[], [], []]

    def total(self, df: DataFrame) -> np.ndarray:
        """All tasks' tables combined, first those of some tasks and then those sums, a row at a time; the result reaches the driver."""
        import zlib

        import pyarrow as pa

        chunk, kind, combine = self.chunk, self.kind, self.combine

        def add(batches):
            of, out = None, np.zeros(chunk, kind)

            def close():
                return pa.RecordBatch.from_arrays([pa.array([of[0]], pa.int32()), pa.array([of[1]], pa.int32()), pa.array([zlib.compress(out.tobytes(), 1)], pa.binary())], ["k", "salt", "v"])

            for b in batches:
                for k, salt, v in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                    if of is None or of[0] != k:
                        if of is not None:
                            yield close()
                        out[:] = 0
                    of = k, salt
                    combine(out, np.frombuffer(zlib.decompress(v), kind), out=out)
            if of is not None:
                yield close()

        for by in (["k", "salt"], ["k"]):
            df = df.repartition(*by).sortWithinPartitions("k").mapInArrow(add, self.FORM)
        out = np.zeros(self.size, kind)
        for r in df.collect():  # size // chunk rows
            out[r.k * chunk : (r.k + 1) * chunk] = np.frombuffer(zlib.decompress(r.v), kind)
        return out


def add_counts(counts: np.ndarray, at: np.ndarray) -> None:
    """Counts each place in `at` once for each time it is named."""
    at = np.sort(at.astype(np.uint32))
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]])[: len(at)])
    counts[at[first]] += np.diff(np.append(first, len(at))).astype(counts.dtype)


#: Bits of the smallest and of the largest Bloom filter (32 KB and 64 MB).  Beyond some 30 million members the largest
#: lets more rows through, which the join behind it drops.
LEAST_BITS, MOST_BITS = 1 << 18, 1 << 29


def _places(h: np.ndarray, bits: int):
    h = mix(h.astype(np.int64).view(np.uint64), 8)
    return (h & np.uint64(bits - 1)).astype(np.int64), (h >> np.uint64(32) & np.uint64(bits - 1)).astype(np.int64)


def bloom(df: DataFrame, column: str, members: int) -> np.ndarray:
    """A Bloom filter of a column of so many longs, for may_hold(); 16 to 32 bits a member let about one stranger of a hundred through."""
    import pyarrow as pa

    bits = min(MOST_BITS, max(LEAST_BITS, 1 << (16 * members).bit_length()))
    table = Table(bits // 8, np.uint8, np.bitwise_or)

    def run(batches):
        out = np.zeros(bits // 8, np.uint8)
        for b in batches:
            for at in _places(b.column(column).to_numpy(zero_copy_only=False), bits):
                np.bitwise_or.at(out, at >> 3, np.uint8(128) >> (at & 7).astype(np.uint8))
        k, salt, v = table.rows(out)
        yield pa.RecordBatch.from_arrays([pa.array(k, pa.int32()), pa.array(salt, pa.int32()), pa.array(v, pa.binary())], ["k", "salt", "v"])

    return table.total(df.select(column).mapInArrow(run, table.FORM))


def may_hold(filter_: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Whether the filter may hold each number; false is certain."""
    i, j = _places(h, 8 * len(filter_))
    return ((filter_[i >> 3] >> (7 - (i & 7)).astype(np.uint8)) & (filter_[j >> 3] >> (7 - (j & 7)).astype(np.uint8)) & 1).astype(bool)
