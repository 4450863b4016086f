"""Trigram scoring by an Elias-Fano trie.

Counts come from all training texts.  Words are numbered by the order of their 64-bit hashes, in sorted, memory-mapped
vocabulary files.  The trie has a level for each order, cut into shards by the first word of the n-gram: monotone
pointers to each node's successors, the successors themselves made monotone by adding the last value of the node
before, both in Elias-Fano form, and 16-bit codes of the smoothed probabilities and of the back-off masses.  A lookup
goes from a context's node through its pointers to a successor search in its own range.

Probabilities are absolute discounting, interpolated down to (c + 1) / (N + V + 1) for words.  With `least` = 1 every
n-gram that was seen is stored; with 2 those of two and three words that occur once are not, their mass backs off, so
each context's probabilities still sum to 1.  N-grams are counted in sorted packed blocks that are dealt by hash, so
neither a hot word nor the number of n-grams is a burden to one task.

Files lie in the folder that all executors share; tasks map them and hold little of them in memory.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .elias_fano import EliasFano, encode
from .shared import SPACE, drop, keep, mapped, mix, publish, release, scratch, spans, text_batches, text_bytes, trim, word_hashes

DISCOUNT = 0.75
#: Token n-grams to a block of the counts, words to a vocabulary file, about.
PART, SHARD = 3_000_000, 750_000
#: Token n-grams that a task sorts and counts at a time.
BATCH = 3_000_000
#: N-grams that a task merges, and whose probabilities it works out, at a time.
STEP = 1 << 19
#: Characters of the texts that are scored at a time.
SLICE = 4_000_000
#: log10 probabilities are kept in 16 bits from -LOWEST to 0.
LOWEST = 24.0
END = np.uint64(xxhash.xxh3_64_intdigest(b" end of text "))
_CODEC = "zstd"
_PACKED = "part int, n long, raw binary"


def quantise(p: np.ndarray) -> np.ndarray:
    return np.clip(np.round(-np.log10(np.maximum(p, 10.0**-LOWEST)) / LOWEST * 65535), 0, 65535).astype(np.uint16)


def restored(code: np.ndarray) -> np.ndarray:
    return code.astype(np.float64) * (-LOWEST / 65535)


def save(path: str, arrays: list[np.ndarray]) -> None:
    """Arrays, each at a multiple of 8 bytes, after a list of their types and sizes."""
    head = ";".join(f"{a.dtype.str},{a.size}" for a in arrays).encode().ljust(512)

    def write(out):
        out.write(head)
        for a in arrays:
            out.write(np.ascontiguousarray(a).data)
            out.write(bytes(-a.nbytes % 8))

    publish(path, write)


def load(path: str) -> list[np.ndarray]:
    raw = mapped(path).view(np.ndarray)  # still the map; indexing a memmap costs more
    at, out = 512, []
    for part in raw[:512].tobytes().decode().strip().split(";"):
        kind, n = part.split(",")
        size = int(n) * np.dtype(kind).itemsize
        out.append(raw[at : at + size].view(kind))
        at += size + -size % 8
    return out


@dataclass
class Files:
    """Where a model is: a few numbers and names for each file."""

    folder: str
    words: int  # V
    tokens: int  # N
    texts: int
    bits: int = 0  # the vocabulary files go by so many first bits of the hash
    sizes: list[int] = field(default_factory=list)
    shards: int = 1
    nodes: dict[int, list[int]] = field(default_factory=dict)  # of bigrams, by shard
    levels: int = 1


class Trie:
    """Lookups in the files, mapped when first asked for."""

    def __init__(self, files: Files):
        self.f, self.open = files, {}
        self.first = spans(np.array(files.sizes, np.int64)) + 1  # ids from 1 on; 0 is the start of a text
        self.unknown = files.words + 1
        self.base = np.log10(1 / (files.tokens + files.words + 1))

    def file(self, name: str) -> list[np.ndarray]:
        if name not in self.open:
            self.open[name] = load(f"{self.f.folder}/{name}")
        return self.open[name]

    def ids(self, h: np.ndarray) -> np.ndarray:
        part = (h >> np.uint64(64 - self.f.bits)).astype(np.int64) if self.f.bits else np.zeros(len(h), np.int64)
        out = np.full(len(h), self.unknown, np.int64)
        for k in np.unique(part).tolist():
            if self.f.sizes[k]:
                own = np.flatnonzero(part == k)
                table = self.file(f"words-{k}")[0]
                at = np.minimum(np.searchsorted(table, h[own]), len(table) - 1)
                ok = table[at] == h[own]
                out[own[ok]] = at[ok] + self.first[k]
        return out

    def counts(self, ids: np.ndarray) -> np.ndarray:
        """How often words occur; 0 for unknown ones, the number of texts for their start."""
        out = np.where(ids == 0, self.f.texts, 0).astype(np.int64)
        part = np.searchsorted(self.first, ids, "right") - 1
        known = (ids > 0) & (ids < self.unknown)
        for k in np.unique(part[known]).tolist():
            own = np.flatnonzero(known & (part == k))
            out[own] = self.file(f"words-{k}")[1][ids[own] - self.first[k]]
        return out

    def one(self, ids: np.ndarray) -> np.ndarray:
        return np.log10((self.counts(ids) * (ids > 0) + 1) / (self.f.tokens + self.f.words + 1))

    def shard(self, u: np.ndarray) -> np.ndarray:
        return (u * self.f.shards) // (self.f.words + 2)

    def find(self, level: int, shard: int, node: np.ndarray, w: np.ndarray) -> np.ndarray:
        """Numbers (in the shard and level) of successors w of nodes, -1 where there is none; pairs are distinct and in order."""
        pointers, successors = self.structures(level, shard)
        out = np.full(len(node), -1, np.int64)
        i, j = np.searchsorted(node, [0, pointers.n - 1])
        if i >= j or not successors.n:
            return out
        node, w = node[i:j], w[i:j].astype(np.uint64)
        # each distinct node's range is looked up once
        new = np.concatenate([[True], node[1:] != node[:-1]])
        own, of = node[new], np.cumsum(new) - 1
        a, b = (x.astype(np.int64) for x in pointers.both(own))
        before, first = np.zeros(len(own), np.uint64), np.zeros(len(own), np.uint64)
        some = np.flatnonzero((a < b) & (a > 0))
        before[some], first[some] = successors.both(a[some] - 1)
        some = np.flatnonzero((a < b) & (a == 0))
        first[some] = successors[a[some]]
        # most nodes have one successor, which is known by now
        value = before[of] + w
        here, more = (a < b)[of], (a + 1 < b)[of]
        at = np.flatnonzero(here & (value == first[of]))
        out[i + at] = a[of[at]]
        go = np.flatnonzero(more & (value > first[of]))
        if len(go):
            c = of[go]
            at, hit = successors.find(value[go], a[c] + 1, b[c])
            out[i + go[hit]] = at[hit]
        return out

    def structures(self, level: int, shard: int) -> tuple[EliasFano, EliasFano]:
        key = ("ef", level, shard)
        if key not in self.open:
            x = self.file(f"level-{level}-{shard}")
            self.open[key] = EliasFano(*x[:4]), EliasFano(*x[4:8])
        return self.open[key]

    def start(self, shard: int) -> int:
        return -(-shard * (self.f.words + 2) // self.f.shards)

    def bigrams(self, pair: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(shard, number) of bigrams, distinct and in order; number -1 where there is none."""
        u, v = (pair >> np.uint64(32)).astype(np.int64), (pair & np.uint64(0xFFFFFFFF)).astype(np.int64)
        s, at = self.shard(u), np.full(len(u), -1, np.int64)
        for k, i, j in _runs(s):
            at[i:j] = self.find(2, k, u[i:j] - self.start(k), v[i:j])
        return s, at

    def two(self, pair: np.ndarray, found: tuple[np.ndarray, np.ndarray], one: np.ndarray) -> np.ndarray:
        """log10 P(v | u) of bigrams that bigrams() has found; one: log10 P(v)."""
        u, out = (pair >> np.uint64(32)).astype(np.int64), one.copy()
        for k, i, j in _runs(found[0]):
            x, at = self.file(f"level-2-{k}"), found[1][i:j]
            hit = np.flatnonzero(at >= 0)
            out[i + hit] = restored(x[8][at[hit]])
            rest = np.flatnonzero((at < 0) & (u[i:j] < self.unknown))
            out[i + rest] += restored(x[9][u[i + rest] - self.start(k)])
        return out

    def three(self, context: np.ndarray, last: np.ndarray, found: tuple[np.ndarray, np.ndarray], w: np.ndarray, two: np.ndarray) -> np.ndarray:
        """log10 P(w | u v) of trigrams in order of their first bigram.

        context and last number the bigrams u v and v w in what bigrams() has found; w: the last word; two: log10 P(w | v).
        """
        out = two[last]
        s, node = found[0][context], found[1][context]
        seen = found[1][last] >= 0
        for k, i, j in _runs(s):
            x, ok = self.file(f"level-3-{k}"), i + np.flatnonzero(node[i:j] >= 0)
            hit = np.full(len(ok), -1, np.int64)
            can = seen[ok]  # a trigram that was seen holds a bigram that was
            hit[can] = self.find(3, k, node[ok[can]], w[ok[can]])
            out[ok[hit < 0]] += restored(x[9][node[ok[hit < 0]]])
            out[ok[hit >= 0]] = restored(x[8][hit[hit >= 0]])
        return out


def _runs(s: np.ndarray):
    """Each run of equal numbers: the number, its start and its end."""
    edge = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1], [True]])[: len(s) + 1]) if len(s) else []
    return [(int(s[i]), int(i), int(j)) for i, j in zip(edge[:-1], edge[1:], strict=True)]


def _pairs(u: np.ndarray, v: np.ndarray) -> np.ndarray:
    return (u.astype(np.uint64) << np.uint64(32)) | v.astype(np.uint64)


def _sequence(column) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens of an Arrow column of texts, each text's end among them, and tokens to a text."""
    data, cuts = text_bytes(column)
    starts, h = word_hashes(data, cuts, SPACE)
    n = np.diff(np.searchsorted(starts, cuts)) + 1
    out = np.full(int(n.sum()), END, np.uint64)
    inner = np.ones(len(out), bool)
    inner[np.cumsum(n) - 1] = False
    out[inner] = h
    return out, n


def _contexts(ids: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The token before each and the one before that; 0 before a text's first."""
    first = spans(n)[:-1]
    one = np.concatenate([[0], ids[:-1]]) if len(ids) else ids
    one[first] = 0
    two = np.concatenate([[0], one[:-1]]) if len(ids) else ids
    two[first] = 0
    return one, two


def _blocks(keys: np.ndarray, parts: int) -> list:
    """Rows (part, packed): sorted distinct keys with their counts, by hash of the key; the array is sorted in place."""
    keys.sort()
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])[: len(keys)])
    c = np.diff(first, append=len(keys)).astype(np.uint32 if len(keys) < 1 << 32 else np.int64)
    keys[: len(first)] = keys[first]
    k = keys[: len(first)]
    del first
    part = np.empty(len(k), np.uint16 if parts <= 1 << 16 else np.int64)
    for i in range(0, len(k), STEP):
        part[i : i + STEP] = mix(k[i : i + STEP], 9) % np.uint64(parts)
    return list(_split(k, c, part))


def _split(k: np.ndarray, c: np.ndarray, part: np.ndarray):
    """Rows (part, n, packed) of sorted keys and their counts, by the given parts."""
    if len(part) and int(part.max()) < 1 << 16:
        part = part.astype(np.uint16, copy=False)
    order = np.argsort(part, kind="stable")
    for p, i, j in _runs(part[order]):
        own = order[i:j]
        x, y = k[own], c[own]
        width = 4 if int(y.max()) < 1 << 32 else 8  # bytes of a count
        raw = np.diff(x, prepend=np.uint64(0)).astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes() + y.astype(f"<u{width}").view(np.uint8).reshape(-1, width).T.tobytes()
        yield p, j - i, bytes([width]) + pa.compress(raw, _CODEC, asbytes=True)


def _unpacked(n: int, raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    width = raw[0]
    x = np.frombuffer(pa.decompress(memoryview(raw)[1:], (8 + width) * n, _CODEC, asbytes=True), np.uint8)
    k = np.cumsum(np.ascontiguousarray(x[: 8 * n].reshape(8, n).T).view("<u8").reshape(-1), dtype=np.uint64)
    return k, np.ascontiguousarray(x[8 * n :].reshape(width, n).T).view(f"<u{width}").reshape(-1)


def _block_batch(rows: list) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [[]] * 3
    return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.binary())], ["part", "n", "raw"])


def _merged(blocks: list):
    """Distinct keys and the sums of their counts from blocks (keys in order, counts), in order of the keys, about STEP at a time."""
    every, starts = max(1, STEP // 64), spans(np.array([len(k) for k, _ in blocks]))
    some = np.sort(np.concatenate([k[-at % every :: every] for (k, _), at in zip(blocks, starts[:-1].tolist(), strict=True)]))
    cut = np.unique(some[64::64])
    ends = [np.concatenate([[0], np.searchsorted(k, cut), [len(k)]]) for k, _ in blocks]
    for i in range(len(cut) + 1):
        k = np.concatenate([k[e[i] : e[i + 1]] for (k, _), e in zip(blocks, ends, strict=True)])
        c = np.concatenate([c[e[i] : e[i + 1]] for (_, c), e in zip(blocks, ends, strict=True)])
        order = np.argsort(k, kind="stable")
        k, c = k[order], c[order].astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])[: len(k)])
        if len(first):
            yield k[first], np.add.reduceat(c, first)


def _tally(texts: DataFrame, keys_of, parts: int, least: int = 1, packed: bool = False, shard_of=None) -> DataFrame:
    """k and c for keys (u64 as long) that occur at least `least` times in texts; keys_of(column) gives an array of them.

    With `packed`, rows (part, n, raw) of blocks of them instead, whose keys are all different; with shard_of, these are
    dealt by shard_of(keys), which grows with the keys, as _dealt does it, but by the worker that merges them.
    """

    def run(batches):
        held, n = np.empty(BATCH, np.uint64), 0
        for b in text_batches(batches):
            keys, at = keys_of(b.column("text")), 0
            del b
            while at < len(keys):
                more = min(BATCH - n, len(keys) - at)
                held[n : n + more] = keys[at : at + more]
                at, n = at + more, n + more
                if n == BATCH:
                    yield _block_batch(_blocks(held, parts))
                    n = 0
            del keys
        if n:
            yield _block_batch(_blocks(held[:n], parts))
        del held
        trim()

    def merged(pdf: pd.DataFrame) -> pd.DataFrame:
        rows, part = [], int(pdf["part"].iloc[0])
        for k, c in _merged([_unpacked(n, raw) for n, raw in zip(pdf["n"], pdf["raw"], strict=True)]):
            if least > 1:
                ok = c >= least
                k, c = k[ok], c[ok]
            if packed:
                rows += _split(k, c, shard_of(k) if shard_of else np.full(len(k), part))
            else:
                rows.append(pd.DataFrame({"k": k.view(np.int64), "c": c}))
        return pd.DataFrame(rows, columns=["part", "n", "raw"]) if packed else pd.concat(rows)

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        out = merged(pdf)
        trim()
        return out

    return texts.mapInArrow(run, _PACKED).groupBy("part").applyInPandas(merge, _PACKED if packed else "k long, c long")


def _dealt(blocks: DataFrame, shard_of) -> DataFrame:
    """Packed blocks with their keys dealt by shard_of(keys)."""

    def deal(batches):
        for b in batches:
            for n, raw in zip(b.column("n").to_pylist(), b.column("raw").to_pylist(), strict=True):
                k, c = _unpacked(n, raw)
                yield _block_batch(list(_split(k, c, shard_of(k))))
                del k, c
        trim()

    return blocks.mapInArrow(deal, _PACKED)


def _order(col: str) -> Column:
    """Unsigned order of a long."""
    return F.col(col).bitwiseXOR(F.lit(-(2**63)))


def _grouped(batches, key: str):
    """Whole runs of equal keys from batches sorted by it, as pandas frames."""
    held: list[pd.DataFrame] = []
    for b in batches:
        d = b.to_pandas()
        for k, own in d.groupby(key, sort=False):
            if held and held[0][key].iloc[0] != k:
                yield pd.concat(held, ignore_index=True)
                held = []
            held.append(own)
    if held:
        yield pd.concat(held, ignore_index=True)


def _each(rows: DataFrame, key: str, sort: list, work, shards: int) -> dict[int, int]:
    """work(key, frame) for each key's rows in order, in tasks; what it returns, by key (a number for each shard)."""

    def run(batches):
        for d in _grouped(batches, key):
            k = int(d[key].iloc[0])
            yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([work(k, d)])], ["k", "n"])

    made = rows.repartition(shards, key).sortWithinPartitions(key, *sort).mapInArrow(run, "k long, n long").collect()
    return {r.k: r.n for r in made}


def _each_packed(blocks: DataFrame, work, shards: int) -> dict[int, int]:
    """As _each, from packed blocks that are dealt to shards: work(shard, keys in order, counts)."""

    def close(shard, held):
        n = sum(x for x, _ in held)
        k, c, at = np.empty(n, np.uint64), np.empty(n, np.uint64 if any(raw[0] == 8 for _, raw in held) else np.uint32), 0
        for x, raw in held:
            k[at : at + x], c[at : at + x] = _unpacked(x, raw)
            at += x
        held.clear()
        order = np.argsort(k)
        k, c = k[order], c[order]
        del order
        return pa.RecordBatch.from_arrays([pa.array([shard]), pa.array([work(shard, k, c)])], ["k", "n"])

    def run(batches):
        shard, held = -1, []
        for b in batches:
            for p, n, raw in zip(*(b.column(x).to_pylist() for x in ("part", "n", "raw")), strict=True):
                if held and p != shard:
                    yield close(shard, held)
                shard = p
                held.append((n, raw))
        if held:
            yield close(shard, held)
        trim()

    made = blocks.repartition(shards, "part").sortWithinPartitions("part").mapInArrow(run, "k long, n long").collect()
    return {r.k: r.n for r in made}


def train(docs: DataFrame, folder: str, least: int = 1) -> Files | None:
    """Counts the n-grams of docs (text) and writes the model's files, with bigrams and trigrams that occur at least
    `least` times; None if there are no texts."""
    texts = docs.select(F.col("text").cast("string"))

    def words_of():
        def keys(batch):
            return _sequence(batch)[0]

        return keys

    rough = docs.select(F.count("*").alias("n"), F.sum(F.length(F.coalesce("text", F.lit("")))).alias("c")).first()
    if not rough.n:
        return None
    parts = max(1, int(rough.c or 0) // 6 // PART + 1)
    unigrams = keep(_tally(texts, _Lazy(words_of), parts, 1), f"{folder}/unigrams")
    total = unigrams.agg(F.count("*").alias("v"), F.sum("c").alias("n")).first()
    _check(int(total.v) + 2, "words")
    bits = max(0, (int(total.v) // SHARD).bit_length())
    f = Files(folder, int(total.v), int(total.n), int(rough.n), bits)

    def vocabulary(k: int, d: pd.DataFrame) -> int:
        save(f"{folder}/words-{k}", [d["k"].to_numpy(np.int64).view(np.uint64), d["c"].to_numpy(np.int64)])
        return len(d)

    by = F.shiftrightunsigned("k", 64 - bits).cast("int") if bits else F.lit(0)
    sizes = _each(unigrams.withColumn("p", by), "p", [_order("k")], vocabulary, 1 << bits)
    f.sizes = [sizes.get(k, 0) for k in range(1 << bits)]
    drop(docs.sparkSession, f"{folder}/unigrams")
    release(docs.sparkSession)

    def bigrams_of():
        trie = Trie(f)

        def keys(batch):
            ids, n = _known(batch, trie)
            u, _ = _contexts(ids, n)
            if least < 2:
                return _pairs(u, ids)
            c = trie.counts(ids)  # a bigram can occur twice only if both words do
            often = (c >= 2) & (np.where(u == 0, 2, np.concatenate([[2], c[:-1]])) >= 2)
            return _pairs(u[often], ids[often])

        return keys

    pairs = keep(_tally(texts, _Lazy(bigrams_of), parts, least, packed=True), f"{folder}/bigrams")
    f.shards = max(1, -(-int(pairs.agg(F.sum("n")).first()[0] or 0) // SHARD))

    def second(k: int, key: np.ndarray, c: np.ndarray) -> int:
        trie = Trie(f)
        start, end = -(-k * (f.words + 2) // f.shards), -(-(k + 1) * (f.words + 2) // f.shards)
        context = np.maximum(1, trie.counts(np.arange(start, end))).astype(np.float64)
        _level(f"{folder}/level-2-{k}", key, start, c, context, lambda node, v: 10 ** trie.one(v), nodes=True)
        return len(key)

    made = _each_packed(_dealt(pairs, lambda k: ((k >> np.uint64(32)).astype(np.int64) * f.shards) // (f.words + 2)), second, f.shards)
    for k in range(f.shards):
        if k not in made:
            second(k, np.zeros(0, np.uint64), np.zeros(0))
            made[k] = 0
    drop(docs.sparkSession, f"{folder}/bigrams")
    release(docs.sparkSession)
    f.levels = 2
    first = spans(np.array([made[k] for k in range(f.shards)], np.int64))
    _check(int(first[-1]), "bigrams")

    def trigrams_of():
        trie = Trie(f)

        def keys(batch):
            h, n = _sequence(batch)
            every, back = np.unique(h, return_inverse=True)
            every = trie.ids(every)
            ids = every[back]
            inner = np.ones(len(ids), bool)
            inner[spans(n)[:-1]] = False
            pair, back = _bigrams(every, back, n, trie.unknown)
            s, at = trie.bigrams(pair)
            i = np.flatnonzero(inner & (at[back] >= 0))
            i = i[at[back[i - 1]] >= 0]
            return _pairs((first[s] + at)[back[i - 1]], ids[i])

        return keys

    triples = _tally(texts, _Lazy(trigrams_of), parts, least, True, lambda k: np.searchsorted(first[1:-1], (k >> np.uint64(32)).astype(np.int64), "right"))

    def third(k: int, key: np.ndarray, c: np.ndarray) -> int:
        trie = Trie(f)
        x = trie.file(f"level-2-{k}")

        def lower(node, w):
            pair, back = np.unique(_pairs(x[11][node], w), return_inverse=True)
            return 10 ** trie.two(pair, trie.bigrams(pair), trie.one((pair & np.uint64(0xFFFFFFFF)).astype(np.int64)))[back]

        _level(f"{folder}/level-3-{k}", key, int(first[k]), c, x[10].astype(np.float64), lower)
        return len(key)

    made = _each_packed(triples, third, f.shards)
    for k in range(f.shards):
        if k not in made:
            third(k, np.zeros(0, np.uint64), np.zeros(0))
    f.levels = 3
    return f


def _check(n: int, what: str) -> None:
    if n >= 1 << 32:
        raise ValueError(f"{n} different {what}: their numbers have to fit in 32 bits; a larger `least` leaves out the rarest n-grams")


class _Lazy:
    """A function that each task makes for itself when it first needs it."""

    def __init__(self, make):
        self.make, self.own = make, None

    def __getstate__(self):
        return {"make": self.make, "own": None}

    def __call__(self, texts):
        self.own = self.own or self.make()
        return self.own(texts)


def _known(column, trie: Trie) -> tuple[np.ndarray, np.ndarray]:
    h, n = _sequence(column)
    every, back = np.unique(h, return_inverse=True)
    return trie.ids(every)[back], n


def _distinct(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """np.unique(key, return_inverse=True), where keys leave room for their places by one sort of both in one number."""
    bits = len(key).bit_length()
    if not len(key) or int(key.max()).bit_length() + bits > 64:
        return np.unique(key, return_inverse=True)
    x = (key << np.uint64(bits)) | np.arange(len(key), dtype=np.uint64)
    x.sort()
    k = x >> np.uint64(bits)
    new = np.concatenate([[True], k[1:] != k[:-1]])
    back = np.empty(len(key), np.int64)
    back[(x & np.uint64((1 << bits) - 1)).astype(np.int64)] = np.cumsum(new) - 1
    return k[new], back


def _bigrams(ids: np.ndarray, back: np.ndarray, n: np.ndarray, unknown: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct bigrams, in order, of tokens numbered by `back`, and each token's; ids: of those numbers, those of known words in order."""
    known = ids < unknown
    rank = np.where(known, np.cumsum(known), known.sum() + 1)[back]  # 0 is the start of a text
    of, bits = np.concatenate([[0], ids[known], [unknown]]), np.uint64(len(ids).bit_length() + 1)
    key, at = _distinct((_contexts(rank, n)[0].astype(np.uint64) << bits) | rank.astype(np.uint64))
    return _pairs(of[(key >> bits).astype(np.int64)], of[(key & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)]), at


def _level(path: str, key: np.ndarray, start: int, c: np.ndarray, context: np.ndarray, lower, nodes: bool = False) -> None:
    """Writes a level's shard: keys, in order, hold a node (counted from `start`) and a word; context: each node's count;
    lower(nodes, words): P(w) one order down.

    Parts: pointers and successors (four arrays each), probabilities, back-off masses of nodes and, if a level follows
    (`nodes`), counts and words.
    """

    def slices():
        for i in range(0, len(key), STEP):
            k = key[i : i + STEP]
            yield slice(i, i + STEP), (k >> np.uint64(32)).astype(np.int64) - start, (k & np.uint64(0xFFFFFFFF)).astype(np.int64)

    ends, spent, last = np.zeros(len(context), np.int64), np.zeros(len(context)), np.zeros(len(context), np.int64)
    for i, node, w in slices():
        ends += np.bincount(node, minlength=len(context))
        np.add.at(spent, node, c[i] - DISCOUNT)
        last[node] = w  # the largest successor of each node
    rest = np.clip(1 - spent / context, 1e-12, 1)
    base = np.concatenate([[0], np.cumsum(last)[:-1]]) if len(last) else last
    p, x = np.zeros(len(key), np.uint16), np.zeros(len(key), np.uint64)
    for i, node, w in slices():
        p[i] = quantise((c[i] - DISCOUNT) / context[node] + rest[node] * lower(node, w))
        x[i] = base[node] + w
    level = [*encode(np.concatenate([[0], np.cumsum(ends)])), *encode(x), p, quantise(rest)]
    del x
    if nodes:
        level += [c.astype(np.uint32), key.astype(np.uint32)]  # the words are the keys' low halves
    save(path, level)


def score(docs: DataFrame, files: Files | None) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score and score (log10 of the probability of the text) for each row."""
    kind = dict(docs.dtypes)["doc_id"]
    schema = f"doc_id {kind}, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    total = files.tokens if files else 0

    def scored(trie, b):
        if trie is None:
            n = _sequence(b.column("text"))[1]
            known, base, full = np.zeros(len(n), np.int64), np.zeros(len(n)), np.zeros(len(n))
        else:
            h, n = _sequence(b.column("text"))
            every, back = np.unique(h, return_inverse=True)
            del h
            every, at = trie.ids(every), spans(n)[:-1]
            known = np.add.reduceat((every < trie.unknown)[back].astype(np.int64), at)
            pair, of = _bigrams(every, back, n, trie.unknown)
            one, lower = trie.one(every)[back], np.zeros(len(pair))
            base, lower[of] = np.add.reduceat(one, at), one
            del back, one
            found = trie.bigrams(pair)
            two = trie.two(pair, found, lower)
            del lower
            inner = np.ones(len(of), bool)
            inner[at] = False
            i, p = np.flatnonzero(inner), two[of]
            if trie.f.levels > 2:
                # in order of the bigram before, and in that of the word
                bits = np.uint64(len(pair).bit_length())
                triple, own = _distinct((of[i - 1].astype(np.uint64) << bits) | of[i].astype(np.uint64))
                context, last = (triple >> bits).astype(np.int64), (triple & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
                del of, triple
                p[i] = trie.three(context, last, found, (pair[last] & np.uint64(0xFFFFFFFF)).astype(np.int64), two)[own]
            full = np.add.reduceat(p, at)
        return pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n), pa.array(known), pa.array(np.full(len(n), total)), pa.array(base), pa.array(full)], ["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    def run(batches):
        trie = Trie(files) if files else None
        for b in text_batches(batches, SLICE):
            out = scored(trie, b)
            del b
            yield out
            del out

    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(run, schema)


def fit_and_score(docs: DataFrame, held_out: Column, least: int = 1) -> DataFrame:
    """Learns from the rows of docs where held_out is false and scores all: doc_id, held_out and the columns of score().

    Null and empty texts are one end token, repeated rows count and are scored each, other columns are ignored; with
    no row to learn from, N and V are 0 and all scores 0, and an empty table gives an empty result.
    """
    rows = docs.select("doc_id", "text")
    files = train(rows.where(~held_out), scratch(docs.sparkSession), least)
    return score(rows, files).withColumn("held_out", held_out).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
