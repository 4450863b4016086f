"""N-gram Jaccard join by chosen paths.

Texts become sets of hashed word n-grams; texts with equal sets are one from then on.  A sketch of each set (one
minimum for each of 128 ranges of a hash) is split DEPTH times: at each step every element of the sketch is chosen with
a probability of 1 / (density * elements), by a hash of the path so far that all sets share, and sets that chose the
same path meet in a bucket.  All paths are as long, so whether two sets meet depends on these two alone and not on how
many others there are.  Buckets are compared on signatures (four bits of each element of the sketch): small ones by
brute force in the task that reads them, larger ones in pairs of blocks, with the same groups either way.  Runs repeat
until pairs at the threshold are found with the target recall.

What the buckets give are candidates at a looser threshold, as spanning edges, so a group of copies costs its size and
not its square.  Their connected components are then compared exactly, all pairs of whole sets, in blocks of a bounded
number of n-grams; that step finds every link within a component.  It reads the texts again and lets a Bloom filter of
fixed size choose the few whose sets are in a component, so that n-grams of other texts are neither kept nor shuffled.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .components import components
from .line_dedup import text_hashes
from .shared import bloom, distinct, drop, fresh, keep, may_hold, mix, release, scratch, spans, text_batches, text_bytes, word_hashes

SHINGLE, THRESHOLD, RECALL = 5, 0.8, 0.9995
#: Ranges of the sketch; choices: 1 / DENSITY elements a step on average; steps of a path; sets in a bucket for brute force.
RANGES, DENSITY, DEPTH, BUCKET = 128, 0.5, 2, 400
#: Buckets of up to SMALL sets are compared side by side; sets in a block of a bucket of over BUCKET.
SMALL, LEAD = 32, 20_000
#: N-grams in a block of the exact comparison.
BLOCK = 500_000
#: Signatures estimate to about 0.035; candidates are what comes within 3.5 of that.
LOOSE = 0.68
#: Share of the sketch (16 bits an element, so without chance hits) that sets with a common rarest element agree in; a pair at the threshold falls short of it by 5 deviations.
SURE = 0.62
#: Sets of which a task remembers that it sent them.
MEMO = 100_000


def runs(threshold: float = THRESHOLD, recall: float = RECALL, density: float = DENSITY, depth: int = DEPTH) -> int:
    """Runs so that a pair at the threshold meets in one of them with probability `recall` after all steps."""
    p = 1.0
    for _ in range(depth):
        p = 1 - math.exp(-p * threshold / density)
    return math.ceil(math.log(1 - recall) / math.log(1 - p))


def shingles(data: np.ndarray, cuts: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """The text's number and the hash of each distinct word n-gram, in order of both; a text of fewer words, but not none, has one."""
    starts, h = word_hashes(data, cuts)
    at = np.searchsorted(starts, cuts)
    n = np.diff(at)
    grams = np.zeros(len(h), np.uint64)
    for k in range(size):
        grams[: max(0, len(h) - k)] = grams[: max(0, len(h) - k)] * np.uint64(0x9E3779B97F4A7C15) + h[k:]
    text = np.repeat(np.arange(len(n)), n)
    whole = np.arange(len(h)) <= at[1:][text] - size
    short = np.flatnonzero((n > 0) & (n < size))
    own = np.zeros(len(short), np.uint64)
    for r, i in enumerate(short.tolist()):
        v = int(n[i])
        for x in h[at[i] : at[i + 1]].tolist():
            v = (v * 0xD6E8FEB86659FD93 + x) % (1 << 64)
        own[r] = v
    text, grams = np.concatenate([text[whole], short]), mix(np.concatenate([grams[whole], own]))
    if len(short):
        order = np.argsort(text, kind="stable")
        text, grams = text[order], grams[order]
    return distinct(text, grams)


def names(items: np.ndarray, at: np.ndarray) -> list[int | None]:
    """The name of each set of items, None for an empty one."""
    full = np.diff(at) > 0
    out = np.zeros(len(full), np.int64)
    if full.any():
        out[full] = np.add.reduceat(mix(items, 11), at[:-1][full]).view(np.int64)
    return [x if f else None for x, f in zip(out.tolist(), full.tolist(), strict=True)]


def sketches(of: np.ndarray, items: np.ndarray, texts: int) -> np.ndarray:
    """The least item in each of RANGES ranges, as 16 bits from 1 on; 0 where there is none.  Items are ordered by text and value."""
    slot = of * RANGES + (items >> np.uint64(44 - RANGES.bit_length() + 1)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], slot[1:] != slot[:-1]])[: len(slot)])
    out = np.zeros(texts * RANGES, np.uint16)
    out[slot[first]] = (items[first] & np.uint64(0xFFFF)) % np.uint64(65535) + np.uint64(1)
    return out.reshape(texts, RANGES)


def signatures(sk: np.ndarray) -> np.ndarray:
    """Four bits of each element of the sketches (0 where there is none), bit by bit: 8 numbers of 64 bits a sketch."""
    code = np.where(sk > 0, sk % 15 + 1, 0).astype(np.uint8)
    return np.concatenate([np.packbits(code >> k & 1, axis=1) for k in range(4)], 1).view(np.uint64)


def describe(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """doc_id, h (of the text), s (of the set, null if the text has no words), n and sketch for each row."""
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches):
        for b in text_batches(batches, 2_000_000):
            data, cuts = text_bytes(b.column("text"))
            of, items = shingles(data, cuts, size)
            n = np.bincount(of, minlength=b.num_rows)
            sk = [x.tobytes() for x in sketches(of, items, b.num_rows)]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(text_hashes(data, cuts)), pa.array(names(items, spans(n)), pa.int64()), pa.array(n.astype(np.int32)), pa.array(sk, pa.binary())],
                ["doc_id", "h", "s", "n", "sketch"],
            )

    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(run, f"doc_id {kind}, h long, s long, n int, sketch binary")


def _binary(column, kind, width: int) -> np.ndarray:
    raw = column.to_pylist()
    return np.frombuffer(b"".join(raw), kind).reshape(len(raw), width)


def paths(sk: np.ndarray, base: np.ndarray, density: float = DENSITY) -> tuple[np.ndarray, np.ndarray]:
    """The elements that rows with paths `base` choose: row numbers and new paths."""
    token = mix((np.arange(RANGES, dtype=np.uint64) << np.uint64(16))[None, :] | sk.astype(np.uint64), 2)
    v = mix(token ^ base[:, None], 3)
    share = np.minimum(1.0, 1 / (density * np.maximum(1, (sk > 0).sum(1))))
    r, c = np.nonzero((sk > 0) & ((v >> np.uint64(11)).astype(np.float64) * 2.0**-53 < share[:, None]))
    return r, mix(v[r, c], 4)


def _choose(count: int, depth: int):
    """Rows (bucket, s, sig) of the paths of `depth` elements that sets choose in `count` runs."""

    def run(batches):
        for b in batches:
            for i in range(0, b.num_rows, 2048):
                part = b.slice(i, 2048)
                sk, s = _binary(part.column("sketch"), "<u2", RANGES), part.column("s").to_numpy(zero_copy_only=False)
                sig = signatures(sk)
                for base in mix(np.arange(count, dtype=np.uint64), 5):
                    row, path = np.arange(len(sk)), np.full(len(sk), base)
                    for _ in range(depth):
                        at, path = paths(sk[row], path)
                        row = row[at]
                    yield pa.RecordBatch.from_arrays([pa.array(path.view(np.int64)), pa.array(s[row]), pa.array([x.tobytes() for x in sig[row]], pa.binary())], ["bucket", "s", "sig"])

    return run


def alike(sig: np.ndarray, has: np.ndarray, u, v, loose: float = LOOSE) -> np.ndarray:
    """Whether signatures u and v (index arrays that may broadcast) agree in at least `loose` of the ranges that either has; has: which ranges each has."""
    agree, either = 0, 0
    for k in (0, 1):
        differ = sig[u, k] ^ sig[v, k]
        for j in (2, 4, 6):
            differ = differ | (sig[u, j + k] ^ sig[v, j + k])
        hu, hv = has[u, k], has[v, k]
        agree = agree + np.bitwise_count(~differ & hu)
        either = either + np.bitwise_count(hu | hv)
    return agree >= np.float32(loose) * either


def _has(sig: np.ndarray) -> np.ndarray:
    return sig[:, 0:2] | sig[:, 2:4] | sig[:, 4:6] | sig[:, 6:8]


def stars(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The least row of each row's component in the graph of pairs (u, v)."""
    least = np.arange(n)
    while len(u):
        a, b = least[u], least[v]
        low = np.minimum(a, b)
        np.minimum.at(least, a, low)  # at the least rows of both, so that all their rows come along
        np.minimum.at(least, b, low)
        while (least[least] != least).any():
            least = least[least]
        differ = least[u] != least[v]
        u, v = u[differ], v[differ]
    return least


def beside(number: np.ndarray, sig: np.ndarray) -> np.ndarray:
    """Components (their least rows) of rows alike in the same bucket of up to BUCKET or so; rows are sorted by the bucket's number."""
    has = _has(sig)
    edge = np.flatnonzero(np.concatenate([[True], number[1:] != number[:-1], [True]]))
    count = np.diff(edge)
    us, vs = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    small = np.flatnonzero(np.repeat((count > 1) & (count <= SMALL), count))
    end = np.repeat(edge[1:], count)
    i, d = small, 1
    while len(i := i[i + d < end[i]]):
        ok = i[alike(sig, has, i, i + d)]
        us.append(ok + d)
        vs.append(ok)
        d += 1
    for k in np.flatnonzero(count > SMALL).tolist():
        own = np.arange(edge[k], edge[k + 1])
        u, v = np.nonzero(alike(sig, has, own[:, None], own[None, :]))
        us.append(own)
        vs.append(own[stars(len(own), u[u > v], v[u > v])])
    return stars(len(number), np.concatenate(us), np.concatenate(vs))


def led(sig: np.ndarray) -> np.ndarray:
    """Components (their least rows) of rows alike in one large bucket: leaders meet all rows, and groups that leaders leave apart meet by their members."""
    has, n = _has(sig), len(sig)
    least, leader = np.arange(n), np.full(n, -1)
    every, groups = np.arange(n), []

    def link(rows):
        roots = np.unique(least[rows])
        least[np.isin(least, roots)] = roots[0]

    for i in range(n):
        if leader[i] < 0:
            near = every[alike(sig, has, np.array([i]), every)]
            leader[near[leader[near] < 0]] = i
            leader[i] = i
            link(np.append(near, i))
            groups.append(i)
    members = [np.flatnonzero(leader == i) for i in groups]
    members = [x for x in members if len(x) > 1]  # one alone has met all rows
    for a in range(len(members)):
        for b in range(a):
            if least[members[a][0]] != least[members[b][0]]:
                for i in range(0, len(members[a]), 256):
                    if (alike(sig, has, members[a][i : i + 256, None], members[b][None, :])).any():
                        link(np.array([members[a][0], members[b][0]]))
                        break
    return least


def _compare(limit: int):
    """From rows sorted by bucket: edges (x, y) of sets alike; rows of a bucket of more than `limit` go on, `again`, as x (the bucket), y (the set) and sig."""

    def run(batches):
        held: list = []
        rows, large = 0, None

        def again(bucket, s, sig):
            return pa.RecordBatch.from_arrays([pa.array(bucket), pa.array(s), pa.array(np.ones(len(s), bool)), pa.array([x.tobytes() for x in sig], pa.binary())], ["x", "y", "again", "sig"])

        def edges(s, least):
            at = np.flatnonzero(least != np.arange(len(least)))
            return pa.RecordBatch.from_arrays([pa.array(s[at]), pa.array(s[least[at]]), pa.array(np.zeros(len(at), bool)), pa.nulls(len(at), pa.binary())], ["x", "y", "again", "sig"])

        def closed(bucket, s, sig):
            if len(bucket):
                edge = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]]))
                count = np.diff(edge)
                big = np.repeat(count > limit, count)
                yield edges(s[~big], beside(bucket[~big], sig[~big]))
                yield again(bucket[big], s[big], sig[big])

        def joined():
            return [np.concatenate(x) for x in zip(*held, strict=True)]

        for b in batches:
            if not b.num_rows:
                continue
            bucket, s = (b.column(c).to_numpy(zero_copy_only=False) for c in ("bucket", "s"))
            sig = _binary(b.column("sig"), np.uint64, 8)
            if large is not None:  # the bucket that is known to be large goes on
                n = int(np.searchsorted(bucket, large, "right")) if bucket[0] == large else 0
                yield again(bucket[:n], s[:n], sig[:n])
                if n == len(bucket):
                    continue
                large = None
                bucket, s, sig = bucket[n:], s[n:], sig[n:]
            held.append((bucket, s, sig))
            rows += len(bucket)
            if rows < 20_000 and len(bucket) > 1 and bucket[0] != bucket[-1]:
                continue
            every, s, sig = joined()
            at = int(np.searchsorted(every, every[-1]))
            tail = every[at:], s[at:], sig[at:]
            yield from closed(every[:at], s[:at], sig[:at])
            held, rows = [tail], len(tail[0])
            if rows > limit:
                large = tail[0][0]
                yield again(*tail)
                held, rows = [], 0
        if held:
            yield from closed(*joined())

    return run


def _tokens(sk: np.ndarray) -> np.ndarray:
    return (np.arange(RANGES, dtype=np.int64) << 16)[None, :] | sk.astype(np.int64)


def rarest(sk: np.ndarray, often: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and elements: of each row as many, the rarest first, that two rows that agree in SURE of the ranges that either has share one.

    often: elements, in order, that many rows have, and how many (counts); others come before them.  Two rows that agree
    so have SURE of their own elements in common, and of these the first in an order of all elements is among those that
    each of them gives.
    """
    token = _tokens(sk)
    many = np.zeros(token.shape, np.int64)
    if len(often):
        at = np.minimum(np.searchsorted(often, token), len(often) - 1)
        many = np.where(often[at] == token, counts[at], 0)
    order = np.lexsort((mix(token.view(np.uint64), 6), many, sk == 0), axis=1)
    k = (sk > 0).sum(1)
    r, c = np.nonzero(np.arange(RANGES)[None, :] < (k - np.ceil(SURE * k - 1e-9).astype(np.int64) + (k > 0))[:, None])
    return r, token[r, order[r, c]]


def _across(batches):
    """From rows sorted by bucket, i and j: edges (x, y) of sets alike in two blocks of a bucket."""
    held, name = [], None

    def edges():
        s, sig = (np.concatenate(x) for x in zip(*held, strict=True))
        least = led(sig)
        at = np.flatnonzero(least != np.arange(len(least)))
        return pa.RecordBatch.from_arrays([pa.array(s[at]), pa.array(s[least[at]])], ["x", "y"])

    for b in batches:
        names = np.stack([b.column(c).to_numpy(zero_copy_only=False) for c in ("bucket", "i", "j")], 1)
        s, sig = b.column("s").to_numpy(zero_copy_only=False), _binary(b.column("sig"), np.uint64, 8)
        edge = [0, *(np.flatnonzero((names[1:] != names[:-1]).any(1)) + 1).tolist(), len(names)]
        for a, e in zip(edge[:-1], edge[1:], strict=True):
            if a == e:
                continue
            if held and tuple(names[a]) != name:
                yield edges()
                held = []
            name = tuple(names[a])
            held.append((s[a:e], sig[a:e]))
    if held:
        yield edges()


def _met(rows: DataFrame, at: str) -> DataFrame:
    """Edges (a, b) that span what is alike among the sets of a bucket, for rows (bucket, s, sig); a bucket's size changes none of its components.

    Sets of a bucket of over BUCKET are dealt to blocks, and each pair of blocks is compared whole.
    """
    met = rows.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_compare(BUCKET), "x long, y long, again boolean, sig binary")
    met = keep(met, f"{at}/met")
    edges = met.where("not again").select(F.col("x").alias("a"), F.col("y").alias("b"))
    large = met.where("again").select(F.col("x").alias("bucket"), F.col("y").alias("s"), "sig")
    blocks = large.groupBy("bucket").agg(F.ceil(F.count("*") / LEAD).cast("int").alias("nb"))
    dealt = large.join(blocks, "bucket").withColumn("b", F.pmod(F.xxhash64("s"), "nb").cast("long")).withColumn("o", F.explode(F.sequence(F.lit(0).cast("long"), F.col("nb") - 1)))
    dealt = dealt.select("bucket", F.least("b", "o").alias("i"), F.greatest("b", "o").alias("j"), "s", "sig")
    across = dealt.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j").mapInArrow(_across, "x long, y long")
    across = keep(across, f"{at}/across")
    return edges.unionByName(across.select(F.col("x").alias("a"), F.col("y").alias("b")))


def _items(docs: DataFrame, wanted, size: int) -> DataFrame:
    """s, n and the n-grams of each set that the broadcast Bloom filter may hold, once a task."""

    def run(batches):
        seen: set = set()
        for b in text_batches(batches, 2_000_000):
            of, items = shingles(*text_bytes(b.column("text")), size)
            at = spans(np.bincount(of, minlength=b.num_rows))
            s = names(items, at)
            some = np.array([k for k, x in enumerate(s) if x is not None], np.int64)
            some = some[may_hold(wanted.value, np.array([s[k] for k in some.tolist()], np.int64))]
            if len(seen) > MEMO:
                seen.clear()
            some = [k for k in some.tolist() if not (s[k] in seen or seen.add(s[k]))]
            raw = [items[at[k] : at[k + 1]].tobytes() for k in some]
            yield pa.RecordBatch.from_arrays([pa.array([s[k] for k in some], pa.int64()), pa.array([len(x) // 8 for x in raw], pa.int64()), pa.array(raw, pa.binary())], ["s", "n", "items"])

    return docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "s long, n long, items binary")


def exact_links(items: list[np.ndarray], apart: np.ndarray | None, threshold: float = THRESHOLD):
    """For each set the rows whose Jaccard similarity with it is at least the threshold, itself left out.

    apart: block numbers; if given, only pairs of different blocks count.  Items that many sets have are counted by a
    product of matrices, the others by the lists of sets that have them.
    """
    n = np.array([len(x) for x in items], np.int64)
    every, code = np.unique(np.concatenate(items), return_inverse=True)
    row, at, m = np.repeat(np.arange(len(items)), n), spans(n), len(items)
    count = np.bincount(code, minlength=len(every))
    often = (count > m / 16) & (m > 64)
    dense = np.zeros((m, int(often.sum())), np.float32)
    number = np.cumsum(often) - 1
    own = often[code]
    dense[row[own], number[code[own]]] = 1
    order = np.argsort(code, kind="stable")
    posting, start = row[order], spans(count)
    rare = ~often[code] & (count[code] > 1)
    for a in range(0, m, 256):
        e = min(m, a + 256)
        shared = dense[a:e] @ dense.T
        for i in range(a, e):
            mine = code[at[i] : at[i + 1]][rare[at[i] : at[i + 1]]]
            both = shared[i - a]
            if len(mine):
                size = start[mine + 1] - start[mine]
                hits = posting[np.repeat(start[mine + 1] - np.cumsum(size), size) + np.arange(int(size.sum()))]
                both = both + np.bincount(hits, minlength=m)
            ok = both >= threshold * (n[i] + n - both) - 1e-6
            ok[i] = False
            if apart is not None:
                ok &= apart != apart[i]
            yield np.flatnonzero(ok)


def _verify(threshold: float):
    """From rows sorted by root, i and j: for each set of a group its least alike set (the least of the component there) and its number of links."""

    def settle(rows):
        s, block = np.array([r[3] for r in rows], np.int64), np.array([r[4] for r in rows], np.int64)
        items = [np.frombuffer(r[5], np.uint64) for r in rows]
        across = rows[0][1] != rows[0][2]
        u, v, degree = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], np.zeros(len(s), np.int64)
        least, held = np.arange(len(s)), 0
        for i, near in enumerate(exact_links(items, block if across else None, threshold)):
            degree[i] = len(near)
            u.append(np.full(len(near), i))
            v.append(near)
            held += len(near)
            if held > 1_000_000:  # pairs become components before there are many
                least = stars(len(s), np.concatenate([*u, np.arange(len(s))]), np.concatenate([*v, least]))
                u, v, held = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0
        least = stars(len(s), np.concatenate([*u, np.arange(len(s))]), np.concatenate([*v, least]))
        return pa.RecordBatch.from_arrays([pa.array(s), pa.array(s[least]), pa.array(degree)], ["s", "root", "links"])

    def run(batches):
        rows: list = []
        for b in batches:
            for r in zip(*(b.column(c).to_pylist() for c in ("root", "i", "j", "s", "b", "items")), strict=True):
                if rows and rows[0][:3] != r[:3]:
                    yield settle(rows)
                    rows = []
                rows.append(r)
        if rows:
            yield settle(rows)

    return run


def join(docs: DataFrame, threshold: float = THRESHOLD, size: int = SHINGLE, recall: float = RECALL) -> DataFrame:
    """doc_id, h, class_id, first, n_links, n_copies, n_shingles for each row of docs (doc_id, text).

    class_id is the least doc_id of the connected component of similar texts, first marks one row key (doc_id and h,
    the text's hash) of each class, n_links counts the different texts (n-gram sets) similar to this one, n_copies the
    other rows with the same set.  Null and empty texts are alone in their class (of their own doc_id) and all `first`.
    Repeated rows share a class; rows that repeat doc_id and text also share `first`.  Null ids come before others.
    """
    spark, at = docs.sparkSession, scratch(docs.sparkSession)
    described = keep(describe(docs, size), f"{at}/described")
    sets = keep(described.where("s is not null").select("s", "sketch").dropDuplicates(["s"]), f"{at}/sets")
    edges = _met(sets.mapInArrow(_choose(runs(threshold, recall, depth=DEPTH), DEPTH), "bucket long, s long, sig binary"), at)
    loose = keep(components(edges, f"{at}/loose"), f"{at}/loose-roots").withColumnRenamed("node", "s")
    release(spark)
    own = _items(docs, spark.sparkContext.broadcast(bloom(loose, "s", loose.count())), size)
    items = keep(own.join(loose, "s").dropDuplicates(["s"]), f"{at}/items")
    blocks = items.groupBy("root").agg(F.ceil(F.sum("n") / BLOCK).cast("int").alias("nb"))
    dealt = items.join(blocks, "root").withColumn("b", F.pmod(F.xxhash64("s"), "nb").cast("long")).withColumn("o", F.explode(F.sequence(F.lit(0).cast("long"), F.col("nb") - 1)))
    dealt = dealt.select("root", F.least("b", "o").alias("i"), F.greatest("b", "o").alias("j"), "s", "b", "items")
    checked = dealt.repartition("root", "i", "j").sortWithinPartitions("root", "i", "j").mapInArrow(_verify(threshold), "s long, root long, links long")
    checked = keep(checked, f"{at}/checked")
    roots = components(checked.where("s != root").select(F.col("s").alias("a"), F.col("root").alias("b")), f"{at}/exact")
    links = checked.groupBy("s").agg(F.sum("links").alias("n_links"))
    light = described.select("doc_id", "h", "s", F.col("n").alias("n_shingles"))
    copies = light.where("s is not null").groupBy("s").agg(F.count("*").alias("rows"), F.min_by(F.struct("doc_id", "h"), F.struct("doc_id", "h")).alias("one"))
    of = copies.join(roots.withColumnRenamed("node", "s"), "s", "left").withColumn("root", F.coalesce("root", "s")).join(links, "s", "left")
    classes = of.groupBy("root").agg(F.min("one").alias("first"))
    known = of.join(classes, "root").select("s", "rows", "first", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"))
    out = light.join(known, "s", "left")
    out = out.select(
        "doc_id",
        "h",
        F.when(F.col("s").isNull(), F.col("doc_id")).otherwise(F.col("first.doc_id")).alias("class_id"),
        (F.col("s").isNull() | (F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("h") == F.col("first.h")))).alias("first"),
        F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"),
        (F.coalesce("rows", F.lit(1).cast("long")) - 1).alias("n_copies"),
        "n_shingles",
    )
    out = keep(out, f"{at}/classes")
    drop(spark, *(f"{at}/{x}" for x in ("described", "sets", "met", "across", "loose", "loose-roots", "items", "checked", "exact")))
    release(spark)
    return out


def one_of_each(docs: DataFrame, threshold: float = THRESHOLD, size: int = SHINGLE) -> DataFrame:
    """The rows of docs, with all their columns, of which one stays for each class.

    Of rows that repeat doc_id and text that one stays whose columns come first, written as JSON.
    """
    d, g, k, h, n = fresh(docs.columns, "id", "key", "k", "h", "n")
    found = join(docs, threshold, size)
    gone = found.where("not first").select(F.col("doc_id").alias(d), F.col("h").alias(g)).distinct().withColumn(k, F.lit(0))
    again = found.where("first and n_shingles > 0").groupBy("doc_id", "h").agg(F.count("*").alias(k)).where(F.col(k) > 1).select(F.col("doc_id").alias(d), F.col("h").alias(g), F.lit(2).alias(k))

    def key(batches):
        for b in text_batches(batches, 2_000_000):
            yield b.append_column(h, pa.array(text_hashes(*text_bytes(b.column("text")))))

    keyed = docs.mapInArrow(key, T.StructType([*docs.schema.fields, T.StructField(h, T.LongType())]))
    marks = keep(gone.unionByName(again), scratch(docs.sparkSession) + "/marks")  # a row a text that goes or that repeats
    marked = keyed.join(marks, F.col("doc_id").eqNullSafe(F.col(d)) & (F.col(h) == F.col(g)), "left")
    number = F.row_number().over(Window.partitionBy("doc_id", h).orderBy(F.to_json(F.struct(*docs.columns))))
    once = marked.where(F.col(k).isNull()).select(*docs.columns)
    more = marked.where(F.col(k) == 2).withColumn(n, number).where(F.col(n) == 1).select(*docs.columns)
    return once.unionByName(more)
