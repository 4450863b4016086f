"""Line dedup by an exact set-similarity join.

A line's set is its distinct words.  A line goes if an earlier one has the same set or a set of Jaccard similarity of the
threshold or more; lines are in order of doc_id and line number, then (of different texts with one id) of the set's name.  Words are ordered by rarity; two similar sets must share
one of their few rarest words (the prefix), at positions and with sizes that still allow the overlap; a bitmap of the
words' parities bounds the overlap further.  Of the earlier lines that a line meets at a word the few with the closest bitmaps
are verified first, which settles groups of copies at the cost of their size; only lines that this leaves, with more
candidates, are checked against all of them.

Texts are read again for each step (counting words, postings, the words of candidates) rather than kept as words: to
split and hash them costs little, and what is kept and shuffled stays small.  A step that needs few of the sets lets a
Bloom filter of fixed size choose them before the shuffle.

Rarity comes from the counts of words hashed to a table of fixed size: any common order gives the exact result, the
counts only keep meetings few.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import WORD_BITS, Table, add_counts, bloom, distinct, drop, fresh, keep, may_hold, mix, release, scratch, spans, text_batches, text_bytes, word_hashes

THRESHOLD = 0.8
#: Counters of the rarity table, one byte each when sent: a word's count as eight times its binary logarithm.
COUNTERS = 1 << 22
#: Candidates of a set in a group that are verified first, and sets from which on a word's sets are dealt to several groups.
FIRST, LARGE = 4, 1 << 22
#: How close a candidate is: the words in which it seems to differ, as a share of what the threshold allows.  A set whose
#: closest one is at a limit or beyond has so many times FIRST.
CLOSE = ((0.0, 1), (0.15, 8), (0.4, 64))
#: Sets of which a task remembers that it sent them.
MEMO = 100_000
#: Groups of up to SMALL sets are compared side by side; larger ones alone, in blocks of sets and windows of others.
SMALL, BLOCK, WINDOW = 96, 256, 2048
#: Words from which on a set also has a bitmap of WIDE bits.
LONG, WIDE = 160, 512
#: The earliest sets of a larger group, which all others meet first.
HEAD = 64


def text_hashes(data: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    return np.array([xxhash.xxh3_64_intdigest(data[i:j]) for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)], np.uint64).view(np.int64)


@dataclass
class Lines:
    """The sets of the lines that have words, in order of text and line."""

    per: np.ndarray  # each text's number of lines
    text: np.ndarray  # each set's text
    line: np.ndarray  # and line in it
    size: np.ndarray
    words: np.ndarray  # all sets' words' hashes, one set after another
    at: np.ndarray  # where each set starts in words, and the last ends
    names: tuple[np.ndarray, np.ndarray]  # 128 bits


def split(data: np.ndarray, cuts: np.ndarray) -> Lines:
    starts, h = word_hashes(data, cuts)
    feeds = np.flatnonzero(data == 10)
    full = np.diff(cuts) > 0
    per = np.where(full, 1 + np.diff(np.searchsorted(feeds, cuts)), 0)
    begin = np.sort(np.concatenate([cuts[:-1][full], feeds + 1]))  # of all lines; a feed that ends a text begins its last line
    count = np.diff(np.searchsorted(starts, np.append(begin, len(data) + 1)))
    text = np.repeat(np.arange(len(per)), per)
    line = np.arange(len(begin)) - spans(per)[:-1][text]
    some = np.flatnonzero(count)
    of, words = distinct(np.repeat(np.arange(len(some)), count[some]), h)
    size = np.bincount(of, minlength=len(some))
    at = spans(size)
    names = tuple(np.add.reduceat(mix(words, k), at[:-1]).view(np.int64) if len(some) else np.zeros(0, np.int64) for k in (11, 12))
    return Lines(per, text[some], line[some], size, words, at, names)


def _source(docs: DataFrame) -> DataFrame:
    kind = dict(docs.dtypes)["doc_id"]
    if kind not in ("tinyint", "smallint", "int", "bigint"):
        raise TypeError(f"doc_id is {kind}; line dedup orders lines by integer ids")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


_COUNTS = Table(COUNTERS, np.int64, np.add)


def lines(docs: DataFrame, words: int = 1) -> DataFrame:
    """A row for each line of at least `words` distinct words: doc_id, h (of the text), line, n, s and s2 (the set's name).

    Each document also has one row of line -1, with n its number of lines; rows of line -2 hold parts (k in n, salt in
    s, v) of the table of COUNTERS word counts.
    """
    names = ["doc_id", "h", "line", "n", "s", "s2", "v"]

    def run(batches):
        counts = np.zeros(COUNTERS, np.int32)
        for b in text_batches(batches, 2_000_000):
            data, cuts = text_bytes(b.column("text"))
            x, th = split(data, cuts), text_hashes(data, cuts)
            add_counts(counts, x.words & np.uint64(COUNTERS - 1))
            big, none = np.flatnonzero(x.size >= words), np.zeros(len(th), np.int64)
            doc = np.concatenate([np.arange(len(th)), x.text[big]])
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("doc_id").take(pa.array(doc)),
                    pa.array(th[doc]),
                    pa.array(np.concatenate([none - 1, x.line[big]]).astype(np.int32)),
                    pa.array(np.concatenate([x.per, x.size[big]]).astype(np.int32)),
                    *[pa.array(np.concatenate([none, s[big]])) for s in x.names],
                    pa.nulls(len(doc), pa.binary()),
                ],
                names,
            )
        k, salt, v = _COUNTS.rows(counts)
        zero = pa.array(np.zeros(len(k), np.int64))
        yield pa.RecordBatch.from_arrays([zero, zero, pa.array(np.full(len(k), -2, np.int32)), pa.array(k, pa.int32()), pa.array(salt, pa.int64()), zero, pa.array(v, pa.binary())], names)

    return _source(docs).mapInArrow(run, "doc_id long, h long, line int, n int, s long, s2 long, v binary")


def rarity(table: DataFrame) -> np.ndarray:
    """For each of COUNTERS classes of words eight times the binary logarithm of its count; 0 where a word is in one line."""
    n = _COUNTS.total(table.where("line = -2").select(F.col("n").alias("k"), F.col("s").cast("int").alias("salt"), "v"))
    return np.minimum(np.ceil(8 * np.log2(np.maximum(n, 1))), 255).astype(np.uint8)


def _postings(sent, firsts, threshold: float, words: int, large: int, wanted=None):
    """Rows of the sets' prefix words: g (the word), s, doc_id, line, size (and position), b1, b2 and wide (bitmaps).

    A word that is in one line only is left out, as is a set that a task sent before from no later place, and one that
    comes first in another document (by the broadcast Bloom filter `firsts` of sets in their first documents).
    wanted: a broadcast Bloom filter of the groups to send.
    """

    def run(batches):
        often_of, seen = sent.value, {}
        for b in text_batches(batches, 2_000_000):
            x = split(*text_bytes(b.column("text")))
            ids = b.column("doc_id").fill_null(-(1 << 63)).to_numpy(zero_copy_only=False)
            # a set that one more word makes too different is similar to its equals only, which its name finds
            ok = np.flatnonzero((x.size >= words) & (x.size >= threshold * (x.size + 1) - 1e-9))
            ok = ok[may_hold(firsts.value, _in_document(x.names[0][ok], ids[x.text[ok]]))]
            stay = np.zeros(len(ok), bool)
            if len(seen) > MEMO:
                seen.clear()
            own = {}
            for k, (s, *place) in enumerate(zip(x.names[0][ok].tolist(), ids[x.text[ok]].tolist(), x.line[ok].tolist(), strict=True)):
                if (old := seen.get(s)) is None or place < old:
                    seen[s] = place
                    stay[k] = True
                    if s in own:
                        stay[own[s]] = False
                    own[s] = k
            ok = ok[stay]
            if not len(ok):
                continue
            n = x.size[ok]
            row, starts = np.repeat(np.arange(len(ok)), n), spans(n)[:-1]
            rank = np.arange(len(row)) - np.repeat(starts, n)
            w = x.words[np.repeat(x.at[ok], n) + rank]
            bits = [np.bitwise_xor.reduceat(np.where((w >> np.uint64(WORD_BITS - 1)) == k, np.uint64(1) << (w >> np.uint64(WORD_BITS - 7) & np.uint64(63)), np.uint64(0)), starts).view(np.int64) for k in (0, 1)]
            often = often_of[(w & np.uint64(COUNTERS - 1)).astype(np.int64)]
            # by set, rarity and (as they come) hash
            low = int(n.max()).bit_length()
            order = np.sort((row << (low + 8)) | (often.astype(np.int64) << low) | rank)
            often, place = (order >> low) & 255, rank
            prefix = n - np.ceil(threshold * n - 1e-9).astype(np.int64) + 1
            take = (place < prefix[row]) & (often > 0)
            at, often, position = row[take], often[take], place[take]
            g = w[starts[at] + (order[take] & ((1 << low) - 1))]
            # a very frequent word is dealt to groups of two blocks each, so that any two of its sets share a group
            blocks = np.ceil(2.0 ** (often / 8) / large).astype(np.int64)
            if (blocks > 1).any():
                parts = [tuple(v[blocks <= 1] for v in (g, at, position))]
                for k in np.flatnonzero(blocks > 1).tolist():
                    nb = int(blocks[k])
                    mine = int(x.names[0][ok[at[k]]]) % nb
                    i, j = np.minimum(mine, np.arange(nb)).astype(np.uint64), np.maximum(mine, np.arange(nb)).astype(np.uint64)
                    parts.append((mix(mix(g[k] ^ (i << np.uint64(44)), 1) ^ j, 2), np.full(nb, at[k]), np.full(nb, position[k])))
                g, at, position = (np.concatenate(v) for v in zip(*parts, strict=True))
            if wanted is not None:
                some = may_hold(wanted.value, g.view(np.int64))
                g, at, position = g[some], at[some], position[some]
            wide = {k: np.packbits(np.bincount((mix(x.words[x.at[ok[k]] : x.at[ok[k] + 1]], 13) & np.uint64(WIDE - 1)).astype(np.int64), minlength=WIDE) & 1).tobytes() for k in np.flatnonzero(n > LONG).tolist()}
            far = pa.array([wide.get(k) for k in range(len(ok))], pa.binary()).take(pa.array(at)) if wide else pa.nulls(len(at), pa.binary())
            cols = (g.view(np.int64), x.names[0][ok[at]], ids[x.text[ok[at]]], x.line[ok[at]].astype(np.int32), (n[at] << 32) | position, bits[0][at], bits[1][at], far)
            yield pa.RecordBatch.from_arrays([pa.array(c) if isinstance(c, np.ndarray) else c for c in cols], ["g", "s", "doc_id", "line", "size", "b1", "b2", "wide"])

    return run


def _in_document(s: np.ndarray, doc_id: np.ndarray) -> np.ndarray:
    return (mix(s.view(np.uint64), 14) ^ mix(doc_id.view(np.uint64), 15)).view(np.int64)


_POSTING = "g long, s long, doc_id long, line int, size long, b1 long, b2 long, wide binary"


def differing(apart: np.ndarray, bits: int) -> np.ndarray:
    """About how many words two sets differ in whose bitmaps differ in so many bits."""
    return -bits / 2 * np.log(np.maximum(1 - 2 * apart / bits, 0.01))


class Rows:
    """Sets of one or more groups: sizes n, positions p of the shared word, bitmaps, and places that order them."""

    def __init__(self, n, p, b1, b2, place, threshold: float):
        self.n, self.p, self.b1, self.b2, self.place, self.threshold = n, p, b1, b2, place, threshold
        # what the sizes allow two bitmaps to differ by is at most the sum of these
        self.room = (n * (1 - 2 * threshold / (1 + threshold)) + 0.01).astype(np.float32)

    def take(self, at) -> Rows:
        return Rows(self.n[at], self.p[at], self.b1[at], self.b2[at], [x[at] for x in self.place], self.threshold)

    def apart(self, u, v) -> np.ndarray:
        return np.bitwise_count(self.b1[u] ^ self.b1[v]) + np.bitwise_count(self.b2[u] ^ self.b2[v])

    def near(self, u, v) -> np.ndarray:
        """Whether bitmaps of rows u and v (index arrays that may broadcast) are near enough for their sizes."""
        return self.apart(u, v) <= self.room[u] + self.room[v]

    def allowed(self, u, v) -> np.ndarray:
        both = self.n[u] + self.n[v]
        return both - 2 * np.ceil(self.threshold / (1 + self.threshold) * both - 1e-9)

    def pairs(self, u, v):
        """Of pairs of rows those that sizes, positions and bitmaps allow, as (later, earlier) by place, and how far apart they are."""
        nu, nv = self.n[u], self.n[v]
        need = np.ceil(self.threshold / (1 + self.threshold) * (nu + nv) - 1e-9)
        ok = (np.minimum(nu, nv) >= self.threshold * np.maximum(nu, nv) - 1e-9) & (np.minimum(nu - self.p[u], nv - self.p[v]) >= need)
        u, v = u[ok], v[ok]
        apart, allowed = self.apart(u, v), self.allowed(u, v)
        ok = apart <= allowed
        u, v, far = u[ok], v[ok], differing(apart[ok], 128) / np.maximum(allowed[ok], 1)
        before, same = np.zeros(len(u), bool), np.ones(len(u), bool)
        for x in self.place:
            before |= same & (x[u] < x[v])
            same &= x[u] == x[v]
        return np.where(before, v, u), np.where(before, u, v), far


def closest(u, v, far, most: int):
    """Of each row's pairs the `most` closest, or several times as many where none is close; and the rows that have more."""
    if not len(u):
        return u, v, far, u
    by = np.lexsort((v, far, u))
    u, v, far = u[by], v[by], far[by]
    first = np.flatnonzero(np.concatenate([[True], u[1:] != u[:-1]]))
    count = np.diff(np.append(first, len(u)))
    rank = np.arange(len(u)) - np.repeat(first, count)
    times = np.array([t for _, t in CLOSE])[np.searchsorted([f for f, _ in CLOSE], far[first], "right") - 1]
    stay = rank < np.repeat(most * times, count)
    return u[stay], v[stay], far[stay], u[~stay]


def _beside(g, rows: Rows):
    """Pairs (later, earlier) of rows of the same group and how far apart they are, for many small groups at once; rows are sorted by group."""
    end = np.searchsorted(g, g, "right")
    us, vs = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    i, d = np.arange(len(g)), 1
    while len(i := i[i + d < end[i]]):
        ok = i[rows.near(i, i + d)]
        us.append(ok + d)
        vs.append(ok)
        d += 1
    return rows.pairs(np.concatenate(us), np.concatenate(vs))


def _within(rows: Rows, wanted, most: int | None):
    """Pairs (later, earlier) of one group for the later rows `wanted`, how far apart they are; and the rows that may have more.

    With `most`, a row that has so many close pairs among the earliest HEAD rows meets no others, so a group of copies
    costs its size.
    """
    m, size = len(rows.n), rows.n
    head = np.lexsort(rows.place[::-1])[:HEAD]
    found, more = [], [np.zeros(0, np.int64)]

    def meet(own, other):
        u, v = np.nonzero(rows.near(own[:, None], other[None, :]))
        u, v = own[u], other[v]
        differ = u != v
        u, v, far = rows.pairs(u[differ], v[differ])
        return u, v, far

    for a in range(0, m, WINDOW):
        every = np.arange(a, min(a + WINDOW, m))
        found.append(meet(every, head))
    in_head = np.zeros(m, bool)
    in_head[head] = True
    if most is not None:
        u, v, far = (np.concatenate(x) for x in zip(*found, strict=True))
        done = np.zeros(m, bool)
        for (times, below) in zip((t for _, t in CLOSE), (f for f, _ in CLOSE[1:]), strict=False):
            done |= np.bincount(u[(far < below) & in_head[v]], minlength=m) >= times * most
        more.append(np.flatnonzero(done & ~in_head))
        wanted = wanted[~done[wanted]]
    wanted = wanted[~in_head[wanted]]
    by = np.argsort(size, kind="stable")
    by = by[~in_head[by]]
    ordered = size[by]
    wanted = wanted[np.argsort(size[wanted], kind="stable")]
    asked = np.zeros(m, bool)
    asked[wanted] = True
    for a in range(0, len(wanted), BLOCK):
        own = wanted[a : a + BLOCK]
        lo, hi = np.searchsorted(ordered, rows.threshold * size[own[0]] - 1e-9), np.searchsorted(ordered, size[own[-1]] / rows.threshold + 1e-9, "right")
        parts = []
        for w in range(int(lo), int(hi), WINDOW):
            u, v, far = meet(own, by[w : min(w + WINDOW, int(hi))])
            ok = asked[u]
            parts.append((u[ok], v[ok], far[ok]))
            if most is not None and sum(len(x[0]) for x in parts) > 4 * BLOCK * CLOSE[-1][1] * most:
                *part, rest = closest(*(np.concatenate(x) for x in zip(*parts, strict=True)), most)
                parts = [tuple(part)]
                more.append(rest)
        found += parts
    u, v, far = (np.concatenate(x) for x in zip(*found, strict=True))
    # a pair of two wanted rows, or of two of the head, turns up from both sides
    _, one = np.unique(u * m + v, return_index=True)
    return u[one], v[one], far[one], np.unique(np.concatenate(more))


def _candidates(threshold: float, most: int | None):
    """From postings sorted by group: rows (g, s, t, far, more) of sets s and earlier candidates t of them.

    With `most`, each set has its `most` closest candidates in the group (several times as many where none is close), and
    `more` says whether there may be others; without it each set with the flag `open` has all of them.
    """

    def settle(g, s, doc_id, line, n, p, b1, b2, wanted, wide):
        number = np.cumsum(np.concatenate([[True], g[1:] != g[:-1]]))
        key = (s ^ mix(number.astype(np.uint64)).view(np.int64)).view(np.uint64)
        by = np.argsort(key, kind="stable")
        if (key[by][1:] == key[by][:-1]).any():  # of a set's rows in a group the first stays
            by = np.lexsort((line, doc_id, s, number))
            again = (s[by][1:] == s[by][:-1]) & (number[by][1:] == number[by][:-1])
            stay = np.sort(by[np.concatenate([[True], ~again])])
        else:
            stay = np.arange(len(s))
        g, s, wanted, number = g[stay], s[stay], wanted[stay], number[stay]
        rows = Rows(n[stay], p[stay], b1[stay], b2[stay], [doc_id[stay], line[stay], s], threshold)
        edge = np.flatnonzero(np.concatenate([[True], number[1:] != number[:-1], [True]]))
        count = np.diff(edge)
        small = np.flatnonzero(np.repeat((count > 1) & (count <= SMALL), count))
        u, v, far = _beside(number[small], rows.take(small))
        found, more = [(small[u], small[v], far)], [np.zeros(0, np.int64)]
        for k in np.flatnonzero(count > SMALL).tolist():
            i, j = int(edge[k]), int(edge[k + 1])
            own = np.arange(j - i) if most is not None else np.flatnonzero(wanted[i:j])
            if len(own):
                u, v, far, rest = _within(rows.take(slice(i, j)), own, most)
                found.append((u + i, v + i, far))
                more.append(rest + i)
        u, v, far = (np.concatenate(x) for x in zip(*found, strict=True))
        long = np.flatnonzero((rows.n[u] > LONG) & (rows.n[v] > LONG))
        if len(long):
            x, y = (np.frombuffer(b"".join(wide.take(pa.array(stay[w[long]])).to_pylist()), np.uint64).reshape(len(long), -1) for w in (u, v))
            apart, allowed = np.bitwise_count(x ^ y).sum(1), rows.allowed(u[long], v[long])
            far[long] = differing(apart, WIDE) / np.maximum(allowed, 1)
            bad = long[apart > allowed]
            u, v, far = np.delete(u, bad), np.delete(v, bad), np.delete(far, bad)
        if most is None:
            u, v, far = u[wanted[u]], v[wanted[u]], far[wanted[u]]
        else:
            u, v, far, rest = closest(u, v, far, most)
            more.append(rest)
        some = np.zeros(len(s), bool)
        some[np.concatenate(more)] = True
        # a set that may have candidates beyond those it ends with has a row of its own
        alone = np.setdiff1d(np.flatnonzero(some), u)
        none = np.concatenate([np.zeros(len(v), bool), np.ones(len(alone), bool)])
        u, v, far = np.concatenate([u, alone]), np.concatenate([v, alone]), np.concatenate([far, np.zeros(len(alone))])
        return pa.RecordBatch.from_arrays([pa.array(g[u]), pa.array(s[u]), pa.array(s[v], mask=none), pa.array(far), pa.array(some[u])], ["g", "s", "t", "far", "more"])

    def run(batches):
        held: list = []

        def close():
            *cols, wide = zip(*held, strict=True)
            return settle(*(np.concatenate(x) for x in cols), pa.concat_arrays(wide))

        rows = 0
        for b in batches:
            if not b.num_rows:
                continue
            g, s, doc_id, line, size, b1, b2 = (b.column(c).to_numpy(zero_copy_only=False) for c in ("g", "s", "doc_id", "line", "size", "b1", "b2"))
            wanted = b.column("open").to_numpy(zero_copy_only=False).astype(bool) if most is None else np.zeros(len(g), bool)
            cols = [g, s, doc_id, line, size >> 32, size & 0xFFFFFFFF, b1.view(np.uint64), b2.view(np.uint64), wanted, b.column("wide")]
            last = int(np.searchsorted(g, g[-1]))
            if rows and (held[-1][0][-1] != g[0] or last) and rows + last > 100_000:
                held.append([x[:last] for x in cols])
                yield close()
                held, rows, cols = [], 0, [x[last:] for x in cols]
            held.append(cols)
            rows += len(cols[0])
        if held:
            yield close()

    return run


def _items(docs: DataFrame, wanted, words: int) -> DataFrame:
    """s, s2 and the words of each set that the broadcast Bloom filter may hold, once a task."""

    def run(batches):
        seen: set = set()
        for b in text_batches(batches, 2_000_000):
            x = split(*text_bytes(b.column("text")))
            some = np.flatnonzero((x.size >= words) & may_hold(wanted.value, x.names[0]))
            if len(seen) > MEMO:
                seen.clear()
            some = [k for k, s in zip(some.tolist(), x.names[0][some].tolist(), strict=True) if not (s in seen or seen.add(s))]
            raw = [x.words[x.at[k] : x.at[k + 1]].tobytes() for k in some]
            yield pa.RecordBatch.from_arrays([*[pa.array(v[some]) for v in x.names], pa.array(raw, pa.binary())], ["s", "s2", "items"])

    return _source(docs).mapInArrow(run, "s long, s2 long, items binary")


def _verified(pairs: DataFrame, items: DataFrame, threshold: float) -> DataFrame:
    """The sets (s, s2) of the pairs (s, t) whose similarity is exactly at least the threshold."""

    def run(batches):
        for b in batches:
            ok = []
            for x, y in zip(b.column("x").to_pylist(), b.column("y").to_pylist(), strict=True):
                u, v = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(u, v, assume_unique=True))
                ok.append(both >= threshold * (len(u) + len(v) - both) - 1e-9)
            yield b.select(["s", "s2"]).filter(pa.array(ok, pa.bool_()))

    left = pairs.join(items.withColumnRenamed("items", "x"), "s")
    both = left.join(items.select(F.col("s").alias("t"), F.col("items").alias("y")), "t")
    return both.select("s", "s2", "x", "y").mapInArrow(run, "s long, s2 long").distinct()


def removals(docs: DataFrame, threshold: float = THRESHOLD, words: int = 1, first: int = FIRST, large: int = LARGE) -> DataFrame:
    """doc_id (long), h (of the text), n_lines and removed (sorted line numbers from 0) for each different (doc_id, text), with `rows` of it.

    Lines are cut at line feeds.  Lines of fewer than `words` distinct words stay, as do null and empty texts (which
    have no lines).  Rows that repeat doc_id and text are one document.  Null ids come before all others.  Sets are
    named by 128 bits, their words by 64.
    """
    spark, at = docs.sparkSession, scratch(docs.sparkSession)
    docs = _source(docs)
    table = keep(lines(docs, words), f"{at}/lines", "zstd")
    key = F.coalesce("doc_id", F.lit(-(1 << 63)))
    own = table.where("line >= 0").select("s", "s2", key.alias("d"), "doc_id", "line", "h")
    counts = keep(own.groupBy("s", "s2").agg(F.count("*").alias("k"), F.min("d").alias("least")), f"{at}/counts", "zstd")

    def key_rows(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(_in_document(*(b.column(c).to_numpy(zero_copy_only=False) for c in ("s", "least"))))], ["x"])

    firsts = spark.sparkContext.broadcast(bloom(counts.select("s", "least").mapInArrow(key_rows, "x long"), "x", counts.count()))
    sent = spark.sparkContext.broadcast(rarity(table))  # of a fixed size

    def meet(rows: DataFrame, most: int | None) -> DataFrame:
        dealt = rows.repartition("g").sortWithinPartitions("g")
        return dealt.mapInArrow(_candidates(threshold, most), "g long, s long, t long, far double, more boolean")

    def members(pairs: DataFrame, name: str) -> DataFrame:
        both = pairs.select("s").union(pairs.select(F.col("t").alias("s")))
        kept = _items(docs, spark.sparkContext.broadcast(bloom(both, "s", 2 * pairs.count())), words)
        wanted = both.distinct()
        return keep(kept.join(wanted, "s", "left_semi").dropDuplicates(["s", "s2"]), f"{at}/{name}")

    postings = docs.mapInArrow(_postings(sent, firsts, threshold, words, large), _POSTING)
    met = keep(meet(postings, first), f"{at}/met")
    release(spark)
    # one pair a set first, its closest; the others only where that one is not similar
    pairs = keep(met.where("t is not null").groupBy("s", "t").agg(F.min("far").alias("far")), f"{at}/pairs")
    items = members(pairs, "items")
    likely = keep(_verified(pairs.groupBy("s").agg(F.min_by("t", "far").alias("t")), items, threshold), f"{at}/likely")
    others = _verified(pairs.join(likely, "s", "left_anti").select("s", "t"), items, threshold)
    early = keep(likely.unionByName(others), f"{at}/early")
    unsettled = keep(met.where("more").select("g", "s").distinct().join(early, "s", "left_anti"), f"{at}/open")
    gone = early
    if not unsettled.isEmpty():
        groups = spark.sparkContext.broadcast(bloom(unsettled, "g", unsettled.count()))
        rows = docs.mapInArrow(_postings(sent, firsts, threshold, words, large, groups), _POSTING)
        rows = rows.join(unsettled.select("g").distinct(), "g", "left_semi").join(unsettled.withColumn("open", F.lit(True)), ["g", "s"], "left")
        more = keep(meet(rows.withColumn("open", F.coalesce("open", F.lit(False))), None).select("s", "t").distinct(), f"{at}/more")
        gone = keep(early.unionByName(_verified(more, members(more, "more-items"), threshold)).distinct(), f"{at}/gone")
    gone = gone.withColumn("gone", F.lit(True))
    # the first line of a set: of its least id, and there of the least line and hash
    several = counts.join(gone, ["s", "s2"], "left").where("gone or k > 1")
    judged = keep(own.join(several.select("s", "s2", "least", "gone"), ["s", "s2"]), f"{at}/judged", "zstd")
    place = F.shiftleft(F.col("line").cast("long"), 32) + F.shiftrightunsigned(F.col("h").bitwiseXOR(F.lit(-(1 << 63))), 32)
    firsts = judged.where("gone is null and d = least").groupBy("s", "s2").agg(F.min(place).alias("place"))
    again = judged.where("gone is null").join(firsts, ["s", "s2"]).where((F.col("d") != F.col("least")) | (place != F.col("place")))
    dropped = judged.where("gone").select("doc_id", "h", "line").unionByName(again.select("doc_id", "h", "line"))
    dropped = dropped.groupBy("doc_id", "h").agg(F.sort_array(F.collect_set("line")).alias("removed"))
    whole = table.where("line = -1").groupBy("doc_id", "h").agg(F.max("n").alias("n_lines"), F.count("*").alias("rows"))
    same = whole.doc_id.eqNullSafe(dropped.doc_id) & (whole.h == dropped.h)
    out = whole.join(dropped, same, "left").select(whole.doc_id, whole.h, "n_lines", F.coalesce("removed", F.expr("cast(array() as array<int>)")).alias("removed"), "rows")
    out = keep(out, f"{at}/removals")
    drop(spark, *(f"{at}/{x}" for x in ("lines", "met", "pairs", "items", "likely", "early", "open", "more", "more-items", "gone", "judged", "counts")))
    release(spark)
    return out


def clean(docs: DataFrame, threshold: float = THRESHOLD, words: int = 1) -> DataFrame:
    """docs, with all their columns, without the lines that go; rows go of which no line but blank ones is left (and some was).

    A column n_chars, if there is one, follows the text.
    """
    d, g, h, out_of = fresh(docs.columns, "doc_id_", "h", "h_", "removed")
    gone = removals(docs, threshold, words).where("size(removed) > 0").select(F.col("doc_id").alias(d), F.col("h").alias(g), F.col("removed").alias(out_of))
    names, keyed_schema = docs.columns, T.StructType([*docs.schema.fields, T.StructField(h, T.LongType())])

    def key(batches):
        for b in text_batches(batches, 2_000_000):
            yield b.append_column(h, pa.array(text_hashes(*text_bytes(b.column("text")))))

    def rewrite(batches):
        for b in text_batches(batches, 2_000_000):
            texts, stay = [], []
            for t, r in zip(b.column("text").to_pylist(), b.column(out_of).to_pylist(), strict=True):
                if r:
                    out = set(r)
                    t = "\n".join(x for i, x in enumerate(t.split("\n")) if i not in out)
                    stay.append(bool(t.strip()))
                else:
                    stay.append(True)
                texts.append(t)
            cols = [pa.array(texts, b.schema.field(c).type) if c == "text" else b.column(c) for c in names]
            yield pa.RecordBatch.from_arrays(cols, names).filter(pa.array(stay, pa.bool_()))

    keyed = docs.mapInArrow(key, keyed_schema)
    joined = keyed.join(gone, F.col("doc_id").eqNullSafe(F.col(d)) & (F.col(h) == F.col(g)), "left")
    out = joined.select(*docs.columns, out_of).mapInArrow(rewrite, docs.schema)
    if "n_chars" in docs.columns:
        kind = dict(docs.dtypes)["n_chars"]
        out = out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(kind))
    return out
