"""Token ids in binary files: canonical length-limited Huffman codes, decoded by table in independent blocks.

File format (little-endian): 8 bytes magic, then u32 counts: header bytes, symbols, documents, ids, block size, longest
code; then, as the header: symbols u32 and code lengths u8 in ascending order of symbol; documents' ids i64 and lengths
u32 (ids each); bit offsets u64 of the blocks (the checkpoints); then the payload, most significant bit first.  Codes
are canonical: their lengths say all.  Each block starts at its checkpoint, so blocks are decoded side by side, one
symbol of each at a time, in numpy.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import SHORT, filesystem, keep, mix, powers, publish, scratch, spans, text_batches, text_bytes

MAGIC, BLOCK, LIMIT = b"QUERNHF1", 512, 20
#: Token ids to a file, about.
FILE_IDS = 4_000_000
#: Tasks' files that are numbered together.
GROUP = 4096
#: Pieces that a Python worker remembers the ids of.
MEMO = 1_000_000


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Length-limited code lengths of symbols by package-merge; 0 for those with count 0."""
    out = np.zeros(len(counts), np.uint8)
    used = np.flatnonzero(counts)
    if len(used) < 2:
        out[used] = 1
        return out
    if len(used) > 1 << limit:
        raise ValueError(f"{len(used)} symbols need codes of over {limit} bits")
    order = used[np.argsort(counts[used], kind="stable")]
    leaves = counts[order].astype(np.float64)
    level, flags = leaves, []
    for _ in range(limit):
        flags.append(np.zeros(0, bool))
        if len(flags) == 1:
            flags[0] = np.ones(len(leaves), bool)
            continue
        packages = level[: len(level) // 2 * 2].reshape(-1, 2).sum(1)
        both = np.concatenate([leaves, packages])
        at = np.argsort(both, kind="stable")
        level, flags[-1] = both[at], at < len(leaves)
    need, length = 2 * (len(leaves) - 1), np.zeros(len(leaves), np.int64)
    for f in reversed(flags):
        n = int(f[:need].sum())
        length[:n] += 1
        need = 2 * (need - n)
    out[order] = length
    return out


def codes_of(lengths: np.ndarray) -> np.ndarray:
    """Canonical codes: by length, then by symbol."""
    out = np.zeros(len(lengths), np.uint64)
    used = np.flatnonzero(lengths)
    order = used[np.argsort(lengths[used], kind="stable")]
    if len(order):
        n = lengths[order].astype(np.int64)
        top = int(n.max())
        width = np.int64(1) << (top - n)  # of each code's part of the table
        out[order] = ((np.cumsum(width) - width) >> (top - n)).astype(np.uint64)
    return out


def pack(ids: np.ndarray, lengths: np.ndarray, codes: np.ndarray, block: int = BLOCK) -> tuple[bytes, np.ndarray]:
    """The payload and the bit offset of each block."""
    n = lengths[ids].astype(np.int64)
    at = spans(n)
    words = np.zeros(int(at[-1]) // 32 + 2, np.uint32)
    if len(ids):
        start = at[:-1]
        value = codes[ids] << (64 - (start & 31) - n).astype(np.uint64)  # within two words of 32 bits
        word = start >> 5
        first = np.flatnonzero(np.diff(word, prepend=-1))
        own = np.bitwise_or.reduceat(value, first)
        words[word[first]] |= (own >> np.uint64(32)).astype(np.uint32)
        words[word[first] + 1] |= (own & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    return words.astype(">u4").tobytes(), at[:-1][::block].astype(np.uint64)


def unpack(payload: np.ndarray, offsets: np.ndarray, total: int, lengths: np.ndarray, block: int = BLOCK) -> np.ndarray:
    """All ids, decoded in blocks by one table of the longest code's width."""
    used = np.flatnonzero(lengths)
    if not total:
        return np.zeros(0, np.int64)
    top = int(lengths.max())
    order = used[np.argsort(lengths[used], kind="stable")]
    width = np.int64(1) << (top - lengths[order].astype(np.int64))
    symbol = np.zeros(1 << top, np.int32)
    size = np.zeros(1 << top, np.uint8)
    full = int(width.sum())
    symbol[:full], size[:full] = np.repeat(order, width), np.repeat(lengths[order], width)
    padded = np.concatenate([payload, np.zeros(8, np.uint8)]).astype(np.uint32)
    # the 32 bits that start at each byte
    wide = (padded[:-3] << np.uint32(24)) | (padded[1:-2] << np.uint32(16)) | (padded[2:-1] << np.uint32(8)) | padded[3:]
    out = np.zeros((block, len(offsets)), np.int32)
    at, last = offsets.astype(np.int64), total - (len(offsets) - 1) * block
    for k in range(block):
        lane = at if k < last else at[:-1]
        code = (wide[lane >> 3] >> (32 - top - (lane & 7)).astype(np.uint32)) & np.uint32((1 << top) - 1)
        out[k, : len(lane)] = symbol[code]
        lane += size[code]
    return out.T.reshape(-1)[:total].astype(np.int64)


def file_bytes(doc_ids: np.ndarray, lengths: np.ndarray, ids: np.ndarray, code_lengths: np.ndarray, codes: np.ndarray, block: int = BLOCK) -> list[bytes]:
    payload, offsets = pack(ids, code_lengths, codes, block)
    used = np.flatnonzero(code_lengths)
    head = [used.astype("<u4").tobytes(), code_lengths[used].tobytes(), doc_ids.astype("<i8").tobytes(), lengths.astype("<u4").tobytes(), offsets.astype("<u8").tobytes()]
    counts = np.array([sum(map(len, head)), len(used), len(doc_ids), len(ids), block, code_lengths.max(initial=0)], "<u4")
    return [MAGIC, counts.tobytes(), *head, payload]


@dataclass
class File:
    doc_ids: np.ndarray
    lengths: np.ndarray
    code_lengths: np.ndarray
    offsets: np.ndarray
    payload: np.ndarray
    total: int
    block: int

    def ids(self) -> np.ndarray:
        return unpack(self.payload, self.offsets, self.total, self.code_lengths, self.block)


def parse(raw: np.ndarray) -> File:
    if raw[:8].tobytes() != MAGIC:
        raise ValueError("not a file of token ids")
    head, symbols, docs, total, block, _ = np.frombuffer(raw[8:32].tobytes(), "<u4").tolist()
    at = 32

    def take(kind: str, n: int) -> np.ndarray:
        nonlocal at
        out = np.frombuffer(raw[at : at + n * np.dtype(kind).itemsize].tobytes(), kind)
        at += out.nbytes
        return out

    used, size = take("<u4", symbols), take("u1", symbols)
    lengths = np.zeros(int(used.max(initial=0)) + 1, np.uint8)
    lengths[used] = size
    return File(take("<i8", docs), take("<u4", docs).astype(np.int64), lengths, take("<u8", -(-total // block)), raw[32 + head :], total, block)


#: Classes of bytes: white space, letters, digits, other ASCII, and those that make a word one to give the tokenizer whole.
_GAP, _LETTER, _DIGIT, _MARK, _WHOLE = range(5)
_CLASS = np.array([_GAP if c == 32 or 9 <= c <= 13 else _WHOLE if c >= 128 or chr(c) in "'<" or c < 32 or c == 127 else _LETTER if chr(c).isalpha() else _DIGIT if chr(c).isdigit() else _MARK for c in range(256)], np.uint8)
_PLAIN = np.random.default_rng(21).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FOLDED = _PLAIN[[c + 32 if 65 <= c <= 90 else c for c in range(256)]]
#: Pieces that the tokenizer gets in one text.
_TOGETHER = 500


def pieces(data: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and 64-bit hash of each piece, and whether it is a whole word that is no piece of its own.

    Words of ASCII letters, digits and marks come apart into runs of letters, single digits and runs of marks; a word
    with an apostrophe, "<", a control character or anything beyond ASCII stays whole.  No piece crosses a cut.
    """
    kind = _CLASS[data]
    edges = np.zeros(len(data) + 1, bool)
    edges[cuts] = True
    edges = edges[:-1]
    gap = kind == _GAP
    begin = ~gap
    begin[1:] &= gap[:-1] | edges[1:]
    words = np.flatnonzero(begin)
    if not len(words):
        none = np.zeros(0, np.int64)
        return none, none, none.astype(np.uint64), none.astype(bool)
    odd = np.logical_or.reduceat(kind == _WHOLE, words)
    apart = begin.copy()
    apart[1:] |= ~gap[1:] & ((kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT))
    v = _FOLDED[data]
    if odd.any():
        inside = np.repeat(odd, np.diff(np.append(words, len(data))))
        inside = np.concatenate([np.zeros(len(data) - len(inside), bool), inside])
        apart &= ~inside | begin
        v[inside] = _PLAIN[data[inside]]
    v[gap] = 0
    starts = np.flatnonzero(apart)
    hashes, at = np.zeros(len(starts), np.uint64), 0
    while at < len(starts):  # some pieces at a time
        to = max(at + 1, int(np.searchsorted(starts, starts[at] + (1 << 17))))
        end = int(starts[to]) if to < len(starts) else len(data)
        first = starts[at:to] - starts[at]
        up, down = powers(end - int(starts[at]))
        part = v[starts[at] : end]
        hashes[at:to] = np.add.reduceat(part * up[: len(part)], first) * down[first]
        at = to
    stops = np.flatnonzero(~gap & np.append(gap[1:] | edges[1:], True) | ~gap & np.append(apart[1:], True)) + 1
    whole = odd[np.searchsorted(words, starts, "right") - 1]
    hashes = mix(hashes, 7)
    for k in np.flatnonzero(stops - starts > SHORT).tolist():
        own = data[starts[k] : stops[k]].tobytes()
        hashes[k] = xxhash.xxh3_64_intdigest(own if whole[k] else own.lower(), 7)
    return starts, stops, hashes, whole


class Encoder:
    """Ids of texts by the tokenizers library, remembering pieces by their 64-bit hashes.

    Under a tokenizer of the form that apart() knows, white space never joins words, a run of ASCII letters, a digit and
    a run of ASCII marks without apostrophe each are a piece of their own, and every piece ends with a token that says
    so.  Such pieces reach the library once each, many in a text; words that are not made of them reach it whole.  Under
    any other tokenizer every text does.
    """

    _own: Encoder | None = None

    def __init__(self, path: str):
        import json
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            form = json.load(f)
        self.path, self.tokenizer, self.apart = path, Tokenizer.from_file(path), self.known(form)
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.kind = np.uint16 if size <= 1 << 16 else np.uint32
        self.ends = np.zeros(size + 1, bool)
        if self.apart:
            self.ends[[i for t, i in self.tokenizer.get_vocab(with_added_tokens=False).items() if t.endswith("</w>")]] = True
        self.clear()

    @staticmethod
    def known(form: dict) -> bool:
        """Whether the tokenizer's file has the normaliser, splitting and word ends that pieces() relies on."""
        normal = [(n["type"], n.get("pattern"), n.get("content")) for n in (form.get("normalizer") or {}).get("normalizers", [])]
        split = (form.get("pre_tokenizer") or {}).get("pretokenizers", [])
        model = form.get("model") or {}
        return (
            normal == [("NFC", None, None), ("Replace", {"Regex": r"\s+"}, " "), ("Lowercase", None, None)]
            and [x["type"] for x in split] == ["Split", "ByteLevel"]
            and (split[0]["pattern"], split[0]["behavior"], split[0]["invert"]) == ({"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "Removed", True)
            and (split[1]["add_prefix_space"], split[1]["use_regex"]) == (False, False)
            and (model.get("type"), model.get("end_of_word_suffix"), model.get("dropout")) == ("BPE", "</w>", None)
            and form.get("post_processor") is None
            and all(t["content"].startswith("<") and not any(c.isspace() for c in t["content"]) and not (t["lstrip"] or t["rstrip"] or t["single_word"]) for t in form.get("added_tokens", []))
        )

    @classmethod
    def of(cls, path: str) -> Encoder:
        if cls._own is None or cls._own.path != path:
            cls._own = cls(path)
        return cls._own

    def clear(self) -> None:
        self.keys, self.starts, self.sizes, self.flat = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, self.kind)

    def ask(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def learn(self, keys: np.ndarray, words: list[str], whole: np.ndarray) -> None:
        """Adds pieces: their hashes, texts, and whether they are whole words."""
        ids: list = [None] * len(words)
        some = np.flatnonzero(~whole).tolist()
        for part, got in zip((some[i : i + _TOGETHER] for i in range(0, len(some), _TOGETHER)), self.ask([" ".join(words[k] for k in some[i : i + _TOGETHER]) for i in range(0, len(some), _TOGETHER)]), strict=True):
            cut = (np.flatnonzero(self.ends[got]) + 1).tolist()
            each = [got[i:j] for i, j in zip([0, *cut], cut, strict=False)] if len(cut) == len(part) else self.ask([words[k] for k in part])
            for k, x in zip(part, each, strict=True):
                ids[k] = x
        some = np.flatnonzero(whole).tolist()
        for k, x in zip(some, self.ask([words[k] for k in some]), strict=True):
            ids[k] = x
        size = np.fromiter(map(len, ids), np.int64, len(ids))
        starts = len(self.flat) + spans(size)[:-1]
        self.flat = np.concatenate([self.flat, np.fromiter((i for x in ids for i in x), self.kind, int(size.sum()))])
        keys = np.concatenate([self.keys, keys])
        order = np.argsort(keys)
        self.keys, self.starts, self.sizes = keys[order], np.concatenate([self.starts, starts])[order], np.concatenate([self.sizes, size])[order]

    def __call__(self, column, end: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids of an Arrow column of texts one after another, with `end` after each text, and how many each has."""
        if not self.apart:
            ids = self.ask([t or "" for t in column.to_pylist()])
            n = np.fromiter((len(x) + 1 for x in ids), np.int64, len(ids))
            return np.fromiter((i for x in ids for i in (*x, end)), self.kind, int(n.sum())), n
        data, cuts = text_bytes(column)
        starts, stops, h, whole = pieces(data, cuts)
        if len(self.keys) > MEMO:
            self.clear()
        every, first, back = np.unique(h, return_index=True, return_inverse=True)
        at = np.searchsorted(self.keys, every)
        new = np.flatnonzero(self.keys[np.minimum(at, len(self.keys) - 1)] != every) if len(self.keys) else np.arange(len(every))
        if len(new):
            raw = data.tobytes()
            self.learn(every[new], [raw[i:j].decode("utf-8", "replace") for i, j in zip(starts[first[new]].tolist(), stops[first[new]].tolist(), strict=True)], whole[first[new]])
            at = np.searchsorted(self.keys, every)
        at = at[back]
        size = self.sizes[at]
        cut = spans(size)[np.searchsorted(starts, cuts)]
        n = np.diff(cut) + 1
        out = np.full(int(n.sum()), end, self.kind)
        keep_ = np.ones(len(out), bool)
        keep_[np.cumsum(n) - 1] = False
        out[keep_] = self.flat[np.repeat(self.starts[at] + size - np.cumsum(size), size) + np.arange(int(size.sum()))]
        return out, n


def encode(docs: DataFrame, tokenizer: str, end: int = 2) -> DataFrame:
    """doc_id and ids (little-endian u32, as bytes) of each whole text and its end id; null texts have the end id alone."""
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches):
        each = Encoder.of(tokenizer)
        for b in text_batches(batches):
            ids, n = each(b.column("text"), end)
            raw, at = ids.astype("<u2" if ids.itemsize == 2 else "<u4").tobytes(), spans(n) * ids.itemsize
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([raw[i:j] for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)], pa.binary()), pa.array([ids.itemsize] * len(n), pa.int32())], ["doc_id", "ids", "width"])

    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(run, f"doc_id {kind}, ids binary, width int")


def _joined(batch) -> np.ndarray:
    width = batch.column("width").to_pylist()
    return np.concatenate([np.frombuffer(x, f"<u{w}").astype(np.int64) for x, w in zip(batch.column("ids").to_pylist(), width, strict=True)] or [np.zeros(0, np.int64)])


def write(encoded: DataFrame, folder: str, block: int = BLOCK, limit: int = LIMIT, file_ids: int = FILE_IDS) -> DataFrame:
    """Writes rows of encode() in ascending doc_id order as files in `folder`; returns a row for each file.

    Rows: file, path, first (ids in the files before it), n_docs, n_ids.  Null ids come first (the files
    hold -2 ** 63 for them, which is no id of its own), equal ids by the hash of their contents.  Code lengths come from the counts of all ids.  Files appear whole or not at all, and a repeated task
    writes the same bytes to the same name.
    """
    spark = encoded.sparkSession

    def tally(batches):
        n = np.zeros(0, np.int64)
        for b in batches:
            c = np.bincount(_joined(b))
            if len(c) > len(n):
                n, c = c.astype(np.int64), n
            n[: len(c)] += c
        used = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(n[used], pa.int64())], ["id", "n"])

    counts = encoded.select("ids", "width").mapInArrow(tally, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas()  # of the vocabulary's size
    table = np.zeros(int(counts["id"].max()) + 1 if len(counts) else 1, np.int64)
    table[counts["id"]] = counts["n"]
    lengths = code_lengths(table, limit)
    sent = spark.sparkContext.broadcast((lengths, codes_of(lengths)))
    files = max(1, -(-int(table.sum()) // file_ids))
    folder = folder.rstrip("/")

    def save(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        docs, sizes, ids, k = [], [], [], 0

        def close():
            nonlocal docs, sizes, ids, k
            n = np.array(sizes, np.int64)
            every = np.concatenate(ids)
            path = f"{folder}/ids-{part:06d}-{k:04d}.bin"
            publish(path, lambda out: [out.write(x) for x in file_bytes(np.array(docs, np.int64), n, every, *sent.value, block)])
            row = [pa.array([v]) for v in (part * 10_000 + k, path, len(docs), len(every))]
            docs, sizes, ids, k = [], [], [], k + 1
            return pa.RecordBatch.from_arrays(row, ["file", "path", "n_docs", "n_ids"])

        held = 0
        for b in batches:
            width = b.column("width").to_pylist()
            for d, raw, w in zip(b.column("doc_id").to_pylist(), b.column("ids").to_pylist(), width, strict=True):
                docs.append(-(2**63) if d is None else d)
                ids.append(np.frombuffer(raw, f"<u{w}").astype(np.int64))
                sizes.append(len(ids[-1]))
                held += sizes[-1]
                if held >= 2 * file_ids:
                    held = 0
                    yield close()
        if docs:
            yield close()

    # rows of one id go by the hash of their ids, and equal ones by their place, so that they may lie in several files
    ordered = encoded.withColumns({"doc_id": F.col("doc_id").cast("long"), "h": F.xxhash64("ids"), "place": F.monotonically_increasing_id()})
    ordered = ordered.repartitionByRange(files, "doc_id", "h", "place").sortWithinPartitions("doc_id", "h", "place")
    made = keep(ordered.select("doc_id", "ids", "width").mapInArrow(save, "file long, path string, n_docs long, n_ids long"), f"{folder}/list")
    # what comes before a file: the sums of GROUP files each, added up in order, and then within the group
    group = (F.col("file") / (10_000 * GROUP)).cast("long")
    before = made.groupBy(group.alias("g")).agg(F.sum("n_ids").alias("n")).select(F.col("g").alias("g_"), (F.sum("n").over(Window.orderBy("g")) - F.col("n")).alias("before"))
    inside = F.sum("n_ids").over(Window.partitionBy("g").orderBy("file")) - F.col("n_ids")
    out = made.withColumn("g", group).withColumn("inside", inside).join(before, F.col("g") == F.col("g_"))
    return out.select("file", "path", (F.col("before") + F.col("inside")).alias("first"), "n_docs", "n_ids")


def read(files: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32 (of its ids as little-endian u32) from files of write()."""

    def run(batches):
        for b in batches:
            for path, first in zip(b.column("path").to_pylist(), b.column("first").to_pylist(), strict=True):
                fs, where = filesystem(path)
                with fs.open_input_file(where) as f:
                    own = parse(np.frombuffer(f.read(), np.uint8))
                raw, at = own.ids().astype("<u4").tobytes(), spans(own.lengths)
                crc = [zlib.crc32(raw[4 * i : 4 * j]) for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                docs = pa.array([None if d == -(2**63) else d for d in own.doc_ids.tolist()], pa.int64())
                yield pa.RecordBatch.from_arrays([docs, pa.array(first + at[:-1]), pa.array(own.lengths), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    files = keep(files, scratch(files.sparkSession) + "/files")
    spread = files.select("file", "path", "first").repartition(max(1, min(files.count(), 10_000)), "file")
    return spread.select("path", "first").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, tokenizer: str, end: int = 2) -> DataFrame:
    """Encodes docs, writes files in a scratch folder and reads them back.  An empty table gives an empty result, repeated rows repeat, other columns are ignored."""
    at = scratch(docs.sparkSession)
    return read(write(keep(encode(docs, tokenizer, end), f"{at}/encoded"), f"{at}/files"))
