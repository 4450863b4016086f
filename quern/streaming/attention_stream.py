"""Chunked attention over a stream: a cache of earlier frames in keyed state, cut to what the next chunk can see."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.attention import chunked


class ChunkCache(StatefulProcessor):
    """A key's state: the number of its next chunk's first frame, the frames before it that chunks still see, and those that wait.

    The cache is a list state that loses its oldest frames with every chunk (look_back -1 keeps all), so a key's state
    is (look_back + 1) * stride + right frames, however long the stream.
    """

    def __init__(self, key: str, order: list[str], vector: str, stride: int, right: int, look_back: int, heads: int):
        self.key, self.order, self.vector = key, order, vector
        self.stride, self.right, self.look_back, self.heads = stride, right, look_back, heads

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.next = handle.getValueState("next", "t long")
        self.cache = handle.getListState("cache", "v array<double>")
        self.waiting = handle.getListState("waiting", "v array<double>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows)).sort_values(self.order, kind="stable")
        cache = [x[0] for x in self.cache.get()] if self.cache.exists() else []
        waiting = [x[0] for x in self.waiting.get()] if self.waiting.exists() else []
        t = self.next.get()[0] if self.next.exists() else 0
        held = len(cache)
        frames = [np.asarray(x, float) for x in [*cache, *waiting, *new[self.vector]]]
        at = held
        out: list[np.ndarray] = []
        start = t
        while at + self.stride + self.right <= len(frames):
            out.extend(chunked(np.array(frames), at, self.stride, self.right, self.look_back, self.heads))
            at += self.stride
            t += self.stride
        kept = frames[:at] if self.look_back < 0 else frames[max(0, at - self.look_back * self.stride) : at]
        if at > held:
            self.next.update((t,))
            if self.look_back < 0:
                self.cache.appendList([(x.tolist(),) for x in frames[held:at]])
            elif kept:
                self.cache.put([(x.tolist(),) for x in kept])
        if len(frames) > at:
            self.waiting.put([(x.tolist(),) for x in frames[at:]])
        else:
            self.waiting.clear()
        if out:
            yield pd.DataFrame({self.key: [key[0]] * len(out), "t": np.arange(start, t), "out": [x.tolist() for x in out]})

    def close(self) -> None:
        pass


def chunk_attention_stream(df: DataFrame, key: str, order: list[str], vector: str, stride: int, right: int = 0, look_back: int = 1, heads: int = 1) -> DataFrame:
    """operators.attention.chunk_attention() of a stream's rows: a chunk's rows come with the trigger that completes it.

    Rows of one trigger are taken in `order`; a later trigger's come after all before.  The session has to keep state in
    RocksDB (spark.sql.streaming.stateStore.providerClass), as lists in state need it.
    """
    kind = dict(df.dtypes)[key]
    processor = ChunkCache(key, order, vector, stride, right, look_back, heads)
    return df.groupBy(key).transformWithStateInPandas(processor, f"`{key}` {kind}, t long, out array<double>", "Append", "None")
