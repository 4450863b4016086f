"""Append-only manifests as a stream, and batches of bounded padded size that go on from one trigger to the next."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.batching import Policy, folded, padded
from ..sources.manifest import MANIFEST


def manifest_stream(spark: SparkSession, folder: str) -> DataFrame:
    return spark.readStream.schema(MANIFEST).json(folder)


class OpenBatch(StatefulProcessor):
    """A shard's state: the number of its open batch, and the policy's state of it."""

    def __init__(self, order: list[str], policy: Policy):
        self.order, self.policy = order, policy

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.number = handle.getValueState("number", "batch int")
        self.held = handle.getValueState("held", self.policy.form)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows)).sort_values(self.order, kind="stable")
        batch = self.number.get()[0] if self.number.exists() else 0
        state = tuple(self.held.get()) if self.held.exists() else None
        numbers, batch, state = folded(self.policy, new[list(self.policy.columns)].itertuples(index=False, name=None), batch, state)
        self.number.update((batch,))
        self.held.update(state)
        yield new.assign(batch=numbers)

    def close(self) -> None:
        pass


def dynamic_batch_stream(df: DataFrame, shard: str, order: str | list[str], size: str | Policy, limit: int | None = None) -> DataFrame:
    """Adds batch to a stream's rows as operators.batching.dynamic_batches() does to a table's, by the same policy.

    Rows of one trigger are taken in `order`; a later trigger's come after all before.  The session has to keep state in
    RocksDB (spark.sql.streaming.stateStore.providerClass).
    """
    policy = padded(size, limit) if isinstance(size, str) else size
    form = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields) + ", batch int"
    return df.groupBy(shard).transformWithStateInPandas(OpenBatch([order] if isinstance(order, str) else order, policy), form, "Append", "None")
