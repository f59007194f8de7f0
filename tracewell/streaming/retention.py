"""What is kept of a stream of results: the last so many of each key, first in, first out.

State is one list a key, never longer than the bound, in a state store that is checkpointed with the query: a restarted query goes on with what
it held.  An item that is there already keeps its place, as in a map that is kept in the order of insertion.  ttl_ms lets a key's list go when
nothing has come for so long.  Needs the RocksDB state store (see ``configure``)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

OUT = "key string, item string, at timestamp, kept boolean"


def configure(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class Retention(StatefulProcessor):
    def __init__(self, most: int, ttl_ms: int | None):
        self.most, self.ttl_ms = most, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getListState("held", "item string, at timestamp", self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = dict(self.held.get()) if self.held.exists() else {}
        for batch in rows:
            told = []
            for item, at in batch.sort_values(["at", "item"], kind="stable")[["item", "at"]].itertuples(index=False, name=None):
                new = item not in held
                held[item] = held.get(item, at)
                if new:
                    told.append((key[0], item, at, True))
                if len(held) > self.most:
                    first = next(iter(held))
                    told.append((key[0], first, held.pop(first), False))
            if told:
                yield pd.DataFrame(told, columns=["key", "item", "at", "kept"])
        self.held.put([(item, at) for item, at in held.items()])

    def close(self) -> None:
        pass


def retained(stream: DataFrame, most: int = 100, ttl_ms: int | None = None) -> DataFrame:
    """stream(key, item, at): a row for every item that is taken in (kept) and one for every item that falls out.  Null items are passed over."""
    mode = "None" if ttl_ms is None else "ProcessingTime"
    rows = stream.where("key IS NOT NULL AND item IS NOT NULL").selectExpr("cast(key AS string) AS key", "cast(item AS string) AS item", "at")
    return rows.groupBy("key").transformWithStateInPandas(Retention(most, ttl_ms), outputStructType=OUT, outputMode="Append", timeMode=mode)
