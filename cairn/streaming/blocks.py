"""Multi-resolution blocks as state of a stream: each switches its scale through a buffer."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators import scales

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Blocks(StatefulProcessor):
    def __init__(self, rules: scales.Rules):
        self.rules = rules

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("block", scales.STATE)

    def handleInputRows(self, key, rows, timerValues):
        block = scales.Block.unpack(tuple(self.state.get())) if self.state.exists() else scales.Block()
        before = block.last
        scales.take_rows(block, pd.concat(list(rows)), self.rules)
        if block.last > before:
            self.state.update(block.pack())
            yield scales.told(key[0], block)

    def close(self) -> None:
        pass


def block_stream(updates: DataFrame, rules: scales.Rules = scales.Rules()) -> DataFrame:
    """States of blocks (scales.OUTPUT) after each micro-batch that brings them a new frame. updates: a stream of scales.INPUT.

    A block's scales, buffer and counters live in Spark's state store (spark.sql.streaming.stateStore.providerClass must be
    RocksDB's). A block takes frames in rising order only: rows of a frame that it has taken, as when a batch is delivered again,
    change nothing and give no row.
    """
    return updates.groupBy("key").transformWithStateInPandas(_Blocks(rules), scales.OUTPUT, "Update", "None")
