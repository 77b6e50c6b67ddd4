"""Compaction of a stream of messages, and the running ratio as state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..plans.engine import Engine
from ..sources.messages import facts


def compact_stream(messages: DataFrame, engine: Engine, out: str, facts_path: str, checkpoint: str) -> DataStreamWriter:
    """A writer that compacts each batch once and appends messages to ``out`` and facts to
    ``facts_path``, in a folder a batch: a batch done again after a failure overwrites its own folder."""

    def write(batch: DataFrame, n: int) -> None:
        path = f"{out}/batch={n}"
        engine.apply(batch).write.mode("overwrite").parquet(path)
        done = batch.sparkSession.read.parquet(path)
        facts(done, n).drop("batch").write.mode("overwrite").parquet(f"{facts_path}/batch={n}")

    return messages.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def running_ratio_stream(ratios: DataFrame, key: str) -> DataFrame:
    """(key, average) by arrival, from a stream with ``ratio`` and an order ``ts`` within batches."""

    def step(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        (average,) = state.get if state.exists else (1.0,)
        found = pd.concat(list(parts)).sort_values("ts", kind="stable")
        for ratio in found["ratio"].dropna():
            average = 0.9 * average + 0.1 * ratio
        state.update((average,))
        yield pd.DataFrame({key: [k[0]], "average": [average]})

    kind = dict(ratios.dtypes)[key]
    picked = ratios.select(key, "ratio", F.col("ts"))
    return picked.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, average double", "average double", "update", GroupStateTimeout.NoTimeout)
