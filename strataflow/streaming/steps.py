"""Step-wise ingest, and progressive state across requests, on Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType


def step_source(spark: SparkSession, path: str, schema: StructType, per_step: int = 1) -> DataFrame:
    """A stream of a folder's Parquet files, so many for each step."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_step).parquet(path)


def each_step(stream: DataFrame, work: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Works on every step there is, in order, and stops. A step that was finished isn't worked again."""
    query = stream.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def accumulate_planes(requests: DataFrame, keys: list[str]) -> DataFrame:
    """keys, taken, fresh: for each request (keys, planes) the planes held after it, and those it added.

    The state of a key is the number of planes that it has read; it never falls.
    """
    kinds = {f.name: f.dataType.simpleString() for f in requests.schema}
    out = ", ".join(f"{k} {kinds[k]}" for k in keys) + ", taken int, fresh int"

    def work(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        had = state.get[0] if state.exists else 0
        want = max((int(f["planes"].max()) for f in frames if len(f)), default=had)
        taken = max(had, want)
        state.update((taken,))
        yield pd.DataFrame([[*key, taken, taken - had]], columns=[*keys, "taken", "fresh"])

    return requests.groupBy(*keys).applyInPandasWithState(work, out, "taken int", "update", GroupStateTimeout.NoTimeout)
