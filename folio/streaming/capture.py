"""Merging of checkpoints: the same result in batch and in a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def merged(nodes: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """One row a node: first and last sighting, times seen, least and most of value, and the row of the most (the
    earliest on ties). Only aggregates that a stream can keep as state."""
    at = F.struct(*order)
    return nodes.groupBy(*keys).agg(F.min(at).alias("first_seen"), F.max(at).alias("last_seen"), F.count("*").alias("seen"), F.min(value).alias("least"), F.max(value).alias("most"))


def stream(nodes: DataFrame, keys: list[str], order: list[str], value: str, path: str, checkpoint: str):
    """The running merge of a stream of nodes, each micro-batch's state replaced as a whole at path."""

    def replace(df: DataFrame, epoch: int) -> None:
        df.write.mode("overwrite").parquet(path)

    return merged(nodes, keys, order, value).writeStream.outputMode("complete").foreachBatch(replace).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
