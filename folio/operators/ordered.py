"""Places and neighbours within a key, where a key may hold any share of the rows: no task sorts a whole key."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folio.sources.store import written

BLOCK = 4096


def numbered(rows: DataFrame, name: str, key: str, *order: str) -> DataFrame:
    """rows with `name`: their place within the key in this order, from 1 and without gaps, as row_number() gives it. Rows with a null
    key are a key; rows that tie in the order get their places in any way.

    Rows are range-partitioned by key and order, sorted and written with their place in the partition; what a partition holds of a
    key is one row of counts, and the counts of the partitions before are added. One shuffle moves the rows."""
    placed = rows.repartitionByRange(key, *order).sortWithinPartitions(key, *order).withColumn("__m", F.monotonically_increasing_id())
    placed = written(placed.withColumn("__p", F.shiftright("__m", 33)), "numbered")
    parts = placed.groupBy("__p", F.col(key).alias("__k")).agg(F.min("__m").alias("__s"), F.count("*").alias("__c"))
    # a key has a row of counts a partition at most, so this window is small whatever the key holds
    before = F.sum("__c").over(Window.partitionBy("__k").orderBy("__p").rowsBetween(Window.unboundedPreceding, -1))
    starts = parts.select("__k", F.col("__p").alias("__q"), (F.coalesce(before, F.lit(0)) - F.col("__s") + 1).alias("__o"))
    out = placed.join(starts, (F.col("__p") == F.col("__q")) & F.col(key).eqNullSafe(F.col("__k")))
    return out.withColumn(name, F.col("__m") + F.col("__o")).drop("__m", "__p", "__q", "__k", "__o")


def blocks_of(rows: DataFrame, number: str, before: int = 0, after: int = 0, block: int = BLOCK) -> DataFrame:
    """rows dealt to blocks (__b) of `block` numbers in a row, from 1; __own tells a block's own rows from the `before` and `after`
    ones next to it, which it holds as well. A window over key and __b then sees each own row's neighbours."""
    if max(before, after) > block:
        raise ValueError("neighbours lie within a block")
    at, b = (F.col(number) - 1) % block, F.floor((F.col(number) - 1) / block)
    held = F.array(b, F.when(at >= block - before, b + 1), F.when(at < after, b - 1))
    return rows.withColumn("__b", F.explode(F.array_compact(held))).withColumn("__own", F.col("__b") == b)
