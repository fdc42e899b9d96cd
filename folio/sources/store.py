"""Durable tables: intermediates, recorded snapshots, artifacts."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SNAPSHOT_VERSION = 1


def written(df: DataFrame, name: str) -> DataFrame:
    """df, written to the folder of spark.checkpoint.dir and read back. Where that is unset, a temporary folder serves if the
    executors are threads of the driver; on a cluster that is an error, as its machines don't see each other's folders."""
    spark = df.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[[^-\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        base = tempfile.mkdtemp(prefix="folio-")
        spark.conf.set("spark.checkpoint.dir", base)
    path = f"{base}/folio-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(rows: DataFrame) -> DataFrame:
    """rows, dealt out to all cores if they are of fewer partitions, as a table of one row group is; others, which a table of any
    size is, stay where they are read. For costly expressions only; select the columns before."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if not rows.isStreaming and rows.rdd.getNumPartitions() < cores else rows


def read_snapshots(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Recorded captures (gzip JSON lines). A newer format version is an error, not a guess."""
    rows = spark.read.schema(f"format_version int, {schema}").json(path)
    late = F.col("format_version") > SNAPSHOT_VERSION
    return rows.withColumn("format_version", F.when(late, F.raise_error(F.lit("snapshot of a newer format"))).otherwise(F.col("format_version")))


def write_snapshots(rows: DataFrame, path: str, private: str = "private", html: str = "static_html") -> None:
    """Captures as gzip JSON lines, private ones left out and their html dropped from the columns."""
    rows.where(~F.coalesce(private, F.lit(False))).drop(private, html).withColumn("format_version", F.lit(SNAPSHOT_VERSION)).write.json(path, compression="gzip")


def write_artifacts(pages: DataFrame, path: str) -> None:
    """Result tables, committed as a whole."""
    pages.write.mode("errorifexists").parquet(path)


def read_artifacts(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Result tables that write_artifacts() made."""
    return spark.read.schema(schema).parquet(path)


def read_hooks(lines: DataFrame, schema: str, most: int = 8 << 20) -> DataFrame:
    """The payloads of lines (value), a batch or a stream of JSON texts of at most `most` bytes; others are null."""
    return lines.select(F.when(F.octet_length("value") <= most, F.from_json("value", schema)).alias("payload")).select("payload.*")
