"""Helpers shared by the operators: durable intermediate tables and streaming over sorted partitions."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, a temporary one if the
    executors are threads of the driver, as in tests; an error on a cluster, whose machines don't see each other's."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[[^-\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        base = tempfile.mkdtemp(prefix="folio-")
        spark.conf.set("spark.checkpoint.dir", base)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(base)
    return base


#: Bytes of a batch of rows that goes to Python. The JVM and Python each hold a batch in several forms, in every task, so
#: Spark's own limit (64 MB) costs an executor many times as much where texts are long.
BATCH_BYTES = "4m"


def small_batches(spark: SparkSession) -> None:
    """From now on the session hands rows to Python in batches of BATCH_BYTES, unless it was told another size."""
    limit = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(limit, None) is None:
        spark.conf.set(limit, BATCH_BYTES)


#: Folders of the tables written inside scratch(), innermost last.
_scratch: list[list[str]] = []


def written(df: DataFrame, name: str, codec: str | None = None) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: lineage ends, lost executors cost no recomputation."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/folio-{name}-{uuid.uuid4().hex}"
    if _scratch:
        _scratch[-1].append(path)
    (df.write.option("compression", codec) if codec else df.write).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession):
    """Tables that written() makes inside are deleted at the end; write what is to last with kept()."""
    _scratch.append([])
    try:
        yield
    finally:
        for path in map(spark._jvm.org.apache.hadoop.fs.Path, _scratch.pop()):
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def kept(df: DataFrame, name: str) -> DataFrame:
    """As written(), but the table outlasts scratch()."""
    held, _scratch[:] = list(_scratch), []
    try:
        return written(df, name)
    finally:
        _scratch[:] = held


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores before it as it takes to be no column of df, whatever the case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in taken:
            n = f"_{n}"
        out.append(n)
    return out


def bitmap(rows: DataFrame, place: Callable[[np.ndarray], np.ndarray], bits: int) -> np.ndarray:
    """A bitmap of 2 ** bits bits, at the places of the one long column of rows. Made on the executors; the driver gets at
    most 2 ** (bits - 6) numbers. Its size is fixed: with many more values than bits it lets all through, which costs
    time and changes no result."""

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = np.unique(place(b.column(0).to_numpy()))
            bit = (np.uint64(1) << (at & np.uint64(63))).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array((at >> np.uint64(6)).astype(np.int32)), pa.array(bit)], names=["at", "bits"])

    found = rows.mapInArrow(words, "at int, bits long").groupBy("at").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(1 << bits - 6, np.uint64)
    out[found["at"].to_numpy()] = found["bits"].to_numpy().view(np.uint64)
    return out


def has(bits: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether the bitmap has these places."""
    return (bits[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)


def sliced(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[dict[str, np.ndarray]]:
    """Columns of each run of rows with equal keys, where the rows come sorted by keys; a run may span batches."""
    rest: dict[str, np.ndarray] | None = None
    for batch in batches:
        cols = {n: batch.column(i).to_numpy(zero_copy_only=False) for i, n in enumerate(batch.schema.names)}
        if rest is not None:
            cols = {n: np.concatenate([rest[n], v]) for n, v in cols.items()}
        size = len(cols[keys[0]])
        if not size:
            continue
        new = np.zeros(size, bool)
        for k in keys:
            new[1:] |= cols[k][1:] != cols[k][:-1]
        cuts = [0, *np.flatnonzero(new).tolist()]
        for a, b in zip(cuts, cuts[1:]):
            yield {n: v[a:b] for n, v in cols.items()}
        rest = {n: v[cuts[-1] :] for n, v in cols.items()}
    if rest is not None:
        yield rest


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
