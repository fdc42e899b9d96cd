"""Line dedup: lines whose key stands in at least `min_docs` documents lose all their lines.

A document is a doc_id; a text is split at \\n, and a null or empty text is one empty line. The key of a line is the
line without the characters [\\x20\\x09-\\x0D] at both ends and with A-Z in lower case. Keys under `min_chars` code
points are kept.

Keys are 128-bit hashes, range-partitioned by (hash, document) and sorted by (hash, document, position). Because the
document is part of the range, a line that stands in a third of all documents spreads over as many partitions as its
rows need, and no partition holds a document's share of a key in two places. Each partition streams its runs: of a
run it holds back the rows of at most min_docs - 1 documents, then everything that follows passes on as dropped. A
run at either end of a partition may go on in the next; its rows pass on as open, with one row of the number of
documents. Those rows, at most two a partition, are summed on the driver to decide the open runs.

Positions come back together by document as a compressed bitmap (zlib over one bit a line, 1 for kept), which is what
keep_bitmaps() returns. Texts aren't moved with the lines, only once, when a bitmap meets its text. Repeated rows of a
doc_id with the same text count as one document and give as many result rows. Rows with a null doc_id are one document
together. Other columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.llm._shared import fresh, written

BLANK = " \t\n\x0b\x0c\r"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
DROP, OPEN, COUNT = 0, 1, 2
_ROW = "h1 long, h2 long, doc_id long, t long, pos int, kind int, docs long"
_ROW_ARROW = pa.schema([("h1", pa.int64()), ("h2", pa.int64()), ("doc_id", pa.int64()), ("t", pa.int64()), ("pos", pa.int32()), ("kind", pa.int32()), ("docs", pa.int64())])
#: Stands for a null doc_id in sorted keys.
_NONE = -(1 << 63)


def _lines(docs: DataFrame, min_chars: int) -> DataFrame:
    # t tells apart the texts of a repeated doc_id, so that a bitmap meets its own text
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NONE)).alias("doc_id"), F.xxhash64("text").alias("t"), F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    rows = rows.select("doc_id", "t", "pos", F.translate(F.btrim("line", F.lit(BLANK)), _UPPER, _LOWER).alias("key")).where(F.length("key") >= max(1, min_chars))
    return rows.select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit("second"), "key").alias("h2"), "doc_id", "t", "pos")


def _stream(min_docs: int):
    def batch(h1, h2, doc, t, pos, kind, docs=0):
        n = len(doc)
        return pa.RecordBatch.from_arrays([pa.array(np.full(n, h1, np.int64)), pa.array(np.full(n, h2, np.int64)), pa.array(doc), pa.array(t), pa.array(pos.astype(np.int32)), pa.array(np.full(n, kind, np.int32)), pa.array(np.full(n, docs, np.int64))], schema=_ROW_ARROW)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, first = None, True
        docs, last, held, small = 0, None, [], []

        def close(edge):
            nonlocal held
            if edge:  # this run may go on in another partition
                for x in held:
                    yield batch(*key, *x, OPEN)
                one = np.zeros(1, np.int64)
                yield batch(*key, one, one, one, COUNT, docs)
            held = []

        out: list[pa.RecordBatch] = []
        for b in batches:
            cols = [b.column(i).to_numpy(zero_copy_only=False) for i in range(5)]
            n = len(cols[0])
            if not n:
                continue
            cut = np.flatnonzero((cols[0][1:] != cols[0][:-1]) | (cols[1][1:] != cols[1][:-1])) + 1
            cuts = [0, *cut.tolist(), n]
            for i, j in zip(cuts, cuts[1:]):
                k = (int(cols[0][i]), int(cols[1][i]))
                if k != key:
                    if key is not None:
                        out += close(first)
                        first = False
                    key, docs, last = k, 0, None
                doc, t, pos = (c[i:j] for c in cols[2:])
                docs += int((doc[1:] != doc[:-1]).sum()) + (last is None or doc[0] != last)
                last = doc[-1]
                if first:  # the rows before may lie in the partition before
                    out.append(batch(*key, doc, t, pos, OPEN))
                else:
                    held.append((doc, t, pos))
                    if docs >= min_docs:
                        out += [batch(*key, *x, DROP) for x in held]
                        held = []
                if len(out) >= 512:
                    yield pa.Table.from_batches(out).combine_chunks().to_batches()[0]
                    out = []
        if key is not None:
            out += close(True)
        yield from out

    return run


def dropped(docs: DataFrame, min_docs: int = 10, min_chars: int = 1) -> DataFrame:
    """doc_id, t (hash of the text), pos of each line that goes; null texts have none."""
    spark = docs.sparkSession
    lines = written(_lines(docs, min_chars), "line-hashes")
    order = ["h1", "h2", "doc_id", "t", "pos"]
    parts = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    found = lines.repartitionByRange(parts, "h1", "h2", "doc_id").sortWithinPartitions(*order).select(*order).mapInArrow(_stream(min_docs), _ROW)
    found = written(found, "line-runs")
    ends = found.where(F.col("kind") == COUNT).groupBy("h1", "h2").agg(F.sum("docs").alias("docs"))
    # at most two runs of a partition are open, whatever the data
    hot = F.broadcast(ends.where(F.col("docs") >= min_docs).select("h1", "h2"))
    still = found.where(F.col("kind") == OPEN).join(hot, ["h1", "h2"], "left_semi")
    return found.where(F.col("kind") == DROP).select("doc_id", "t", "pos").unionByName(still.select("doc_id", "t", "pos"))


def _bitmap(positions: np.ndarray, n: int) -> bytes:
    keep = np.ones(n, bool)
    keep[positions] = False
    return zlib.compress(np.packbits(keep).tobytes(), 1)


def _with_positions(docs: DataFrame, min_docs: int, min_chars: int) -> tuple[DataFrame, str]:
    """docs with the positions of the lines that go (null: none), and that column's name."""
    d, t, gone = fresh(docs, "d", "t", "gone")
    found = dropped(docs, min_docs, min_chars).groupBy(F.col("doc_id").alias(d), F.col("t").alias(t)).agg(F.collect_set("pos").alias(gone))
    rows = docs.withColumn(t, F.xxhash64("text")).withColumn(d, F.coalesce(F.col("doc_id").cast("long"), F.lit(_NONE)))
    return rows.join(found, [d, t], "left").drop(d, t), gone


def keep_bitmaps(docs: DataFrame, min_docs: int = 10, min_chars: int = 1) -> DataFrame:
    """doc_id, n_lines, n_dropped, keep_bitmap of each row: what stays, instead of the text."""

    def run(batches):
        for b in batches:
            n = b.column(1).to_numpy()
            gone = b.column(2).to_pylist()
            maps = [_bitmap(np.array(g or [], np.int64), int(m)) for g, m in zip(gone, n)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([len(g or []) for g in gone], pa.int64()), pa.array(maps, pa.binary())], names=["doc_id", "n_lines", "n_dropped", "keep_bitmap"])

    lines = F.size(F.split(F.coalesce("text", F.lit("")), "\n", -1)).cast("long")
    rows, gone = _with_positions(docs.select("doc_id", "text"), min_docs, min_chars)
    rows = rows.select(F.col("doc_id").cast("long").alias("doc_id"), lines.alias("n"), gone)
    return rows.mapInArrow(run, "doc_id long, n_lines long, n_dropped long, keep_bitmap binary")


def apply_bitmap(text: str | None, bitmap: bytes) -> str:
    """The kept lines of text, joined by \\n."""
    lines = (text or "").split("\n")
    keep = np.unpackbits(np.frombuffer(zlib.decompress(bitmap), np.uint8), count=len(lines))
    return "\n".join([x for x, k in zip(lines, keep.tolist()) if k])


def deduped(docs: DataFrame, min_docs: int = 10, min_chars: int = 1) -> DataFrame:
    """docs with the kept lines as text, all other columns as they are; n_chars, if there, is that of the new text."""
    lines = F.split("text", "\n", -1)
    out, gone = _with_positions(docs, min_docs, min_chars)
    kept = F.array_join(F.filter(lines, lambda x, i: ~F.array_contains(gone, i)), "\n")
    out = out.withColumn("text", F.when(F.col(gone).isNull(), F.col("text")).otherwise(kept))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def digests(docs: DataFrame, min_docs: int = 10, min_chars: int = 1) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 of each row, through its bitmap."""

    def run(batches):
        for b in batches:
            out = [], [], []
            for text, gone in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                n = (text or "").count("\n") + 1
                kept = apply_bitmap(text, _bitmap(np.array(gone, np.int64), n)) if gone else text or ""
                for o, x in zip(out, (n, len(gone or []), hashlib.sha256(kept.encode("utf-8", "surrogatepass")).hexdigest())):
                    o.append(x)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.string())], names=["doc_id", "n_lines", "n_dropped", "kept_sha256"])

    rows, gone = _with_positions(docs.select("doc_id", "text"), min_docs, min_chars)
    rows = rows.select(F.col("doc_id").cast("long").alias("doc_id"), "text", gone)
    return rows.mapInArrow(run, "doc_id long, n_lines long, n_dropped long, kept_sha256 string")


ORACLE = r"""
WITH lines AS (
  SELECT doc_id, pos, line, translate(trim(line, chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents)),
hot AS (SELECT k FROM lines WHERE length(k) >= 1 GROUP BY k HAVING count(DISTINCT doc_id) >= 10),
marked AS (SELECT l.*, h.k IS NOT NULL AS gone FROM lines l LEFT JOIN hot h ON l.k = h.k)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id"""
