"""Repeated passages by sparse suffix arrays.

A text is its words (runs of letters, digits or underscores, in lower case), each a hash. Of all its suffixes, those
are retained that start at a minimiser: the least hash of GRAM words among each `min_words` - GRAM + 1 successive ones.
So every run of `min_words` words, wherever it stands, holds the start of a retained suffix, and holds it at the same
place.

First the grams alone are counted; suffixes whose gram stands in one document only can't repeat. For the others the
words after and before the start are fetched (RIGHT and LEFT words, two bytes each, enough to tell a run of min_words
around the start and to reach the next retained suffix). They are range-partitioned and sorted by (gram, words after,
document, place), a suffix array in pieces: a gram that a third of all documents share fills as many partitions as it
needs, one of NEAR + 1 suffixes or fewer stays in one. Each partition streams its part: a suffix is compared with the
NEAR ones before it and with the last one of another document, rightwards over the words after and leftwards over those
before. A match of min_words or more gives a span in both documents. The ends of neighbouring partitions, a row or two
of each, are compared on the driver.

That compares all suffixes of a gram with NEAR + 1 of them or fewer. For a hot gram, one with more, suffixes that share
words before it may lie far apart in that order. So all runs of min_words words round its suffixes that aren't in a span
yet are looked up by their hash among all such runs, those in spans too: a bitmap of fixed size, broadcast, drops runs
that nobody looks for, and the rest are pre-aggregated to the least and greatest doc_id of a hash.

Result: one row for each document with a passage of at least min_words words that another document has too: doc_id,
n_spans, n_words (covered), spans (array of struct start, end in words, end exclusive; joined where they touch) and
partners (array of doc_id: documents that it was seen to share with, at most a few for each retained suffix, not all).
A passage that repeats only inside one document, or in rows with the same doc_id, isn't reported. Null texts and
texts under min_words words have no passages; rows with null doc_id are left out. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.llm._shared import has, written
from folio.llm._words import grams, word_hashes
from folio.llm.ngram_join import _filter, _place

MIN_WORDS, GRAM, RIGHT, LEFT, NEAR = 50, 16, 64, 48, 3
_SPANS = "doc_id long, start int, stop int, partner long"


def minimisers(g: np.ndarray, window: int) -> np.ndarray:
    """Places of the least of each `window` successive elements (the first of equals)."""
    if len(g) < window:
        return np.zeros(0, np.int64)
    out = []
    for a in range(0, len(g) - window + 1, 65536):
        part = g[a : a + 65536 + window - 1]
        out.append(a + np.arange(len(part) - window + 1) + np.lib.stride_tricks.sliding_window_view(part, window).argmin(1))
    return np.unique(np.concatenate(out))


def _starts(min_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            gs, ids, at = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int32)]
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                g = grams(word_hashes(text), GRAM)
                p = minimisers(g, min_words - GRAM + 1)
                if len(p):
                    gs.append(g[p].astype(np.int64))
                    ids.append(np.full(len(p), doc_id, np.int64))
                    at.append(p.astype(np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (gs, ids, at)], names=["g", "doc_id", "pos"])

    return run


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for b in (whole.slice(i, 256) for i in range(0, whole.num_rows, 256)):
            out: list[list] = [[], [], [], [], [], []]
            for doc_id, text, at, hot in zip(*(b.column(i).to_pylist() for i in range(4))):
                h, hot = word_hashes(text), set(hot)
                g = grams(h, GRAM).astype(np.int64)
                w = (h >> np.uint64(48)).astype(">u2").tobytes()  # big-endian: bytes sort as the words do
                back = (h[::-1] >> np.uint64(48)).astype(">u2").tobytes()
                n = len(h)
                for p in at:
                    if p < len(g):  # else the place is of another row with this doc_id
                        out[0].append(g[p])
                        out[1].append(doc_id)
                        out[2].append(p)
                        out[3].append(w[2 * p : 2 * (p + RIGHT)])
                        out[4].append(back[2 * (n - p) : 2 * (n - p + LEFT)])
                        out[5].append(p in hot)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int32()), pa.array(out[3], pa.binary()), pa.array(out[4], pa.binary()), pa.array(out[5], pa.bool_())], names=["g", "doc_id", "pos", "after", "before", "hot"])


def _windows(min_words: int, wanted=None):
    """Runs of min_words words round the hot suffixes of (doc_id, text, hot, found): those in no span of `found`, or with
    `wanted`, those in that bitmap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in (whole.slice(i, 256) for i in range(0, whole.num_rows, 256)):
                ws, ids, at = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int32)]
                for doc_id, text, hot, found in zip(*(b.column(i).to_pylist() for i in range(4))):
                    h = word_hashes(text)
                    if len(h) < min_words:
                        continue
                    g = grams(h, min_words)
                    s = np.unique(np.subtract.outer(np.array(hot, np.int64), np.arange(min_words - GRAM + 1)))
                    s = s[(s >= 0) & (s < len(g))]
                    if wanted is not None:
                        s = s[has(wanted.value, _place(g[s]))]
                    elif found:
                        spans = np.array(_union(found), np.int64)
                        k = np.searchsorted(spans[:, 0], s, side="right") - 1
                        s = s[(k < 0) | (s + min_words > spans[k, 1])]
                    ws.append(g[s].astype(np.int64))
                    ids.append(np.full(len(s), doc_id, np.int64))
                    at.append(s.astype(np.int32))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (ws, ids, at)], names=["id", "doc_id", "start"])

    return run


def _same(words: np.ndarray, size: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Words that rows i and j have in common from the first on."""
    differ = words[i] != words[j]
    first = np.where(differ.any(1), differ.argmax(1), words.shape[1])
    return np.minimum(first, np.minimum(size[i], size[j]))


def _matrix(cells: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    size = np.array([len(x) // 2 for x in cells], np.int64)
    joined = b"".join([x.ljust(2 * width, b"\0") for x in cells])
    return np.frombuffer(joined, np.uint16).reshape(len(cells), width), size


def _matches(c: dict[str, np.ndarray], old: int, min_words: int) -> list[np.ndarray]:
    """Spans (doc_id, start, stop, partner) from comparing each row from `old` on with rows before it."""
    n = len(c["g"])
    idx = np.arange(n)
    doc, g, pos = c["doc_id"], c["g"], c["pos"].astype(np.int64)
    new = np.ones(n, bool)
    new[1:] = doc[1:] != doc[:-1]
    other = np.maximum.accumulate(np.where(new, idx, 0)) - 1
    i = np.concatenate([idx[old:]] * (NEAR + 1))
    j = np.concatenate([other[old:], *(idx[old:] - k for k in range(1, NEAR + 1))])
    ok = j >= 0
    i, j = i[ok], j[ok]
    ok = (g[i] == g[j]) & (doc[i] != doc[j])
    i, j = i[ok], j[ok]
    if not len(i):
        return [np.zeros(0, np.int64)] * 4
    after, before = _matrix(c["after"], RIGHT), _matrix(c["before"], LEFT)
    right, left = _same(*after, i, j), _same(*before, i, j)
    ok = right + left >= min_words
    i, j, right, left = i[ok], j[ok], right[ok], left[ok]
    return [np.concatenate(x) for x in ((doc[i], doc[j]), (pos[i] - left, pos[j] - left), (pos[i] + right, pos[j] + right), (doc[j], doc[i]))]


def _neighbours(min_words: int):
    """Spans, and the first and last row of the partition (kind 1 and 2, with their contexts)."""
    names = ["g", "doc_id", "pos", "after", "before"]
    schema = pa.schema([("kind", pa.int32()), ("doc_id", pa.int64()), ("start", pa.int32()), ("stop", pa.int32()), ("partner", pa.int64()), ("after", pa.binary()), ("before", pa.binary())])

    def spans(found):
        m = len(found[0])
        return pa.RecordBatch.from_arrays([pa.array(np.zeros(m, np.int32)), pa.array(found[0]), pa.array(found[1].astype(np.int32)), pa.array(found[2].astype(np.int32)), pa.array(found[3]), pa.nulls(m, pa.binary()), pa.nulls(m, pa.binary())], schema=schema)

    def end(kind, c, i):
        return pa.RecordBatch.from_pylist([{"kind": kind, "doc_id": int(c["doc_id"][i]), "start": int(c["pos"][i]), "stop": 0, "partner": int(c["g"][i]), "after": c["after"][i], "before": c["before"][i]}], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for b in batches:
            if not b.num_rows:
                continue
            c = {n: b.column(n).to_numpy(zero_copy_only=False) for n in names}
            old = 0
            if held is None:
                yield end(1, c, 0)
            else:
                old = len(held["g"])
                c = {n: np.concatenate([held[n], c[n]]) for n in names}
            found = _matches(c, old, min_words)
            if len(found[0]):
                yield spans(found)
            n = len(c["g"])
            last = n - 1
            while last and c["doc_id"][last - 1] == c["doc_id"][n - 1]:
                last -= 1  # the row before this one is the last of another document
            keep = sorted({*range(max(0, n - NEAR), n), max(0, last - 1)})
            held = {k: v[keep] for k, v in c.items()}
        if held is not None:
            yield end(2, held, len(held["g"]) - 1)

    return run


def _union(found: list[dict]) -> list[list[int]]:
    spans: list[list[int]] = []
    for x in sorted(found, key=lambda x: (x["start"], x["stop"])):
        if spans and x["start"] <= spans[-1][1]:
            spans[-1][1] = max(spans[-1][1], x["stop"])
        else:
            spans.append([x["start"], x["stop"]])
    return spans


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out: list[list] = [[], [], [], [], []]
        for doc_id, found in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            spans = _union(found)
            for o, x in zip(out, (doc_id, len(spans), sum(e - s for s, e in spans), [{"start": s, "end": e} for s, e in spans], sorted({x["partner"] for x in found}))):
                o.append(x)
        yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64()), pa.array(out[3], pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), pa.array(out[4], pa.list_(pa.int64()))], names=["doc_id", "n_spans", "n_words", "spans", "partners"])


def _far(held: DataFrame, spans: DataFrame, min_words: int) -> DataFrame:
    """Spans, one a run of min_words words, of runs round hot suffixes that `spans` doesn't have."""
    hot = held.where(F.size("hot") > 0)
    had = spans.groupBy("doc_id").agg(F.collect_set(F.struct("start", "stop")).alias("found"))
    kinds = "id long, doc_id long, start int"
    left = written(hot.join(had, "doc_id", "left").select("doc_id", "text", "hot", "found").mapInArrow(_windows(min_words), kinds), "left-runs")
    every = hot.select("doc_id", "text", "hot", F.lit(None).cast("int").alias("found")).mapInArrow(_windows(min_words, _filter(left)), kinds)
    both = written(every.groupBy("id").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("a != b"), "shared-runs")
    partner = F.when(F.col("a") != F.col("doc_id"), F.col("a")).otherwise(F.col("b"))
    return left.join(both, "id").select("doc_id", "start", (F.col("start") + min_words).alias("stop"), partner.alias("partner"))


def repeats(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, n_spans, n_words, spans, partners of each document that shares a passage with another."""
    if not GRAM < min_words <= RIGHT or min_words - GRAM > LEFT:
        raise ValueError(f"min_words must be over {GRAM} and at most {min(RIGHT, LEFT + GRAM)}")
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id IS NOT NULL AND text IS NOT NULL")
    starts = written(rows.mapInArrow(_starts(min_words), "g long, doc_id long, pos int"), "starts")
    # as a table, so that the join reads plain exchanges, whose large partitions Spark splits
    twice = starts.groupBy("g").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b"), (F.count("*") > NEAR + 1).alias("hot"))
    twice = written(twice.where("a != b").select("g", "hot"), "twice")
    at = [F.collect_set("pos").alias("at"), F.collect_set(F.when(F.col("hot"), F.col("pos"))).alias("hot")]
    places = written(starts.join(twice, "g").groupBy("doc_id").agg(*at), "places")
    # texts are shuffled once: those with a repeated gram are a table that later passes read
    held = written(rows.join(places, "doc_id").select("doc_id", "text", "at", "hot"), "held-texts")
    contexts = written(held.mapInArrow(_contexts, "g long, doc_id long, pos int, after binary, before binary, hot boolean"), "suffixes")
    order = ["g", "after", "doc_id", "pos"]
    parts = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    # only a hot gram may go on in the next partition
    cut = [F.when(F.col("hot"), F.col(x)) for x in ("after", "doc_id")]
    sorted_ = contexts.repartitionByRange(parts, "g", *cut).sortWithinPartitions(*order)
    kinds = "kind int, doc_id long, start int, stop int, partner long, after binary, before binary"
    found = written(sorted_.mapInArrow(_neighbours(min_words), kinds).withColumn("part", F.spark_partition_id()), "suffix-spans")
    # two rows of each partition, whatever the data
    ends = found.where("kind > 0").orderBy("part", "kind").collect()
    edge = []
    for a, b in zip(ends, ends[1:]):
        if a["kind"] == 2 and b["kind"] == 1:
            c = {"g": np.array([a["partner"], b["partner"]]), "doc_id": np.array([a["doc_id"], b["doc_id"]]), "pos": np.array([a["start"], b["start"]])}
            c |= {k: np.array([bytes(a[k]), bytes(b[k])], object) for k in ("after", "before")}
            edge += zip(*(x.tolist() for x in _matches(c, 1, min_words)))
    spans = found.where("kind = 0").select("doc_id", "start", "stop", "partner")
    spans = spans.unionByName(spark.createDataFrame(edge, _SPANS))
    spans = spans.unionByName(_far(held, spans, min_words))
    by_doc = spans.groupBy("doc_id").agg(F.collect_set(F.struct("start", "stop", "partner")).alias("found"))
    return by_doc.mapInArrow(_merged, "doc_id long, n_spans long, n_words long, spans array<struct<start:int,end:int>>, partners array<long>")
