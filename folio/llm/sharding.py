"""Sharding by balanced label propagation.

Documents with equal texts are linked. Each document starts in the shard that its doc_id's hash names. The links are
kept pre-aggregated: a cell is one text in one starting shard, with its number of documents, so a text with a third
of all rows is at most `shards` cells. In each round every cell looks at the shards of its neighbours (the other
cells of its text), prefers the one that holds most of them, and moves there if that shard's quota admits it: its
target size and SLACK of it more, so that documents can pass each other when shards are nearly full. Texts are admitted
whole, in the order of their hash, so one that doesn't fit goes on to the next best shard in the next round; texts too
large for a shard are admitted cell by cell. Rounds go on until one admits under a hundredth of the linked documents. On
the driver a round sees `shards` squared times BINS sums, nothing that grows with the documents.

Texts that quotas have kept apart until then, though they fit a shard, gather where most of their documents are. Then
what is over is given back: shards with more linked documents than their target send pieces (all of a text that they
hold) to shards with room, largest sizes first. The driver plans this from the number of pieces of each size in those
shards (distinct sizes are few: at most about the root of twice the number of rows) and the k-th pieces of a size move.

Documents without links fill up: in each shard the rows are put in order, linked ones first, and the rows beyond the
shard's target size take the free slots of shards that lack rows. So law `rows` holds exactly: counts differ by one at
most. A text is cut where it is larger than a shard, or where sizes don't add up to the targets and no documents
without links are left to fill the rest.

Null texts have size 8, checksum 0 and no links. Null doc_ids and repeated rows are rows like any other. An empty
table gives an empty result. Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folio.llm._shared import shared_dir, written

SLACK, BINS = 0.25, 256


def _propagated(cells: DataFrame, quota: list[int], giant: int) -> DataFrame:
    """cells after rounds of moves under the quotas, until a round admits under a hundredth of the linked documents."""
    shards = len(quota)
    linked = Window.partitionBy("t1", "t2")  # at most `shards` cells each
    load = np.zeros(shards, np.int64)
    for r in cells.groupBy("shard").agg(F.sum("n").alias("n")).collect():
        load[r["shard"]] = r["n"]
    k = 0
    while True:
        free = np.maximum(0, np.array(quota) - load)
        open_ = F.array(*[F.lit(f).cast("long") for f in free.tolist()])
        # one shuffle serves both windows
        wish = cells.repartition("t1", "t2").withColumn("here", F.sum("n").over(Window.partitionBy("t1", "t2", "shard")))
        # of the neighbours' shards, one where most of the text can come together, then one that holds most of it
        fits = F.least("all", F.element_at(open_, F.col("shard") + 1) + F.col("here"))
        best = F.max(F.struct(fits.alias("fits"), "here", F.pmod(F.xxhash64("t1", "shard"), F.lit(1 << 30)).alias("tie"), F.col("shard").alias("shard"))).over(linked)
        wish = wish.withColumn("best", best)
        # a text that is admitted is whole and stays; cells of a large one move to larger parts of it only, so rounds end
        may = (F.col("best.shard") != F.col("shard")) & ((F.col("all") <= giant) | (F.col("best.here") > F.col("here")))
        unit = F.when(F.col("all") > giant, F.xxhash64("t1", "t2", "start", F.lit(k))).otherwise(F.xxhash64("t1", "t2", F.lit(k)))
        moves = wish.withColumn("to", F.when(may, F.col("best.shard"))).withColumn("u", F.pmod(unit, F.lit(BINS)).cast("int"))
        moves = written(moves.select("t1", "t2", "start", "n", "all", "shard", "to", "u"), "shard-moves")
        # in bins of the admission order: at most shards x shards x BINS numbers reach the driver
        asked = np.zeros((shards, shards, BINS), np.int64)
        for s, t, u, n in map(tuple, moves.where("to IS NOT NULL").groupBy("shard", "to", "u").agg(F.sum("n").alias("n")).collect()):
            asked[s, t, u] = n
        into = asked.sum(0)
        below = [int((np.cumsum(into[t]) <= free[t]).sum()) - 1 for t in range(shards)]
        went = np.stack([asked[:, t, : below[t] + 1].sum(1) for t in range(shards)], 1)
        admitted = F.col("to").isNotNull() & (F.col("u") <= F.element_at(F.array(*map(F.lit, below)), F.col("to") + 1))
        cells = moves.select("t1", "t2", "start", "n", "all", F.when(admitted, F.col("to")).otherwise(F.col("shard")).alias("shard"))
        load += went.sum(0) - went.sum(1)
        if went.sum() * 100 <= load.sum():
            return cells
        k += 1


def _gathered(cells: DataFrame, largest: int) -> DataFrame:
    """cells with each text of at most `largest` documents in the shard that holds most of them."""
    here = F.sum("n").over(Window.partitionBy("t1", "t2", "shard"))
    best = F.max(F.struct("here", F.pmod(F.xxhash64("t1", "shard"), F.lit(1 << 30)), F.col("shard").alias("shard"))).over(Window.partitionBy("t1", "t2"))
    moved = cells.withColumn("here", here).withColumn("best", best["shard"])
    moved = moved.withColumn("shard", F.when(F.col("all") <= largest, F.col("best")).otherwise(F.col("shard")))
    return written(moved.select("t1", "t2", "start", "n", "all", "shard"), "shard-cells")


def plan(load: dict[int, int], target: list[int], pieces: dict[tuple[int, int], int]) -> dict[tuple[int, int], list[tuple[int, int]]]:
    """Moves that bring the loads under the targets: for (shard, size), how many pieces go to which shards, in turn.
    pieces: how many pieces of each size the shards that are over their target hold."""
    over = {s: load.get(s, 0) - t for s, t in enumerate(target) if load.get(s, 0) > t}
    room = {s: t - load.get(s, 0) for s, t in enumerate(target) if load.get(s, 0) < t}
    moves: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for size in sorted({n for _, n in pieces}, reverse=True):
        for s in sorted(over):
            left = pieces.get((s, size), 0)
            # the room that fits best first, so that large rooms stay for other sizes; then the largest
            while left and over[s] >= size and (to := max((t for t in room if room[t] >= size), key=lambda t: (room[t] % size == 0, room[t]), default=None)) is not None:
                n = min(left, over[s] // size, room[to] // size)
                moves.setdefault((s, size), []).append((to, n))
                left, over[s], room[to] = left - n, over[s] - n * size, room[to] - n * size
    return moves


def _ranked(rows: DataFrame, order: list[str], keys: int, parts: int) -> tuple[DataFrame, dict]:
    """rows in the order of their columns `order` over range partitions, kept by a checkpoint, with the partition as `p`;
    and by (p, values of the first `keys` columns of order) how many rows with these values come before the partition."""
    rows = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).checkpoint()
    rows = rows.withColumn("p", F.spark_partition_id())
    seen: dict[tuple, int] = {}
    first = {}
    for p, *key, n in sorted(map(tuple, rows.groupBy("p", *order[:keys]).agg(F.count("*").alias("n")).collect())):
        first[p, *key] = seen.get(tuple(key), 0)
        seen[tuple(key)] = first[p, *key] + n
    return rows, first


def _repaired(cells: DataFrame, target: list[int], parts: int) -> DataFrame:
    """cells after pieces of shards over their target have moved to shards with room."""
    load = {r["shard"]: r["n"] for r in cells.groupBy("shard").agg(F.sum("n").alias("n")).collect()}
    full = [s for s, t in enumerate(target) if load.get(s, 0) > t]
    if not full:
        return cells
    pieces = written(cells.where(F.col("shard").isin(full)).groupBy("shard", "t1", "t2").agg(F.sum("n").alias("n")), "shard-pieces")
    moves = plan(load, target, {(s, n): c for s, n, c in map(tuple, pieces.groupBy("shard", "n").agg(F.count("*").alias("c")).collect())})
    if not moves:
        return cells
    ranked, first = _ranked(pieces.select("shard", "n", "t1", "t2"), ["shard", "n", "t1", "t2"], 2, parts)

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at: dict[tuple[int, int], int] = {}
        for b in batches:
            s, n, p = (b.column(i).to_numpy().astype(np.int64) for i in (0, 1, 4))
            to = np.full(len(s), -1, np.int64)
            cuts = np.flatnonzero((s[1:] != s[:-1]) | (n[1:] != n[:-1])) + 1
            for i, j in zip([0, *cuts.tolist()], [*cuts.tolist(), len(s)]):
                if i == j:
                    continue
                key = int(s[i]), int(n[i])
                k = at.get(key, first.get((int(p[i]), *key), 0))
                at[key] = k + j - i
                dests = moves.get(key, [])
                ends = np.cumsum([c for _, c in dests])
                where = np.searchsorted(ends, np.arange(k, k + j - i), side="right")
                to[i:j] = np.array([t for t, _ in dests] + [-1], np.int64)[where]
            go_ = to >= 0
            yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(go_)), b.column(2).filter(pa.array(go_)), b.column(3).filter(pa.array(go_)), pa.array(to[go_].astype(np.int32))], names=["shard", "t1", "t2", "to"])

    gone = ranked.mapInArrow(go, "shard int, t1 long, t2 long, to int")
    moved = cells.join(gone, ["shard", "t1", "t2"], "left").withColumn("shard", F.coalesce("to", "shard"))
    return written(moved.select("t1", "t2", "start", "n", "all", "shard"), "shard-cells")


def shard(docs: DataFrame, shards: int = 24) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of each row of docs."""
    spark = docs.sparkSession
    shared_dir(spark)
    raw = F.encode("text", "UTF-8")
    text = F.col("text")
    rows = written(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long").alias("size"),
            F.coalesce(F.crc32(raw), F.lit(0)).cast("long").alias("text_crc32"),
            F.when(text.isNotNull(), F.xxhash64("text")).alias("t1"),
            F.when(text.isNotNull(), F.xxhash64(F.lit("second"), "text")).alias("t2"),
            F.pmod(F.xxhash64("doc_id", F.lit("start")), F.lit(shards)).cast("int").alias("start"),
        ),
        "shard-rows",
    )
    total = rows.count()
    target = [total // shards + (s < total % shards) for s in range(shards)]
    parts = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    linked = Window.partitionBy("t1", "t2")  # at most `shards` cells each
    cells = rows.where("t1 IS NOT NULL").groupBy("t1", "t2", "start").agg(F.count("*").alias("n"))
    cells = cells.withColumn("all", F.sum("n").over(linked)).where("all > 1").withColumn("shard", F.col("start"))
    cells = written(cells, "shard-cells")
    if not cells.isEmpty():
        cells = _propagated(cells, [int(t * (1 + SLACK)) + 1 for t in target], max(1, min(target, default=0) // 4))
        cells = _repaired(_gathered(cells, min(target)), target, parts)
    end = cells.select("t1", "t2", "start", F.col("shard").alias("to"))
    placed = rows.join(end, ["t1", "t2", "start"], "left")
    placed = placed.select("doc_id", "size", "text_crc32", F.coalesce("to", "start").alias("shard"), F.col("to").isNull().alias("single"), F.coalesce("t1", F.lit(0)).alias("t1"))
    # the checkpoint keeps the partitions and their order, on which the slots rest
    placed, before = _ranked(placed, ["shard", "single", "t1", "doc_id"], 1, parts)
    count = [0] * shards
    for s, n in map(tuple, placed.groupBy("shard").agg(F.count("*").alias("n")).collect()):
        count[s] = n
    over, lack = np.maximum(0, np.subtract(count, target)), np.maximum(0, np.subtract(target, count))
    over_from, lack_to = np.cumsum(over) - over, np.cumsum(lack)
    target_, count_ = np.array(target, np.int64), np.array(count, np.int64)

    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, int] = {}
        for b in batches:
            s = b.column(3).to_numpy().astype(np.int64)
            part = b.column(4).to_numpy()
            slot = np.zeros(len(s), np.int64)
            for v in np.unique(s).tolist():
                at = s == v
                k = seen.get(v, before.get((int(part[0]), v), 0)) if len(part) else 0
                slot[at] = np.arange(k, k + at.sum())
                seen[v] = k + int(at.sum())
            extra = slot >= target_[s]
            g = over_from[s] + slot - target_[s]
            to = np.searchsorted(lack_to, g, side="right").clip(0, shards - 1)
            slot = np.where(extra, count_[to] + g - (lack_to[to] - lack[to]), slot)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(["rows"] * len(s)), pa.array(np.where(extra, to, s).astype(np.int32)), pa.array(slot), pa.nulls(len(s), pa.int32())], names=["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"])

    schema = "doc_id long, size long, text_crc32 long, law string, shard int, slot long, grown_shard int"
    return placed.select("doc_id", "size", "text_crc32", "shard", "p").mapInArrow(slots, schema)
