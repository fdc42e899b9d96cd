"""N-gram Jaccard self-join by chosen paths.

A document is the set of its word shingles (`words` words of letters, digits or underscores, in lower case; a text of
fewer words is one shingle). Documents with equal sets form a class; classes are joined, copies are counted.

Chosen paths: a set is embedded as `EMBED` minwise tokens. In each run, every set starts at the root; at a node, the
tokens of a few sampled places split the sets over child nodes, each place being sampled with probability
c / (similarity * EMBED), the same for all sets at the node. Nodes with one set end, nodes with at most `small` sets
are compared by brute force, larger ones are split again, down to `DEPTH`. A pair of the least similarity meets on
average c times at each level, so a run keeps it with probability at least s (the fixed point below, DEPTH deep), and
as many runs are made as (1 - s) ** runs <= 1 - recall asks for. Seeds of the roots are fixed, so runs whose root samples
no place are left out, and runs go on until their roots have as many places in all as that number has on average.

Brute force is in blocks: the sets of a node are dealt to blocks of BLOCK, and each pair of blocks is a task's work,
so a node with a third of all sets is spread out. A pair is compared only in the first of its common nodes. First the
embedded tokens are compared, which are carried by each row, and of the sets that still have a partner the shingles
are fetched and compared exactly. What leaves a comparison is, for each set, a sum of linked documents and one edge
to the least set it is connected with there: never all pairs. The edges are joined to groups by large-star and
small-star rounds on DataFrames.

Result: one row a document with class_id (least doc_id of the group of documents connected by links), set_id (least
doc_id with an equal set), n_shingles and n_links (documents, other than itself, whose similarity is at least
`similarity`). Null doc_ids and documents without a word have no links; they are a class of their own, a null doc_id
has a null class. Repeated rows of a doc_id count as documents. Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.llm._shared import bitmap, fresh, has, sliced, written
from folio.llm._words import grams, mix, word_hashes

WORDS, SIMILARITY, RECALL = 5, 0.8, 0.9999
EMBED, DEPTH, SMALL, BLOCK, GAIN = 64, 3, 256, 256, 1.25
#: Estimates from EMBED tokens have a deviation of at most 0.06: pairs under similarity - SLACK aren't looked at again.
SLACK = 0.3
FILTER_BITS = 25
_SEEDS = mix(np.arange(1, EMBED + 1, dtype=np.uint64))


def runs(similarity: float, recall: float) -> int:
    """Runs that find a pair of just this similarity with probability `recall`."""
    s = 1.0
    for _ in range(DEPTH):
        s = 1 - math.exp(-GAIN * s)
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - s)))


def _rate(similarity: float) -> np.uint64:
    return np.uint64(min(int(GAIN / (similarity * EMBED) * 2.0**64), 2**64 - 1))


_PLACE = mix(np.arange(1000, 1000 + EMBED, dtype=np.uint64))


def _roots(similarity: float, recall: float) -> list[int]:
    """Seeds of the runs: those whose root samples a place, until the places are as many as `runs` takes on average."""
    out, places, seed = [], 0, 0
    while places < runs(similarity, recall) * min(EMBED, GAIN / similarity):
        seed += 1
        n = int((mix(mix(np.full(1, seed, np.uint64)) + _PLACE) < _rate(similarity)).sum())
        if n:
            out.append(seed)
            places += n
    return out


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """The sorted distinct shingle hashes of text."""
    return np.unique(grams(word_hashes(text), words))


def _embed(s: np.ndarray) -> np.ndarray:
    out = np.full(EMBED, np.iinfo(np.uint64).max, np.uint64)
    for a in range(0, len(s), 4096):
        x = (s[a : a + 4096, None] ^ _SEEDS) * np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(32)
        np.minimum(out, x.min(0), out=out)
    return (mix(out) >> np.uint64(32)).astype(np.uint32)


def _sketches(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h1, h2, n, e = [], [], [], []
            for text in b.column(1).to_pylist():
                s = shingles(text, words)
                h = xxhash.xxh3_128_intdigest(s.tobytes())
                h1.append((h >> 64) - (1 << 63))
                h2.append((h & (1 << 64) - 1) - (1 << 63))
                n.append(len(s))
                e.append(_embed(s).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.array(n, pa.int64()), pa.array(e, pa.binary())], names=["doc_id", "h1", "h2", "n", "embed"])

    return run


def _children(similarity: float, root: list[int] | None):
    """Rows of the child nodes of each (path, id, embed); with root, of the roots with these seeds."""
    rate, place = _rate(similarity), _PLACE

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            e = np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint32).reshape(n, EMBED)
            ids = b.column(0).to_numpy()
            paths = [mix(np.full(n, r, np.uint64)) for r in root] if root else [b.column(2).to_numpy().astype(np.uint64)]
            got, to = [], []
            for p in paths:
                if root:
                    at = np.flatnonzero(mix(p[:1] + place) < rate)
                    row, col = np.repeat(np.arange(n), len(at)), np.tile(at, n)
                else:
                    row, col = np.nonzero(mix(p[:, None] + place) < rate)
                got.append(mix((p[row] + place[col]) * np.uint64(0x9E3779B97F4A7C15) + e[row, col]).astype(np.int64))
                to.append(ids[row])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(got)), pa.array(np.concatenate(to))], names=["path", "id"])

    return run


def _met(path: int, lists: list[np.ndarray]) -> np.ndarray:
    """Whether two sets share a node before this one, for each pair."""
    earlier = [x[x < path] for x in lists]
    sizes = [len(x) for x in earlier]
    if not sum(sizes):
        return np.zeros((len(lists), len(lists)), bool)
    _, inverse = np.unique(np.concatenate(earlier), return_inverse=True)
    m = np.zeros((len(lists), inverse.max() + 1), np.float32)
    m[np.repeat(np.arange(len(lists)), sizes), inverse] = 1
    return m @ m.T > 0


def _open_pairs(g: dict[str, np.ndarray], similarity: float) -> np.ndarray:
    """Pairs of a node that this task has to compare: not met before, of fitting sizes, in the blocks asked for."""
    n = g["n"].astype(np.float64)
    lists = [np.frombuffer(x, np.int64) for x in g["nodes"]]
    ok = np.minimum.outer(n, n) >= similarity * np.maximum.outer(n, n)
    ok &= ~_met(int(g["path"][0]), lists)
    np.fill_diagonal(ok, False)
    if g["b1"][0] != g["b2"][0]:
        ok &= g["blk"][:, None] != g["blk"]
    return ok


def _candidates(similarity: float):
    """Of each node, the sets that may have a partner there."""
    keep = ("path", "b1", "b2", "id", "blk", "nodes")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: dict[str, list] = {k: [] for k in keep}
        size = 0
        for g in sliced(batches, ["path", "b1", "b2"]):
            if len(g["id"]) < 2:
                continue
            ok = _open_pairs(g, similarity)
            x, y = np.nonzero(np.triu(ok))
            if not len(x):
                continue
            e = np.frombuffer(b"".join(g["embed"]), np.uint32).reshape(-1, EMBED)
            hit = np.zeros(len(e), bool)
            for a in range(0, len(x), 65536):
                i, j = x[a : a + 65536], y[a : a + 65536]
                near = (e[i] == e[j]).mean(1) >= similarity - SLACK
                hit[i[near]] = hit[j[near]] = True
            if hit.any():
                for k in keep:
                    out[k].append(g[k][hit])
                size += int(hit.sum())
            if size >= 2000:
                yield _batch(out, keep)
                out, size = {k: [] for k in keep}, 0
        if size:
            yield _batch(out, keep)

    return run


_TYPES = {"path": pa.int64(), "b1": pa.int32(), "b2": pa.int32(), "id": pa.int64(), "blk": pa.int32(), "nodes": pa.binary(), "root": pa.int64(), "links": pa.int64()}


def _batch(out: dict[str, list], keys) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(out[k]), _TYPES[k]) for k in keys], names=list(keys))


def _intersections(sets: list[np.ndarray]) -> np.ndarray:
    sizes = [len(s) for s in sets]
    _, inverse, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sets)), sizes)
    shared = count[inverse] > 1
    row, col = row[shared], inverse[shared]
    _, col = np.unique(col, return_inverse=True)
    out = np.zeros((len(sets), len(sets)), np.float64)
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    top = int(col[-1]) + 1 if len(col) else 0
    for a in range(0, top, 8192):
        i, j = np.searchsorted(col, [a, a + 8192])
        m = np.zeros((len(sets), min(8192, top - a)), np.float32)
        m[row[i:j], col[i:j] - a] = 1
        out += m @ m.T
    return out


def _verified(similarity: float):
    """For each set of a node: linked documents, and the least set it is connected with."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: dict[str, list] = {k: [] for k in ("id", "root", "links")}
        size = 0
        for g in sliced(batches, ["path", "b1", "b2"]):
            m = len(g["id"])
            if m < 2:
                continue
            ok = _open_pairs(g, similarity)
            both = _intersections([np.frombuffer(x, np.uint64) for x in g["set"]])
            n = g["n"].astype(np.float64)
            # the same division as in a plain comparison of two sets, so the threshold cuts alike
            ok &= both / (n[:, None] + n - both) >= similarity
            if not ok.any():
                continue
            links = ok @ g["copies"].astype(np.float64)
            root = np.arange(m)
            ids = g["id"]
            rank = np.argsort(np.argsort(ids, kind="stable"), kind="stable")
            root = rank.copy()
            while True:
                low = np.minimum(root, np.where(ok, root, m).min(1))
                if (low == root).all():
                    break
                root = low
            least = np.sort(ids)[root]
            has = ok.any(1)
            for k, v in (("id", ids[has]), ("root", least[has]), ("links", links[has].astype(np.int64))):
                out[k].append(v)
            size += int(has.sum())
            if size >= 20_000:
                yield _batch(out, ("id", "root", "links"))
                out, size = {k: [] for k in out}, 0
        if size:
            yield _batch(out, ("id", "root", "links"))

    return run


def groups(edges: DataFrame) -> DataFrame:
    """id, root (least id it is connected with) for each id of edges (id, root), by large-star and small-star rounds."""
    e = written(edges.where("id != root").select(F.greatest("id", "root").alias("u"), F.least("id", "root").alias("v")).distinct(), "edges")
    state = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # as tables, so that joins read plain exchanges, whose large partitions Spark splits
        low = written(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "leasts")
        e = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        e = written(e, "edges")
        # small-star: neighbours that are less, and the node itself, to the least of them
        low = written(e.groupBy("u").agg(F.min("v").alias("m")), "leasts")
        star = e.join(low, "u").select("u", "v", "m")
        e = star.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(star.select("u", F.col("m").alias("v"))).where("u != v").distinct()
        e = written(e, "edges")
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            return e.select(F.col("u").alias("id"), F.col("v").alias("root"))
        state = now


def _blocked(rows: DataFrame) -> DataFrame:
    """A row for each pair of blocks that it belongs to, with b1 <= b2; rows have path, id, size of the node."""
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    rows = rows.withColumn("blk", F.pmod(F.xxhash64("id", "path"), blocks).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    return rows.withColumn("b1", F.least("blk", "other").cast("int")).withColumn("b2", F.greatest("blk", "other").cast("int"))


def join(docs: DataFrame, words: int = WORDS, similarity: float = SIMILARITY, recall: float = RECALL, small: int = SMALL) -> DataFrame:
    """doc_id, class_id, set_id, n_shingles, n_links of each row of docs."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    all_ = written(rows.mapInArrow(_sketches(words), "doc_id long, h1 long, h2 long, n long, embed binary"), "sketches")
    live = all_.where("n > 0 AND doc_id IS NOT NULL")
    classes = written(live.groupBy("h1", "h2").agg(F.min("doc_id").alias("id"), F.max("n").alias("n"), F.count("*").alias("copies")), "classes")
    sets = live.select(F.col("doc_id").alias("id"), "h1", "h2", "embed").join(classes, ["h1", "h2", "id"]).dropDuplicates(["id"])
    sets = written(sets.select("id", "n", "copies", "embed"), "sets")

    # nodes of the first level, then of each further one
    at = written(sets.select("id", "embed").mapInArrow(_children(similarity, _roots(similarity, recall)), "path long, id long"), "paths")
    leaves = None
    for depth in range(1, DEPTH + 1):
        # as a table, so that both sides of the join are plain exchanges, whose large partitions Spark splits
        sizes = written(at.groupBy("path").agg(F.count("*").alias("size")).where("size > 1"), "node-sizes")
        held = written(at.join(sizes, "path"), "nodes")
        done = held if depth == DEPTH else held.where(F.col("size") <= small)
        leaves = done if leaves is None else leaves.unionByName(done)
        more = held.where(F.col("size") > small)
        if depth == DEPTH or more.isEmpty():
            break
        deeper = more.select("id", "path").join(sets.select("id", "embed"), "id").select("id", "embed", "path")
        # two nodes may share a child's hash only by accident, and a set may come to a node once
        at = written(deeper.mapInArrow(_children(similarity, None), "path long, id long").distinct(), "paths")

    own = leaves.groupBy("id").agg(F.array_sort(F.collect_set("path")).alias("nodes"))
    own = own.join(sets, "id").select("id", "n", "embed", "nodes")
    order = ["path", "b1", "b2"]
    parts = max(8, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    near = _blocked(leaves.select("path", "id", "size").join(_packed(own), "id"))
    near = near.select("path", "b1", "b2", "id", "blk", "n", "embed", "nodes").repartition(parts, *order).sortWithinPartitions(*order)
    near = written(near.mapInArrow(_candidates(similarity), "path long, b1 int, b2 int, id long, blk int, nodes binary"), "near")

    # texts aren't shuffled: those whose id may be wanted give their sets where they are read
    sets_of = _shingle_sets(rows.where("doc_id IS NOT NULL"), words, _filter(near)).join(classes.select("h1", "h2", F.col("id"), "n", "copies"), ["h1", "h2", "id"]).dropDuplicates(["id"])
    sets_of = written(sets_of.select("id", "n", "copies", "set"), "shingles")
    full = near.join(sets_of, "id").select("path", "b1", "b2", "id", "blk", "nodes", "n", "copies", "set")
    full = full.repartition(parts, *order).sortWithinPartitions(*order)
    linked = written(full.mapInArrow(_verified(similarity), "id long, root long, links long"), "links")

    links = linked.groupBy("id").agg(F.sum("links").alias("links"))
    roots = groups(linked.select("id", "root"))
    found = classes.join(links, "id", "left").join(roots, "id", "left")
    found = found.select("h1", "h2", F.col("id").alias("set_id"), F.coalesce("root", "id").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    key = F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.col("h1"))
    out = all_.select("doc_id", "n", key.alias("h1"), "h2").join(found, ["h1", "h2"], "left")
    return out.select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("set_id", "doc_id").alias("set_id"), F.col("n").alias("n_shingles"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def _packed(own: DataFrame) -> DataFrame:
    """The list of nodes as bytes, which costs little to carry and to read."""

    def run(batches):
        for b in batches:
            nodes = [np.array(x, np.int64).tobytes() for x in b.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(nodes, pa.binary())], names=["id", "n", "embed", "nodes"])

    return own.mapInArrow(run, "id long, n long, embed binary, nodes binary")


def _place(ids: np.ndarray) -> np.ndarray:
    return mix(ids.astype(np.uint64) + np.uint64(77)) >> np.uint64(64 - FILTER_BITS)


def _filter(rows: DataFrame):
    """A bitmap of the ids of rows, broadcast."""
    return rows.sparkSession.sparkContext.broadcast(bitmap(rows.select("id"), _place, FILTER_BITS))


def _shingle_sets(rows: DataFrame, words: int, wanted) -> DataFrame:
    def run(batches):
        for whole in batches:
            b = whole.take(pa.array(np.flatnonzero(has(wanted.value, _place(whole.column(0).to_numpy())))))
            for part in (b.slice(i, 512) for i in range(0, b.num_rows, 512)):
                found = [shingles(t, words).tobytes() for t in part.column(1).to_pylist()]
                h = [xxhash.xxh3_128_intdigest(x) for x in found]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([(x >> 64) - (1 << 63) for x in h], pa.int64()), pa.array([(x & (1 << 64) - 1) - (1 << 63) for x in h], pa.int64()), pa.array(found, pa.binary())], names=["id", "h1", "h2", "set"])

    return rows.mapInArrow(run, "id long, h1 long, h2 long, set binary")


def one_of_each(docs: DataFrame, words: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of docs whose doc_id is the least of its group; rows with a null doc_id stay. Columns stay as they are."""
    (name,) = fresh(docs, "away")
    away = join(docs, words, similarity).where("class_id != doc_id").select(F.col("doc_id").alias(name)).distinct()
    return docs.join(written(away, "away"), F.col("doc_id").cast("long") == F.col(name), "left_anti")
