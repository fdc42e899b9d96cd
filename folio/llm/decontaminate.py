"""Benchmark decontamination by template windows.

A text is canonicalised to a template: numbers, names and units become typed placeholders, all other words their
lower case. A number is a run of digits with inner points or commas; a unit is a word of UNITS right after a number;
a name is a word with a capital first and lower case after it. One that opens a sentence or line may be a name or not:
a window that holds such a word is taken in both forms, with the word itself and with the placeholder.

Windows of WINDOW template words (of the whole item, if that is shorter) of documents and items are hash-joined. A
bitmap of fixed size over the items' window hashes, made on the executors and broadcast, first drops document windows
that no item has; its false matches fall away in the join, which is a shuffle on the window hash whatever the size of
the benchmark.

For a document and an item the windows are aligned along each shift between them. Slots are checked for consistency:
over the aligned windows each slot value of the item must stand for one value in the document, and the other way
round; windows that contradict the mapping of the rest don't count. The pair is reported as `verbatim` when windows
with equal values cover at least RUN words in a row (the whole item, if it is shorter) or half of the item's windows,
and as `reparameterised` when consistent windows cover at least COVER of the item's windows, they hold FIXED or more
distinct words that aren't slots, and a slot's value differs.

Result: one row a pair: doc_id, item_id, kind, n_windows (consistent ones), coverage (0 to 1). Null and empty texts,
null doc_ids and items without words match nothing. Each text of a repeated doc_id or item_id is judged by itself; the
pair gets the best of what its texts give (verbatim first, then more windows, then the greater coverage). A null item_id
is an id like any other. Other columns are ignored. Documents are taken whole; empty tables give an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.llm._shared import bitmap, fresh, has, written
from folio.llm._words import grams

WINDOW, RUN, COVER, FIXED, SHIFT = 8, 13, 0.6, 8, 4
BITS = 25
TOKEN = re.compile(r"\d+(?:[.,]\d+)*|[^\W\d_]+|[.!?\n]")
UNITS = frozenset("mm cm m km in ft yd mi mg g kg t lb lbs oz ml l gal s sec min h hr hrs hour hours minute minutes second seconds day days week weeks month months year years usd eur gbp dollar dollars euro euros cent cents percent kmh mph hz khz mhz ghz kb mb gb tb w kw v k c f meter meters metre metres mile miles foot feet inch inches gram grams kilogram kilograms pound pounds litre litres liter liters".split())
_PLAIN, _NUMBER, _TITLE, _UNIT, _BREAK = range(5)


def _hash(x: str) -> int:
    return xxhash.xxh64_intdigest(x.encode("utf-8", "surrogatepass"))


_SLOT = np.array([0, _hash("<number>"), _hash("<name>"), _hash("<unit>"), 0], np.uint64)


class _Ids(dict):
    """A number for each token, and by that number its hash and kind. Bounded by KEEP tokens."""

    KEEP = 1 << 17

    def __init__(self):
        self.hash, self.kind = np.zeros(1024, np.uint64), np.zeros(1024, np.int8)

    def __missing__(self, token: str) -> int:
        n = len(self)
        if n >= len(self.hash):
            self.hash, self.kind = np.resize(self.hash, 2 * n), np.resize(self.kind, 2 * n)
        low = token.lower()
        self.hash[n] = _hash(low)
        self.kind[n] = _BREAK if token in ".!?\n" else _NUMBER if token[0].isdigit() else _UNIT if low in UNITS else _TITLE if len(token) > 1 and token[0].isupper() and token[1:].islower() else _PLAIN
        self[token] = n
        return n


_ids = _Ids()


def templates(text: str | None) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Of each word of text: its hash in the template, the hash of its value, whether it is a slot. First with words that
    open a sentence or line as they are; then, if it differs, with those that have a capital as names."""
    tokens = TOKEN.findall(text) if text else ()
    if len(_ids) > _Ids.KEEP:
        _ids.clear()
    at = np.fromiter(map(_ids.__getitem__, tokens), np.int64, len(tokens))
    value, kind = _ids.hash[at], _ids.kind[at]
    before = np.empty_like(kind)
    before[:1], before[1:] = _BREAK, kind[:-1]
    title, inner = kind == _TITLE, before != _BREAK
    fixed = (kind == _NUMBER) | (kind == _UNIT) & (before == _NUMBER)
    word = kind != _BREAK
    out = []
    for slot in (fixed | title & inner, fixed | title)[: 1 + bool((title & ~inner).any())]:
        made = np.where(slot, _SLOT[kind], value)
        out.append((made[word], value[word], slot[word]))
    return out


def _windows(made: np.ndarray, size: int) -> np.ndarray:
    return grams(made, size) if len(made) >= size else made[:0]


def _forms(text: str | None, sizes: list[int] | None = None) -> Iterator[tuple[int, int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """Size, number of words, windows, their places, values and slots: of the plain form, then of the other one where it differs."""
    (made, value, slot), *more = templates(text)
    for size in [min(WINDOW, len(made))] if sizes is None else sizes:
        if not size:
            continue
        g = _windows(made, size)
        yield size, len(made), g, np.arange(len(g)), value, slot
        for other, _, names in more:
            o = _windows(other, size)
            at = np.flatnonzero(o != g)
            yield size, len(made), o[at], at, value, names


def _of_items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out: list[list] = [[] for _ in range(8)]
        for item, text, t in zip(*(b.column(i).to_pylist() for i in range(3))):
            for size, words, g, at, value, slot in _forms(text):
                for p, h in zip(at.tolist(), g.astype(np.int64).tolist()):
                    part = slice(p, p + size)
                    for o, x in zip(out, (h, item, t, p, size, words, value[part].tobytes(), slot[part].tobytes())):
                        o.append(x)
        yield pa.RecordBatch.from_arrays([pa.array(o, t) for o, t in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary()))], names=["w", "item_id", "item", "at", "size", "words", "value", "slot"])


def _place(w: np.ndarray) -> np.ndarray:
    return w.view(np.uint64) >> np.uint64(64 - BITS)  # windows' hashes are mixed


def _of_docs(bits, sizes: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have = bits.value
        for b in batches:
            w, ids, texts, at, values = [], [], [], [], []
            for doc, text, t in zip(*(b.column(i).to_pylist() for i in range(3))):
                for size, _, g, at_, value, _ in _forms(text, sizes):
                    hit = np.flatnonzero(has(have, _place(g)))
                    for k, p in zip(hit.tolist(), at_[hit].tolist()):
                        w.append(int(g[k].astype(np.int64)))
                        ids.append(doc)
                        texts.append(t)
                        at.append(p)
                        values.append(value[p : p + size].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(w, pa.int64()), pa.array(ids, pa.int64()), pa.array(texts, pa.int64()), pa.array(at, pa.int32()), pa.array(values, pa.binary())], names=["w", "doc_id", "doc", "pos", "found"])

    return run


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out: list[list] = [[] for _ in range(5)]
        for doc, item, words, hits in zip(*(b.column(i).to_pylist() for i in range(4))):
            if (said := judge(words, hits)) is not None:
                for o, x in zip(out, (doc, item, *said)):
                    o.append(x)
        yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.string()), pa.array(out[3], pa.int64()), pa.array(out[4], pa.float64())], names=["doc_id", "item_id", "kind", "n_windows", "coverage"])


def judge(words: int, hits: list[dict]) -> tuple[str, int, float] | None:
    """kind, consistent windows, coverage; None if the document doesn't hold the item. hits: at, pos, size, value, found,
    slot of each window that both have."""
    size = hits[0]["size"]
    total = max(1, words - size + 1)
    by: dict[int, list] = {}
    for h in hits:
        by.setdefault(h["pos"] - h["at"], []).append((h["at"], h["value"] == h["found"], h["slot"], h))
    plain: dict[tuple[int, bytes], set] = {}
    for at, _, slot, h in (x for xs in by.values() for x in xs):
        if (at, slot) not in plain:
            plain[at, slot] = set(np.frombuffer(h["value"], np.uint64)[~np.frombuffer(slot, bool)].tolist())
    best = None
    # every shift is judged; most are told by the windows near them, without trying slots
    for shift, _ in sorted(by.items(), key=lambda x: (-len(x[1]), x[0])):
        near = [x for d in range(-SHIFT, SHIFT + 1) for x in by.get(shift + d, ())]
        equal = {x[0] for x in near if x[1]}
        run = top = 0
        for at in range(total if equal else 0):
            run = run + 1 if at in equal else 0
            top = max(top, run)
        verbatim = bool(top) and (top + size - 1 >= min(RUN, words) or len(equal) / total >= 0.5)
        if not verbatim and (best and best[0] == "verbatim" or len({x[0] for x in near}) / total < COVER or len(set().union(*(plain[k] for k in {(x[0], x[2]) for x in near}))) < FIXED):
            continue
        # a verbatim run has its slots as they are; else windows nearest to the shift come first
        near.sort(key=lambda x: (verbatim and not x[1], abs(x[3]["pos"] - x[0] - shift), x[0], x[3]["pos"], x[2]))
        there, back, held = {}, {}, set()
        fixed, differs = set(), False
        for at, same, mask, h in near:
            if at in held:
                continue
            value, found, slot = np.frombuffer(h["value"], np.uint64), np.frombuffer(h["found"], np.uint64), np.frombuffer(mask, bool)
            pairs = list(zip(value[slot].tolist(), found[slot].tolist()))
            if any(there.get(a, c) != c or back.get(c, a) != a for a, c in pairs):
                continue
            for a, c in pairs:
                there[a], back[c] = c, a
            fixed |= plain[at, mask]
            held.add(at)
            differs |= not same
        cover = len(held) / total
        if verbatim:
            said = ("verbatim", len(held), cover)
        elif cover >= COVER and differs and len(fixed) >= FIXED:
            said = ("reparameterised", len(held), cover)
        else:
            continue
        if best is None or (said[0] == "verbatim", said[1]) > (best[0] == "verbatim", best[1]):
            best = said
    return best


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, kind, n_windows, coverage of each pair of a document and a benchmark item that it holds."""
    spark = docs.sparkSession
    hashed = lambda rows, key: rows.select(F.col(key).cast("long").alias(key), "text", F.xxhash64("text").alias("t")).where("text IS NOT NULL")
    items = hashed(benchmark, "item_id").dropDuplicates(["item_id", "t"])
    items = written(items.mapInArrow(_of_items, "w long, item_id long, item long, at int, size int, words int, value binary, slot binary"), "item-windows")
    # at most WINDOW sizes
    sizes = sorted(r["size"] for r in items.select("size").distinct().collect())
    bits = spark.sparkContext.broadcast(bitmap(items.select("w"), _place, BITS))
    found = hashed(docs, "doc_id").where("doc_id IS NOT NULL").mapInArrow(_of_docs(bits, sizes), "w long, doc_id long, doc long, pos int, found binary")
    hits = found.join(items, "w").where(F.octet_length("found") == F.col("size") * 8)
    hit = F.struct("at", "pos", "size", "value", "found", "slot")
    pairs = hits.groupBy("doc_id", "item_id", "words", "doc", "item").agg(F.collect_set(hit).alias("hits"))
    said = pairs.select("doc_id", "item_id", "words", "hits").mapInArrow(_judge, "doc_id long, item_id long, kind string, n_windows long, coverage double")
    best = F.max(F.struct((F.col("kind") == "verbatim").alias("v"), "n_windows", "coverage", "kind")).alias("best")
    return said.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "best.kind", "best.n_windows", "best.coverage")


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs without a leak, with the columns they had; of a doc_id that leaks, all rows go."""
    (name,) = fresh(docs, "away")
    away = written(leaks(docs, benchmark).select(F.col("doc_id").alias(name)).distinct(), "leaks")
    return docs.join(away, F.col("doc_id").cast("long") == F.col(name), "left_anti")
