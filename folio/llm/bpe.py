"""Byte-level BPE encoding and decoding by a two-tier lookup.

Tier one is a minimal perfect hash over the vocabulary (hash and displace): a pre-token that is itself a token
resolves in one probe and one comparison. Tier two, for the rest, merges linked bytes with a heap of candidate
pairs ordered by rank and place, in O(n log n) for a pre-token of n bytes. The rank file is read on the driver and
broadcast: its size is that of one vocabulary (under MAX_VOCAB entries, checked), whatever the documents are.

Null and empty texts encode to no ids. Repeated rows and ties of doc_id each give their own row. Columns of the
input other than doc_id and text are ignored. Long texts are encoded whole.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterable, Iterator

import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_VOCAB = 2_000_000
#: Memoised pre-tokens of a worker, and the longest that is memoised: together they bound its memory.
KEEP, KEEP_CHARS = 1 << 17, 48


def read_ranks(path: str) -> dict[bytes, int]:
    """Token to rank, from lines of base64 and rank."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    if len(ranks) > MAX_VOCAB:
        raise ValueError(f"{len(ranks)} tokens; at most {MAX_VOCAB} are broadcast")
    return ranks


class PerfectHash:
    """A minimal perfect hash from tokens to ids: as many slots as tokens. Buckets of about two tokens each hold a
    displacement; a bucket of one token holds its slot itself, as -1 - slot."""

    def __init__(self, ranks: dict[bytes, int]):
        self.n = n = len(ranks)
        self.buckets = m = max(1, n // 2)
        for self.seed in range(64):
            found: list[list[tuple[int, int, bytes]]] = [[] for _ in range(m)]
            for token in ranks:
                h = xxhash.xxh3_64_intdigest(token, self.seed)
                found[(h >> 20) % m].append((h & 0xFFFFF, h >> 44 | 1, token))
            self.shift, self.slots = [0] * m, [None] * n
            if self._place(found):
                break
        else:
            raise ValueError("no displacement found")
        self.ids = [ranks[t] for t in self.slots]

    def _place(self, found: list[list[tuple[int, int, bytes]]]) -> bool:
        n, slots = self.n, self.slots
        for bucket in sorted(range(len(found)), key=lambda b: -len(found[b])):
            items = found[bucket]
            if len(items) < 2:
                break
            for d in range(1, 1 << 16):
                at = [(a * 31 + d * b) % n for a, b, _ in items]
                if len(set(at)) == len(at) and all(slots[i] is None for i in at):
                    break
            else:
                return False
            self.shift[bucket] = d
            for i, (_, _, token) in zip(at, items):
                slots[i] = token
        free = iter([i for i, t in enumerate(slots) if t is None])
        for bucket, items in enumerate(found):
            if len(items) == 1:
                i = next(free)
                slots[i], self.shift[bucket] = items[0][2], -1 - i
        return True

    def get(self, token: bytes) -> int | None:
        """The id of token, None if it isn't one."""
        if not self.n:
            return None
        h = xxhash.xxh3_64_intdigest(token, self.seed)
        d = self.shift[(h >> 20) % self.buckets]
        i = -1 - d if d < 0 else ((h & 0xFFFFF) * 31 + d * (h >> 44 | 1)) % self.n
        return self.ids[i] if self.slots[i] == token else None


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of piece: the pair of lowest rank, leftmost first, is merged until none is a token.

    Parts are linked by where they end and where the one before starts; the heap holds (rank, start, end of the pair)
    packed in one integer, and an entry of which a part has changed since is passed over."""
    n, get = len(piece), ranks.get
    if n == 1:
        return [ranks[piece]]
    bits = n.bit_length()
    mask = (1 << bits) - 1
    end = list(range(1, n + 1))  # of the part that starts here; 0 once it is merged into the one before
    before = list(range(-1, n - 1))
    heap = [(r << bits | i) << bits | i + 2 for i in range(n - 1) if (r := get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    pop, push = heapq.heappop, heapq.heappush
    while heap:
        x = pop(heap)
        stop, i = x & mask, x >> bits & mask
        j = end[i]
        if not j or j >= n or end[j] != stop:
            continue
        end[i], end[j] = stop, 0
        if stop < n:
            before[stop] = i
            e = end[stop]
            if (r := get(piece[i:e])) is not None:
                push(heap, (r << bits | i) << bits | e)
        if (p := before[i]) >= 0 and (r := get(piece[p:stop])) is not None:
            push(heap, (r << bits | p) << bits | stop)
    out, i = [], 0
    while i < n:
        j = end[i]
        out.append(ranks[piece[i:j]])
        i = j
    return out


class Memo(dict):
    """What was made of the keys seen lately: two generations of KEEP each, so those in use outlast a change."""

    def __init__(self, make):
        self.make, self.old = make, {}

    def __missing__(self, key):
        if (out := self.old.get(key)) is None:
            out = self.make(key)
        if len(key) <= KEEP_CHARS:
            if len(self) >= KEEP:
                self.old = dict(self)
                self.clear()
            self[key] = out
        return out


class Codec:
    """encode and decode by the two tiers."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.hash, self.ranks, self.pattern = PerfectHash(ranks), ranks, pattern
        self.token = {i: t for t, i in ranks.items()}
        self._ready()

    def _ready(self):
        self.split, self.written, self.back = regex.compile(self.pattern).findall, Memo(self._written), Memo(self._back)

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("split", "written", "back")}

    def __setstate__(self, state):
        self.__dict__ |= state
        self._ready()

    def ids(self, piece: bytes) -> list[int]:
        whole = self.hash.get(piece)
        return [whole] if whole is not None else merge(piece, self.ranks)

    def encode(self, text: str) -> list[int]:
        return [i for piece in self.split(text) for i in self.ids(piece.encode("utf-8", "surrogatepass"))]

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.token.__getitem__, ids))

    def _written(self, piece: str) -> str:
        return ",".join(map(str, self.ids(piece.encode("utf-8", "surrogatepass"))))

    def _back(self, piece: str) -> bytes:
        return self.decode(map(int, self.written[piece].split(",")))

    def both(self, text: str) -> tuple[str, bytes]:
        """The ids of text, joined by commas, and what they decode to."""
        pieces = self.split(text)
        return ",".join(map(self.written.__getitem__, pieces)), b"".join(map(self.back.__getitem__, pieces))


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, ids (array of int), decoded (binary) of each row of docs."""
    codec = docs.sparkSession.sparkContext.broadcast(Codec(read_ranks(path), pattern))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = [codec.value.encode(t or "") for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array([codec.value.decode(x) for x in ids], pa.binary())], names=["doc_id", "ids", "decoded"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, ids array<int>, decoded binary")


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: digests of what encode() gives, without moving ids between processes."""
    codec = docs.sparkSession.sparkContext.broadcast(Codec(read_ranks(path), pattern))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sha = hashlib.sha256
        for b in batches:
            n, ids, back = [], [], []
            for text in b.column(1).to_pylist():
                written, decoded = codec.value.both(text or "")
                n.append(written.count(",") + 1 if written else 0)
                ids.append(sha(written.encode()).hexdigest())
                back.append(sha(decoded).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(back, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
