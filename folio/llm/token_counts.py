"""Token counts under a unigram model, by dynamic programming over a trie of distinct pre-tokens.

The distinct pre-tokens that a batch of texts adds are inserted in a trie of bytes, in sorted order, so that only the path to the node
just made is held. This one walk computes at each
node the best score of its prefix (the forward score) and the number of tokens of that best segmentation; a prefix
shared by many pre-tokens is scored once, and the count at a terminal node is that of the pre-token. A unigram
score is -log(rank + 2): the vocabulary's order stands for Zipf's law. Of segmentations with equal scores the one
with fewer tokens counts. Every byte must be a token, so each pre-token has a segmentation.

Null and empty texts have no tokens. Each row gives one row, repeated rows too; other columns are ignored. Texts are
counted whole. The vocabulary is broadcast; its size doesn't depend on the documents and is checked on reading.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.llm.bpe import KEEP, KEEP_CHARS, read_ranks

#: Characters whose pre-tokens share a trie: more of them share more prefixes and need more memory.
PART = 2_000_000


class Counter:
    """The tokens that end at a node are those that the node's state in an Aho-Corasick automaton of the vocabulary
    lists, so a node costs a few steps, not one for each length that a token can have."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.pattern = pattern
        self.step: list[dict[int, int]] = [{}]
        ends: dict[int, tuple[int, float]] = {}
        for token, rank in ranks.items():
            state = 0
            for byte in token:
                if (to := self.step[state].get(byte)) is None:
                    to = self.step[state][byte] = len(self.step)
                    self.step.append({})
                state = to
            ends[state] = len(token), -math.log(rank + 2)
        self.fail, self.found = [0] * len(self.step), [()] * len(self.step)
        queue = [0]
        for state in queue:
            if state in ends:
                self.found[state] = (ends[state], *self.found[self.fail[state]])
            else:
                self.found[state] = self.found[self.fail[state]]
            for byte, to in self.step[state].items():
                if state:
                    f = self.fail[state]
                    while f and byte not in self.step[f]:
                        f = self.fail[f]
                    self.fail[to] = self.step[f].get(byte, 0)
                queue.append(to)
        self._ready()

    def _ready(self):
        self.split, self.memo, self.old = regex.compile(self.pattern).findall, {}, {}

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("split", "memo", "old")}

    def __setstate__(self, state):
        self.__dict__ |= state
        self._ready()

    def count(self, pieces: Iterable[bytes]) -> dict[bytes, int]:
        """Tokens of each distinct piece.

        In sorted order the pieces are inserted in the trie as a depth-first walk meets them, so what is held is the
        path from the root to the node just made: scores, counts and states of its nodes. A piece goes back to where
        it leaves the path and makes, and scores, the nodes that are new."""
        out: dict[bytes, int] = {}
        step, fail, found = self.step, self.fail, self.found
        scores, counts, states = [0.0], [0], [0]
        last = b""
        for piece in sorted(pieces):
            depth = 0
            for x, y in zip(last, piece):
                if x != y:
                    break
                depth += 1
            del scores[depth + 1 :], counts[depth + 1 :], states[depth + 1 :]
            state = states[-1]
            for byte in piece[depth:]:
                while (to := step[state].get(byte)) is None and state:
                    state = fail[state]
                state = to or 0
                top, few = -math.inf, 0
                for size, score in found[state]:
                    score += scores[-size]
                    if score > top or score == top and counts[-size] + 1 < few:
                        top, few = score, counts[-size] + 1
                scores.append(top)
                counts.append(few)
                states.append(state)
            out[piece] = counts[-1]
            last = piece
        return out

    def batch(self, texts: list[str | None]) -> tuple[list[int], list[int]]:
        """Pre-tokens and tokens of each text. What earlier batches counted is kept for two generations of KEEP."""
        split = self.split
        found = [split(t) if t else [] for t in texts]
        if len(self.memo) > KEEP:
            self.memo, self.old = {}, self.memo
        memo, old = self.memo, self.old
        new = set().union(*found).difference(memo)
        memo.update((p, old[p]) for p in new if p in old)
        raw = {p.encode("utf-8", "surrogatepass"): p for p in new if p not in old}
        memo.update((raw[r], n) for r, n in self.count(raw).items())
        out = [len(p) for p in found], [sum(map(memo.__getitem__, p)) for p in found]
        for p in new:
            if len(p) > KEEP_CHARS:
                del memo[p]
        return out


def token_counts(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_pretokens, n_tokens of each row of docs."""
    counter = docs.sparkSession.sparkContext.broadcast(Counter(read_ranks(path), pattern))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, pieces, tokens, part, size = b.column(1).to_pylist(), [], [], [], 0
            for k, t in enumerate(texts):
                part.append(t)
                size += len(t or "")
                if size > PART or k + 1 == len(texts):
                    for out, x in zip((pieces, tokens), counter.value.batch(part)):
                        out += x
                    part, size = [], 0
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(pieces, pa.int64()), pa.array(tokens, pa.int64())], names=["doc_id", "n_pretokens", "n_tokens"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_pretokens long, n_tokens long")
