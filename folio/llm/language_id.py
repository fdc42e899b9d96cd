"""Language identification by interpolated Kneser-Ney character models, one a language.

A text is its words in lower case (runs of letters), each between two bounds; contexts end at a word's bound, so a
word's log-probability doesn't depend on its neighbours and is computed once for each distinct word of a batch. The
model of a language is, for each order up to ORDER, a sorted array of n-gram hashes with the interpolated
log-probability of each, and one of context hashes with the weight that the next lower order gets. All orders below
the highest count the distinct characters that precede an n-gram, as Kneser and Ney do. Characters that a language
never had get the uniform share of the lowest order.

The prediction is the language of lowest cross-entropy per character (ties: the first in alphabetical order). It is
rejected when that cross-entropy is above what texts of that language and length have: mean + z * deviation /
sqrt(length) + slack, all three measured on a part of the sample that the models of that step didn't count. Texts
that are null or have no letter are `und` and rejected.

The models are fitted on a bounded sample: about `sample` whole labelled documents a language and TOTAL of all
languages (LEAST of each at least), those whose hash is lowest, so the driver holds the n-grams of so many texts
whatever the table's size. Every language is learned; more than MAX_LANGS distinct values are no languages, which is an
error. Every document is predicted from its whole text. Rows with null lang are not learned from; without any labelled
row all are `und`. Repeated rows give as many result rows; columns other than those named are never inputs.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.llm._words import mix

ORDER = 5
#: Documents that the models are fitted on: of a language, of all languages, and of each one even then.
SAMPLE, TOTAL, LEAST, MAX_LANGS = 1500, 100_000, 8, 10_000
LETTERS = re.compile(r"[^\W\d_]+")
START, END = "\x02", "\x03"
_K = np.uint64(0x9E3779B97F4A7C15)
#: Words whose scores a worker keeps (under eight languages or fewer), and characters of texts whose words it holds at a time.
KEEP, PART = 1 << 17, 1_000_000


def _codes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all words, each between bounds, and where each word starts."""
    joined = "".join([f"{START}{w}{END}" for w in words])
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    starts = np.concatenate([[0], np.cumsum([len(w) + 2 for w in words])]).astype(np.int64)
    return codes, starts


def _ngram_hashes(codes: np.ndarray, starts: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """hashes[k][i]: of the k+1 characters that end at i (valid where i lies k or more into its word); depth of each i."""
    n = len(codes)
    depth = np.arange(n) - np.repeat(starts[:-1], np.diff(starts))
    out = []
    for k in range(ORDER):
        h = np.zeros(n, np.uint64)
        for j in range(k, -1, -1):
            h[k:] = h[k:] * _K + codes[k - j : n - j] + np.uint64(1)
        out.append(mix(h + np.uint64(k + 1)))
    return out, depth


class Model:
    """One language. grams[k], probs[k]: hashes of order k+1 and their interpolated log-probabilities; contexts[k],
    weights[k]: hashes of contexts of k characters and the log of the weight of the next lower order."""

    def __init__(self, counts: Counter):
        words = sorted(counts)
        codes, starts = _codes(words)
        times = np.repeat(np.array([counts[w] for w in words], np.float64), np.diff(starts))
        hashes, depth = _ngram_hashes(codes, starts)
        self.grams, self.probs, self.contexts, self.weights = [], [], [], []
        self.floor = -math.log(max(2, len(np.unique(codes))) * 4)
        lower_grams, lower = None, None
        for k in range(ORDER):
            at = np.flatnonzero((depth >= k) & (depth > 0))
            gram = hashes[k][at]
            if k + 1 < ORDER:  # distinct characters before; a word's start has none before it and counts by itself
                longer = np.where(depth[at] > k, hashes[k + 1][at], gram)
                longer, where = np.unique(longer, return_index=True)
                gram, n = gram[where], np.ones(len(where))
            else:
                where, n = np.arange(len(at)), times[at]
            at = at[where]
            context = hashes[k - 1][at - 1] if k else np.zeros(len(at), np.uint64)
            grams, first, inverse = np.unique(gram, return_index=True, return_inverse=True)
            c = np.bincount(inverse, n, len(grams))
            n1, n2 = (c == 1).sum(), (c == 2).sum()
            d = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
            contexts, of = np.unique(context[first], return_inverse=True)
            total = np.bincount(of, c, len(contexts))
            kinds = np.bincount(of, minlength=len(contexts))
            gamma = d * kinds / total
            below = math.exp(self.floor)
            if k:
                shorter = hashes[k - 1][at[first]]
                i = np.searchsorted(lower_grams, shorter).clip(0, max(0, len(lower_grams) - 1))
                below = np.where(lower_grams[i] == shorter, lower[i], math.exp(self.floor))
            p = np.maximum(c - d, 0) / total[of] + gamma[of] * below
            self.grams.append(grams)
            self.probs.append(np.log(p).astype(np.float32))
            self.contexts.append(contexts)
            self.weights.append(np.log(gamma).astype(np.float32))
            lower_grams, lower = grams, p

    def score(self, hashes: list[np.ndarray], depth: np.ndarray) -> np.ndarray:
        """Log-probability of the character at each place; 0 at a word's start."""
        out = np.zeros(len(depth), np.float32)
        left = np.flatnonzero(depth > 0)
        for k in range(ORDER - 1, -1, -1):
            at = left[depth[left] >= k] if k else left
            if not len(at):
                continue
            h = hashes[k][at]
            i = np.searchsorted(self.grams[k], h).clip(0, len(self.grams[k]) - 1)
            hit = self.grams[k][i] == h
            out[at[hit]] += self.probs[k][i[hit]]
            miss = at[~hit]
            context = hashes[k - 1][miss - 1] if k else np.zeros(len(miss), np.uint64)
            i = np.searchsorted(self.contexts[k], context).clip(0, len(self.contexts[k]) - 1)
            out[miss] += np.where(self.contexts[k][i] == context, self.weights[k][i], 0)
            if not k:
                out[miss] += self.floor
            shallow = left[depth[left] < k] if k else left[:0]
            left = np.concatenate([miss, shallow])
        return out


class Identifier:
    def __init__(self, counts: dict[str, Counter]):
        self.langs = sorted(counts)
        self.models = [Model(counts[x]) for x in self.langs]
        self.limits = {x: (math.inf, 0.0, 0.0) for x in self.langs}
        self.keep = KEEP * 8 // max(8, len(self.langs))
        self.memo: dict[str, int] = {}
        self.scores = np.zeros((0, len(self.langs)), np.float32)

    def __getstate__(self):
        return self.__dict__ | {"memo": {}, "scores": np.zeros((0, len(self.langs)), np.float32)}

    def words(self, words: list[str]) -> np.ndarray:
        """Log-probability of each word under each language."""
        out = np.zeros((len(words), len(self.langs)), np.float32)
        for a in range(0, len(words), 20_000):
            codes, starts = _codes(words[a : a + 20_000])
            hashes, depth = _ngram_hashes(codes, starts)
            for k, model in enumerate(self.models):
                out[a : a + 20_000, k] = np.add.reduceat(model.score(hashes, depth), starts[:-1])
        return out

    def entropies(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Characters of each text, and its cross-entropy per character under each language."""
        found = [LETTERS.findall(t.lower()) if t else [] for t in texts]
        new = {w for words in found for w in words if w not in self.memo}
        if len(self.memo) + len(new) > self.keep:
            self.memo, self.scores = {}, self.scores[:0]
            new = {w for words in found for w in words}
        if new:
            known = len(self.memo)
            new = sorted(new)
            self.memo.update(zip(new, range(known, known + len(new))))
            self.scores = np.concatenate([self.scores, self.words(new)])
        chars, out = np.zeros(len(texts), np.int64), np.zeros((len(texts), len(self.langs)))
        get = self.memo.__getitem__
        for i, words in enumerate(found):
            if words:
                chars[i] = sum(map(len, words)) + len(words)
                at = np.fromiter(map(get, words), np.int64, len(words))
                out[i] = -self.scores[at].sum(0, dtype=np.float64) / chars[i]
        if len(self.memo) > self.keep:
            self.memo, self.scores = {}, self.scores[:0]
        return chars, out

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float], list[bool]]:
        """Language, score from 0 to 1 and whether it is rejected, for each text. The words of PART characters of texts
        are held at a time."""
        out: tuple[list, list, list] = [], [], []
        part, size = [], 0
        for k, t in enumerate(texts):
            part.append(t)
            size += len(t or "")
            if size >= PART or k + 1 == len(texts):
                for all_, some in zip(out, self._predict(part)):
                    all_ += some
                part, size = [], 0
        return out

    def _predict(self, texts: list[str | None]) -> tuple[list[str], list[float], list[bool]]:
        if not self.langs:
            return ["und"] * len(texts), [0.0] * len(texts), [True] * len(texts)
        chars, h = self.entropies(texts)
        best = h.argmin(1)
        # the posterior of even priors, for a text of at most 20 characters' evidence
        e = np.exp(-(h - h.min(1, keepdims=True)) * np.minimum(chars, 20)[:, None])
        score = e.max(1) / e.sum(1)
        out = [], [], []
        for n, b, s, low in zip(chars.tolist(), best.tolist(), score.tolist(), h.min(1).tolist()):
            mean, deviation, slack = self.limits[self.langs[b]]
            out[0].append(self.langs[b] if n else "und")
            out[1].append(s if n else 0.0)
            out[2].append(not n or low > mean + deviation / math.sqrt(max(n, 1)) + slack)
        return out

    def calibrate(self, texts: list[str], langs: list[str], z: float) -> None:
        """The limits of rejection, from labelled texts that the models haven't counted."""
        chars, h = self.entropies(texts)
        place = {x: k for k, x in enumerate(self.langs)}
        of = np.array([place.get(x, -1) for x in langs], np.int64)
        for k, lang in enumerate(self.langs):
            own = np.flatnonzero((of == k) & (chars > 0))
            n, x = chars[own], h[own, k]
            if len(own) < 4:
                continue
            mean = float(np.median(x))
            deviation = float(np.median(np.abs(x - mean) * np.sqrt(n)) * 1.4826) * z
            beyond = x - mean - deviation / np.sqrt(n)
            self.limits[lang] = mean, deviation, max(0.75, 2 * float(beyond.max()))


def _counts(texts: list[str]) -> Counter:
    out: Counter = Counter()
    for t in texts:
        out.update(LETTERS.findall(t.lower()))
    return out


def learn(labelled: DataFrame, sample: int = SAMPLE, z: float = 6.0) -> Identifier:
    """An identifier from rows with doc_id, text, lang. Of a language with n rows, those in the lowest sample / n of
    hashes are taken, so about `sample` of each, and less where there are over TOTAL / sample languages."""
    rows = labelled.where("lang IS NOT NULL AND text IS NOT NULL").select("doc_id", "lang", "text")
    sizes = rows.groupBy("lang").agg(F.count("*").alias("n")).limit(MAX_LANGS + 1).collect()
    if len(sizes) > MAX_LANGS:
        raise ValueError(f"lang has over {MAX_LANGS} values")
    if not sizes:
        return Identifier({})
    each = min(sample, max(LEAST, TOTAL // len(sizes)))
    rates = labelled.sparkSession.createDataFrame([(r["lang"], min(1.0, each / r["n"])) for r in sizes], "lang string, rate double")
    key = F.coalesce(F.col("doc_id").cast("string"), "text")
    u = F.pmod(F.xxhash64(key, F.lit("sample")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    # at most MAX_LANGS rows are broadcast
    picked = rows.withColumn("u", u).join(F.broadcast(rates), "lang").where("u < rate").select("lang", "text").collect()
    picked.sort(key=lambda r: (r["lang"], xxhash.xxh64_intdigest(r["text"].encode("utf-8", "surrogatepass")), r["text"]))
    counted, kept = picked[::2], picked[1::2]

    def by(part) -> dict[str, Counter]:
        texts: dict[str, list[str]] = {}
        for r in part:
            texts.setdefault(r["lang"], []).append(r["text"])
        return {lang: c for lang, ts in texts.items() if (c := _counts(ts))}

    half = Identifier(by(counted))
    half.calibrate([r["text"] for r in kept], [r["lang"] for r in kept], z)
    out = Identifier(by(picked))
    out.limits |= half.limits
    return out


def _columns(model: Identifier, spark) -> Column:
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("lang string, score double, rejected boolean")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            lang, score, rejected = shared.value.predict(texts.where(texts.notna(), None).tolist())
            yield pd.DataFrame({"lang": lang, "score": score, "rejected": rejected})

    return predict("text")


def held_out() -> Column:
    """Documents that are never learned from: crc32 of doc_id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected of each row of docs; learned from its rows that aren't held out."""
    model = learn(docs.where(~held_out()), sample)
    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), "text")
    out = out.select("doc_id", "held_out", _columns(model, docs.sparkSession).alias("p"))
    return out.select("doc_id", "held_out", F.col("p.lang").alias("lang_pred"), F.col("p.score").alias("score"), F.col("p.rejected").alias("rejected"))


def accepted(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The rows of docs that aren't rejected, with the columns they had."""
    model = learn(docs.where(~held_out()), sample)
    return docs.where(~_columns(model, docs.sparkSession)["rejected"])
