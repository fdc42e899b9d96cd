"""Each operator against a plain version, an exact round trip or held-out accuracy; and its edge cases."""

import base64
import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from folio.llm import audio, bpe, decontaminate, language_id, line_dedup, ngram_join, pii, sharding, suffix_dedup, token_counts
from folio.llm._words import grams, word_hashes

SF = "/root/testdata/sf0.001"
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, shard int, size string, t string, id string, gone string, __gone string, away string, __away string, d string, __d string, __t string, u string, w string, item string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text for r in docs.collect()}


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, ties, repeated rows, and columns whose names operators use inside."""
    long = " ".join(f"w{k % 997}" for k in range(60_000))
    rows = [(1, None), (2, ""), (None, "some words that stand here alone"), (3, "a"), (4, "\n\n \n"), (5, long), (6, long), (7, "same text here"), (7, "same text here"), (8, "same text here"), (None, None), (9, "x" * 50_000), (10, "1" * 30_000 + "@"), (11, "漢字 ​😀 é\n")]
    return spark.createDataFrame([(i, t, None, None, None, 1, *"sti", *"abcdefghij") for i, t in rows], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def operators(spark):
    bench = spark.createDataFrame([(1, "what is the sum of 12 apples and 7 pears on the table today"), (2, None), (None, "x")], "item_id long, text string")
    return {
        "language_id": language_id.identify, "sharding": sharding.shard, "line_dedup": line_dedup.digests, "keep_bitmaps": line_dedup.keep_bitmaps, "suffix_dedup": suffix_dedup.repeats,
        "decontaminate": lambda d: decontaminate.leaks(d, bench), "audio": audio.digests, "ngram_join": ngram_join.join, "token_counts": lambda d: token_counts.token_counts(d, RANKS, public_tokenizers.PATTERN),
        "pii": lambda d: pii.find(d, pii.Field()), "bpe": lambda d: bpe.digests(d, RANKS, public_tokenizers.PATTERN),
    }


def by_id(rows, *columns):
    return sorted(((r.doc_id, *(r[c] for c in columns)) for r in rows), key=repr)


sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
LONG = " ".join(f"w{k % 997}" for k in range(60_000))


def test_edge_language_id(spark, odd, empty):
    out = language_id.identify(odd).collect()
    assert len(out) == 14 and all(r.lang_pred == "und" and r.score == 0 and r.rejected for r in out)
    assert language_id.identify(empty).collect() == [] and language_id.accepted(odd).collect() == []
    known = odd.select("doc_id", "text", F.lit("xx").alias("lang"))
    out = {(r.doc_id, r.lang_pred) for r in language_id.identify(known).collect()}
    assert out == {(1, "und"), (2, "und"), (4, "und"), (10, "und"), (None, "und"), (None, "xx"), *((i, "xx") for i in (3, 5, 6, 7, 8, 9, 11))}


def test_edge_sharding(odd, empty):
    out = sharding.shard(odd).collect()
    texts = [(1, None), (2, ""), (None, "some words that stand here alone"), (3, "a"), (4, "\n\n \n"), (5, LONG), (6, LONG), (7, "same text here"), (7, "same text here"), (8, "same text here"), (None, None), (9, "x" * 50_000), (10, "1" * 30_000 + "@"), (11, "漢字 ​😀 é\n")]
    import zlib

    assert by_id(out, "size", "text_crc32") == sorted(((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in texts), key=repr)
    assert Counter(r.shard for r in out).most_common(1)[0][1] == 1 and {r.slot for r in out} == {0}
    assert sharding.shard(empty).collect() == []


def test_edge_line_dedup(odd, empty):
    texts = {1: "", 2: "", 3: "a", 4: "\n\n \n", 5: LONG, 6: LONG, 7: "same text here", 8: "same text here", 9: "x" * 50_000, 10: "1" * 30_000 + "@", 11: "漢字 ​😀 é\n"}
    gone = {5, 6, 7, 8}
    out = [r for r in line_dedup.digests(odd, 2).collect() if r.doc_id is not None]
    want = [(i, t.count("\n") + 1, int(i in gone), sha("" if i in gone else t)) for i, t in [*texts.items(), (7, texts[7])]]
    assert by_id(out, "n_lines", "n_dropped", "kept_sha256") == sorted(want, key=repr)
    assert [r for r in line_dedup.digests(odd, 2).collect() if r.doc_id is None and r.n_dropped] == []
    kept = line_dedup.deduped(odd, 2)
    assert kept.columns == odd.columns and by_id(kept.drop("text").collect(), *odd.columns[5:]) == by_id(odd.drop("text").collect(), *odd.columns[5:])
    assert all(r.n_chars == len(r.text) for r in kept.where("text IS NOT NULL").collect())
    assert line_dedup.digests(empty).collect() == [] and line_dedup.keep_bitmaps(empty).collect() == [] and line_dedup.keep_bitmaps(odd).count() == 14


def test_edge_suffix_dedup(odd, empty):
    out = {r.doc_id: ([(s.start, s.end) for s in r.spans], r.n_words, r.partners) for r in suffix_dedup.repeats(odd).collect()}
    assert out == {5: ([(0, 60_000)], 60_000, [6]), 6: ([(0, 60_000)], 60_000, [5])}
    assert suffix_dedup.repeats(empty).collect() == []


def test_edge_decontamination(spark, odd, empty):
    item = "same text here"
    bench = spark.createDataFrame([(1, item), (1, "no other text that holds"), (1, None), (None, item), (2, ""), (3, "a")], "item_id long, text string")
    out = {(r.doc_id, r.item_id, r.kind, r.n_windows, r.coverage) for r in decontaminate.leaks(odd, bench).collect()}
    assert {x[:2] for x in out} == {(7, 1), (7, None), (8, 1), (8, None), (3, 3)}
    assert {x[2:] for x in out} == {("verbatim", 1, 1.0)}
    left = decontaminate.clean(odd, bench)
    assert left.columns == odd.columns and {r.doc_id for r in left.collect()} == {1, 2, None, 4, 5, 6, 9, 10, 11}
    none = bench.limit(0)
    assert decontaminate.leaks(empty, bench).collect() == [] and decontaminate.leaks(odd, none).collect() == [] and decontaminate.clean(odd, none).count() == 14


def test_decontamination_of_repeated_ids(spark):
    one, two = "the first item says that there are many sheep on the green hill today", "the second item asks how far the old ship went before the storm came"
    bench = spark.createDataFrame([(1, one), (1, two), (1, two), (None, one)], "item_id long, text string")
    rows = spark.createDataFrame([(1, f"x {one} y"), (2, f"x {two} y"), (3, "nothing at all of that"), (3, f"and {two}")], "doc_id long, text string")
    assert {(r.doc_id, r.item_id, r.kind) for r in decontaminate.leaks(rows, bench).collect()} == {(1, 1, "verbatim"), (1, None, "verbatim"), (2, 1, "verbatim"), (3, 1, "verbatim")}


def test_edge_audio(odd, empty):
    out = audio.digests(odd).collect()
    by = {r.doc_id: r for r in out}
    assert len(out) == 14 and (by[1].n_bytes, by[1].payload_bytes, by[1].media_bytes) == (0, 64, 108) and by[1][1:] == by[2][1:] and by[5][1:] == by[6][1:]
    assert by[9].payload_sha256 == hashlib.sha256(b"x" * 50_000 + b"\0" * 48).hexdigest()
    assert audio.digests(empty).collect() == []


def test_edge_ngram_join(odd, empty):
    out = by_id(ngram_join.join(odd).collect(), "class_id", "set_id", "n_links")
    want = [(None, None, None, 0), (None, None, None, 0), *((i, i, i, 0) for i in (1, 2, 3, 4, 9, 10, 11)), (5, 5, 5, 1), (6, 5, 5, 1), (7, 7, 7, 2), (7, 7, 7, 2), (8, 7, 7, 2)]
    assert out == sorted(want, key=repr)
    left = ngram_join.one_of_each(odd)
    assert left.columns == odd.columns and Counter(r.doc_id for r in left.collect()) == Counter([None, None, 1, 2, 3, 4, 5, 7, 7, 9, 10, 11])
    assert ngram_join.join(empty).collect() == []


def test_edge_tokens(odd, empty):
    import tiktoken

    plain = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}, special_tokens={})
    want = sorted(((r.doc_id, len(i), sha(",".join(map(str, i))), sha(r.text or "")) for r in odd.collect() for i in [plain.encode_ordinary(r.text or "")]), key=repr)
    assert by_id(bpe.digests(odd, RANKS, public_tokenizers.PATTERN).collect(), "n_tokens", "ids_sha256", "decoded_sha256") == want
    out = token_counts.token_counts(odd, RANKS, public_tokenizers.PATTERN).collect()
    by = {r.doc_id: (r.n_pretokens, r.n_tokens) for r in out if r.doc_id is not None}
    assert len(out) == 14 and by[1] == by[2] == (0, 0) and by[3] == (1, 1) and by[5] == by[6] and by[7] == by[8] and by[7][0] == 3
    assert bpe.digests(empty, RANKS, public_tokenizers.PATTERN).collect() == [] and token_counts.token_counts(empty, RANKS, public_tokenizers.PATTERN).collect() == []


def test_edge_pii(odd, empty):
    out = pii.find(odd, pii.Field()).collect()
    assert len(out) == 14 and all((r.n_email, r.n_ip, r.n_card, r.n_phone, r.spans, r.n_spans, r.base_sha256) == (0, 0, 0, 0, "", 0, sha("")) for r in out)
    assert pii.find(empty, pii.Field()).collect() == []


def test_language_caps_nothing(spark):
    """The 600th language is learned as the first one is."""
    words = lambda k: " ".join(f"{chr(0x4E00 + 30 * k + j % 20)}{chr(0x4E00 + 30 * k + j * 7 % 20)}" for j in range(40))
    rows = [(10 * k + j, words(k), f"l{k:03d}") for k in range(600) for j in range(2 if k else 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    out = language_id.identify(docs).collect()
    learned = {f"l{r.doc_id // 10:03d}" for r in docs.where(~language_id.held_out()).collect()}
    assert len(learned) > 520 and all(r.lang_pred == f"l{r.doc_id // 10:03d}" for r in out if f"l{r.doc_id // 10:03d}" in learned)


def test_language_model_equals_plain_kneser_ney():
    rng = random.Random(2)
    counts = Counter("".join(rng.choice("abcd") for _ in range(rng.randint(1, 7))) for _ in range(300))
    top = language_id.ORDER
    bounded = {f"{language_id.START}{w}{language_id.END}": n for w, n in counts.items()}
    floor = 1 / (4 * len(set("".join(bounded))))
    tables = []
    for k in range(top):  # grams of k + 1 characters
        seen = Counter()
        for w, n in bounded.items():
            for i in range(max(1, k), len(w)):
                seen[w[max(0, i - k - 1) : i + 1] if k + 1 < top else w[i - k : i + 1]] += n
        c, context, kinds = Counter(), Counter(), Counter()
        for g, n in seen.items():
            c[g[-k - 1 :]] += 1 if k + 1 < top else n
        for g, n in c.items():
            context[g[:-1]] += n
            kinds[g[:-1]] += 1
        once, twice = (sum(n == m for n in c.values()) for m in (1, 2))
        d = once / (once + 2 * twice) if once and twice else 0.5
        tables.append((c, context, kinds, d))

    def p(before, x, k):
        if k < 0:
            return floor
        c, context, kinds, d = tables[k]
        h = before[len(before) - k :]
        if not context[h]:
            return p(before, x, k - 1)
        return max(c[h + x] - d, 0) / context[h] + d * kinds[h] / context[h] * p(before, x, k - 1)

    model = language_id.Identifier({"x": counts})
    words = [*list(counts)[:40], "abcdabcd", "zzz", "dczab", "a"]
    for w, got in zip(words, model.words(words)[:, 0]):
        b = f"{language_id.START}{w}{language_id.END}"
        want = sum(np.log(p(b[:i], b[i], min(i, top - 1))) for i in range(1, len(b)))
        assert abs(got - want) < 1e-3 * len(b), w


def test_language_held_out(docs):
    lang = {r.doc_id: r.lang for r in docs.collect()}
    out = [r for r in language_id.identify(docs).collect() if r.held_out]
    assert out and sum(r.lang_pred == lang[r.doc_id] for r in out) / len(out) > 0.97
    assert not any(r.rejected for r in out) and all(0 <= r.score <= 1 for r in out)


def test_language_probabilities_sum_to_at_most_one():
    m = language_id.Identifier({"x": Counter({"abab": 3, "ba": 2, "abba": 1})})
    codes, starts = language_id._codes(["a" + c for c in "ab"] + ["a"])
    hashes, depth = language_id._ngram_hashes(codes, starts)
    p = np.exp(m.models[0].score(hashes, depth))
    # after the bound and "a": a, b or the end
    assert 0.9 < p[2] + p[6] + p[10] <= 1.0001


def test_language_rejects_other_scripts(spark, docs):
    more = docs.select("doc_id", "text", "lang").unionByName(spark.createDataFrame([(10**9 + 1, "это совсем другой язык " * 20, None), (10**9 + 2, "12 34", None)], "doc_id long, text string, lang string"))
    out = {r.doc_id: r for r in language_id.identify(more).where("doc_id > 999999999").collect()}
    assert out[10**9 + 1].rejected and out[10**9 + 2].lang_pred == "und"
    assert language_id.accepted(more).count() == docs.count()


def test_sharding_rows(docs, texts):
    out = sharding.shard(docs).collect()
    by = defaultdict(list)
    for r in out:
        by[r.shard].append(r.slot)
        raw = texts[r.doc_id].encode()
        assert r.size == len(raw) + 8 and r.law == "rows" and r.grown_shard is None
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    sizes = [len(by[s]) for s in range(24)]
    assert max(sizes) - min(sizes) <= 1
    of = defaultdict(set)
    for r in out:
        of[texts[r.doc_id]].add(r.shard)
    copies = Counter(texts.values())
    assert all(len(of[t]) == 1 for t, n in copies.items() if 1 < n <= 4)


def test_sharding_of_a_hot_text(spark):
    rows = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("text"))
    out = sharding.shard(rows).collect()
    assert set(Counter(r.shard for r in out).values()) == {125}
    assert len({r.shard for r in out if r.doc_id % 3 == 0}) < 24


@pytest.mark.parametrize("size,share", [(2, 1.0), (4, 0.95), (10, 0.9), (10, 1.0), (50, 0.75), (50, 1.0)])
def test_sharding_cuts_no_group_that_fits(spark, size, share):
    n = 2400
    linked = int(n * share) // size * size
    text = F.when(F.col("id") < linked, F.concat(F.lit("g"), F.floor(F.col("id") / size))).otherwise(F.col("id").cast("string"))
    out = sharding.shard(spark.range(n).select(F.col("id").alias("doc_id"), text.alias("text"))).collect()
    of, slots = defaultdict(set), defaultdict(list)
    for r in out:
        slots[r.shard].append(r.slot)
        if r.doc_id < linked:
            of[r.doc_id // size].add(r.shard)
    assert all(sorted(v) == list(range(100)) for v in slots.values())
    assert sum(len(v) > 1 for v in of.values()) == 0


def test_sharding_plan():
    moves = sharding.plan({0: 30, 1: 4, 2: 8}, [14, 14, 14], {(0, 6): 1, (0, 5): 2, (0, 2): 7})
    to = Counter()
    for (_, size), dests in moves.items():
        for t, n in dests:
            to[t] += size * n
    assert to == {1: 10, 2: 6}


def lines_plain(texts, least):
    key = lambda x: re.sub(r"^[ \t-\r]+|[ \t-\r]+$", "", x).translate({c: c + 32 for c in range(65, 91)})
    seen = defaultdict(set)
    for d, t in texts.items():
        for x in t.split("\n"):
            seen[key(x)].add(d)
    out = {}
    for d, t in texts.items():
        kept = [x for x in t.split("\n") if not (key(x) and len(seen[key(x)]) >= least)]
        out[d] = (t.count("\n") + 1, t.count("\n") + 1 - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest())
    return out


@pytest.mark.parametrize("least", [2, 10])
def test_line_dedup(docs, texts, least):
    out = line_dedup.digests(docs, least).collect()
    assert {r.doc_id: (r.n_lines, r.n_dropped, r.kept_sha256) for r in out} == lines_plain(texts, least)
    maps = {r.doc_id: r.keep_bitmap for r in line_dedup.keep_bitmaps(docs, least).collect()}
    new = {r.doc_id: r.text for r in line_dedup.deduped(docs, least).collect()}
    assert all(line_dedup.apply_bitmap(texts[d], maps[d]) == new[d] for d in texts)


def test_line_dedup_hot_lines_over_many_partitions(spark):
    rows = spark.range(4000).select(F.col("id").alias("doc_id"), F.concat(F.lit("Hot line\n"), F.col("id").cast("string"), F.lit("\n hot LINE ")).alias("text"))
    out = line_dedup.digests(rows).collect()
    assert all(r.n_lines == 3 and r.n_dropped == 2 for r in out)


def test_suffix_dedup_before_a_hot_passage(spark):
    rng = random.Random(4)
    own = lambda k: [f"v{rng.randrange(10**9)}" for _ in range(k)]
    hot = own(47)
    texts = [own(20) + hot + own(20) for _ in range(600)]
    for a in range(0, 80, 2):
        both = own(5 if a < 40 else 12)
        texts[a], texts[a + 1] = (own(10) + both + hot + own(20) for _ in range(2))
    rows = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: ([(s.start, s.end) for s in r.spans], r.partners) for r in suffix_dedup.repeats(rows).collect()}
    assert got == {a: ([(10, 62 if a < 40 else 69)], [a ^ 1]) for a in range(80)}


def test_suffix_dedup(docs, texts):
    n = 50
    h = {d: word_hashes(t) for d, t in texts.items()}
    where = defaultdict(set)
    for d, x in h.items():
        for g in grams(x, n).tolist() if len(x) >= n else ():
            where[g].add(d)
    want = {}
    for d, x in h.items():
        words = {w for i, g in enumerate(grams(x, n).tolist() if len(x) >= n else ()) if len(where[g]) > 1 for w in range(i, i + n)}
        if words:
            want[d] = words
    got = {r.doc_id: {w for s in r.spans for w in range(s.start, s.end)} for r in suffix_dedup.repeats(docs).collect()}
    assert got == want


def test_decontamination(spark, docs, texts):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    items = {r.item_id: r.text for r in bench.collect()}
    out = {(r.doc_id, r.item_id) for r in decontaminate.leaks(docs, bench).collect()}
    assert out >= {(d, i) for i, x in items.items() for d, t in texts.items() if x in t}
    assert all(any(items[i][k : k + 40] in texts[d] for k in range(0, max(1, len(items[i]) - 40), 5)) for d, i in out)


def test_decontamination_of_new_parameters(spark):
    item = "If Anna buys 12 apples for 3 euros each and sells 5 of them to her friend Bruno, how many euros does Anna have left at the end of the day?"
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    changed = item.replace("Anna", "Clara").replace("12", "40").replace("3 euros", "9 euros").replace("Bruno", "David")
    mixed = changed.replace("does Clara", "does David")
    rows = spark.createDataFrame([(1, "Some words before. " + item), (2, changed + " And after."), (3, "Nothing of the kind stands here at all, only other words in a row."), (4, mixed)], "doc_id long, text string")
    out = {r.doc_id: r for r in decontaminate.leaks(rows, bench).collect()}
    assert out[1].kind == "verbatim" and out[2].kind == "reparameterised" and 3 not in out
    assert 4 not in out or out[4].n_windows < out[2].n_windows


def hits_of(item, text):
    """Words of item, and its windows that text has too, as decontaminate.judge takes them."""
    import pyarrow as pa

    rows = next(decontaminate._of_items(iter([pa.RecordBatch.from_pydict({"i": pa.array([1], pa.int64()), "t": [item], "h": pa.array([1], pa.int64())})]))).to_pylist()

    class bits:
        value = np.full(1 << decontaminate.BITS - 6, 2**64 - 1, np.uint64)

    found = next(decontaminate._of_docs(bits, [rows[0]["size"]])(iter([pa.RecordBatch.from_pydict({"i": pa.array([1], pa.int64()), "t": [text], "h": pa.array([1], pa.int64())})]))).to_pylist()
    return rows[0]["words"], [{**r, **x} for r in rows for x in found if r["w"] == x["w"]]


def test_decontamination_behind_a_table_of_numbers():
    item = " ".join(str(7 * k + 1000) for k in range(20))
    table = " ".join(str(k) for k in range(40, 140))
    assert decontaminate.judge(*hits_of(item, f"{table} {item}"))[0] == "verbatim"
    assert decontaminate.judge(*hits_of(item, f"{table} {table}")) is None
    quote = "the old miller counted every sack of grain that stood in his barn"
    item = f"{' '.join(map(str, range(1, 31)))} then {quote} before winter came along the river"
    assert decontaminate.judge(*hits_of(item, f"{table} and {quote} so it went"))[0] == "verbatim"


def test_decontamination_of_names_that_open_sentences():
    item = "Natalia sold 48 clips to her friends in April. Natalia then sold half as many clips in May. Natalia paid 5 dollars for lunch. How many clips did Natalia sell altogether in April and May?"
    changed = item.replace("Natalia", "Marie").replace("48", "72")
    assert decontaminate.judge(*hits_of(item, "Some words before. " + changed))[0] == "reparameterised"
    item = "Anna has 5 apples in her bag. Tom gives Anna 3 more apples from his garden. Anna eats 2 of them on the way home. How many apples does Anna have now?"
    assert decontaminate.judge(*hits_of(item, item.replace("Anna", "Bella").replace("Tom", "Jack")))[0] == "reparameterised"
    assert decontaminate.judge(*hits_of(item, item))[:3:2] == ("verbatim", 1.0)


def test_audio_round_trip(docs, texts):
    for r in audio.digests(docs).collect():
        raw = texts[r.doc_id].encode()
        payload = raw + b"\0" * (-len(raw) % 64 if raw else 64)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest())
        assert r.media_bytes == len(payload) + 44


def test_audio_features():
    import pyarrow as pa

    t = np.arange(8000) / 8000
    x = np.where((t > 0.3) & (t < 0.6), np.sin(2 * np.pi * 440 * t) * 100, 0) + 128
    payload = x.astype(np.uint8).tobytes()
    spans, tensors = audio.features(audio.samples(audio.wav(payload)))
    loud = spans[np.argmax(spans[:, 1] - spans[:, 0])] if len(spans) else None
    assert loud is not None and abs(loud[0] - 0.3) < 0.1 and abs(loud[1] - 0.6) < 0.1
    back = pa.ipc.open_stream(audio.tensor_batch(spans, tensors)).read_all()
    assert np.array_equal(back["tensor"].combine_chunks().to_numpy_ndarray(), tensors)
    assert audio.described(audio.tensor_batch(spans, tensors)).startswith(f"{len(spans)}x4x24:")


@pytest.mark.parametrize("n", [0, 1, 7, 8, 1000, 4001])
def test_audio_resampling_equals_convolution(n):
    rng = np.random.default_rng(n)
    x = rng.standard_normal(n).astype(np.float32)
    up, down = audio.UP, audio.DOWN
    taps = audio._PHASES[:, ::-1].T.reshape(-1)
    wide = np.zeros(n * up)
    wide[::up] = x
    plain = np.convolve(wide, taps)[: n * up : down][: n * up // down] if n else wide
    got = audio.resample(x)
    assert up > 1 and len(got) == n * up // down and np.allclose(got, plain, atol=1e-5)


def test_audio_segments_equal_a_plain_scan():
    rng = np.random.default_rng(3)
    for _ in range(200):
        e = np.round(rng.standard_normal(rng.integers(1, 40)).cumsum(), 2)
        floor, top = np.quantile(e, [0.1, 0.95])
        low, high = floor + audio.LOW * (top - floor), floor + audio.HIGH * (top - floor)
        want, start, loud = [], None, False
        for i, v in enumerate([*e.tolist(), -np.inf]):
            if v >= low:
                start, loud = (i if start is None else start), bool(loud or v >= high)
            elif start is not None:
                want += [(start, i)] * loud
                start, loud = None, False
        assert audio.segments(e) == want


def test_ngram_join(docs, texts):
    s = {d: set(ngram_join.shingles(t).tolist()) for d, t in texts.items()}
    ids = sorted(s)
    links, root = Counter(), {d: d for d in ids}
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if s[a] and s[b] and len(s[a] & s[b]) / len(s[a] | s[b]) >= 0.8:
                links[a] += 1
                links[b] += 1
                x, y = sorted((root[a], root[b]))
                root = {d: x if r == y else r for d, r in root.items()}
    out = ngram_join.join(docs).collect()
    assert {r.doc_id: (r.class_id, r.n_links) for r in out} == {d: (root[d], links[d]) for d in ids}


def test_ngram_join_splits_large_nodes(spark):
    rng = random.Random(5)
    base = [f"w{k}" for k in range(300)]
    rows = []
    for d in range(400):
        words = list(base)
        for _ in range(rng.randint(0, 6)):
            words[rng.randrange(300)] = f"x{d}_{rng.random()}"
        rows.append((d, " ".join(words)))
    out = ngram_join.join(spark.createDataFrame(rows, "doc_id long, text string"), small=64).collect()
    s = [ngram_join.shingles(t) for _, t in rows]
    plain = lambda a, b: (n := len(np.intersect1d(a, b, True))) / (len(a) + len(b) - n)
    for r in out[::40]:
        assert r.n_links == sum(plain(s[r.doc_id], x) >= 0.8 for k, x in enumerate(s) if k != r.doc_id)


def test_ngram_join_recall_below_large_nodes():
    """Pairs of similarity 0.8 whose nodes of the first two levels are all large meet in a node of the third."""
    import pyarrow as pa

    rng = np.random.default_rng(1)
    n, e = 40_000, ngram_join.EMBED
    a = rng.integers(0, 2**32, (n, e), np.uint32)
    b = np.where(rng.random((n, e)) < 0.8, a, rng.integers(0, 2**32, (n, e), np.uint32))
    roots = ngram_join._roots(0.8, 0.9999)
    place = lambda r: (ngram_join.mix(ngram_join.mix(np.full(1, r, np.uint64)) + ngram_join._PLACE) < ngram_join._rate(0.8)).sum()
    assert all(place(r) for r in roots) and sum(map(place, roots)) >= ngram_join.runs(0.8, 0.9999) * 1.25 / 0.8
    met = np.zeros(n, bool)
    for k in range(0, n, 4000):
        rows = np.concatenate([a[k : k + 4000], b[k : k + 4000]])
        ids, paths = np.arange(8000), None
        for depth in range(ngram_join.DEPTH):
            cols = [pa.array(ids), pa.array([rows[i].tobytes() for i in ids], pa.binary()), *([] if paths is None else [pa.array(paths)])]
            batch = pa.RecordBatch.from_arrays(cols, names=["id", "embed", "path"][: len(cols)])
            out = next(ngram_join._children(0.8, None if depth else roots)(iter([batch])))
            paths, ids = out.column(0).to_numpy(), out.column(1).to_numpy()
        left = {(i, p) for i, p in zip(ids.tolist(), paths.tolist()) if i < 4000}
        met[[k + i - 4000 for i, p in zip(ids.tolist(), paths.tolist()) if (i - 4000, p) in left]] = True
    assert (~met).sum() <= 4


def test_token_counts_equal_plain_viterbi(docs, texts):
    import math

    counter = token_counts.Counter(ranks := bpe.read_ranks(RANKS), public_tokenizers.PATTERN)
    longest = max(map(len, ranks))

    def plain(w):
        best = [(0.0, 0)]
        for d in range(1, len(w) + 1):
            best.append(max((best[s][0] - math.log(ranks[w[s:d]] + 2), best[s][1] - 1) for s in range(max(0, d - longest), d) if w[s:d] in ranks))
        return -best[-1][1]

    some = list(texts.values())[:20]
    for t, n in zip(some, counter.batch(some)[1]):
        assert n == sum(plain(p.encode()) for p in counter.split(t))


def test_pii_base_patterns():
    patterns = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}

    def plain(t):
        for kind, p in patterns.items():
            for m in re.finditer(p, t):
                d = re.sub("[^0-9]", "", m[0])
                if kind == "ip" and any(int(x) > 255 for x in m[0].split(".")) or kind == "card" and not (16 <= len(d) <= 19 and pii.luhn(d)) or kind == "phone" and not 8 <= len(d) <= 15:
                    continue
                yield kind, m.start(), m.end()

    rng = random.Random(3)
    for _ in range(20_000):
        t = "".join(rng.choice("12305..@@+- ab)(-.é") for _ in range(rng.randint(0, 30)))
        assert list(plain(t)) == [(k, *x) for k in pii.BASE for x in pii.base_spans(t)[k]]


def test_pii_field_on_held_out_examples():
    field = pii.learn()
    hit = want = got = 0
    for text, gold in pii.examples(150, 99):
        tokens = pii.tokenise(text)
        found = {(k, tokens[a][1], tokens[b - 1][2]) for k, a, b in field.decode(tokens)}
        hit, want, got = hit + len(found & set(gold)), want + len(gold), got + len(found)
    assert hit / want > 0.85 and hit / got > 0.95
    base, every = pii.spans_of("call (208) 555-1177 or mail jo [at] ex [dot] com", field)
    assert not base and {k for k, _, _ in every} == {"phone", "email"}


def test_pii_field_decodes_the_best_segmentation():
    """Viterbi against all segmentations of short texts."""
    field = pii.learn()
    for text in ["call 208-555-1177 now", "jo at ex dot com", "4929 3483 8514 6306 a", "ip 10.0.0.1, 7", "ssn 123-45-6789", "+1 (974) 555-3436 x", "12 (at) 3 dot de"]:
        tokens = pii.tokenise(text)
        ends = field.scored(field.segments(tokens))
        every = [[(0.0, [])]]
        for here in ends:
            every.append([(t + s, [*found, (k, a, len(every))] if k != "other" else found) for a, k, s, _ in here for t, found in every[a]])
        top = max(x for x, _ in every[-1])
        assert any(abs(x - top) < 1e-9 and found == field.decode(tokens) for x, found in every[-1])


#: Written by hand, not by the generator: what personal data they hold, besides base spans.
WRITTEN = [
    ("You can reach our desk at (312) 555-0142 on weekdays.", ["(312) 555-0142"]), ("Her mail is maria.lopez [at] uni-koeln [dot] de, she says.", ["maria.lopez [at] uni-koeln [dot] de"]),
    ("Write to john at example dot com for details", ["john at example dot com"]), ("SSN: 078-05-1120 (issued 1936)", ["078-05-1120"]), ("IBAN DE89 3704 0044 0532 0130 00, BIC on request", ["DE89 3704 0044 0532 0130 00"]),
    ("api token = 'f33e61083db5dbdf4bd2369d2f80176e57f7fda2'", ["f33e61083db5dbdf4bd2369d2f80176e57f7fda2"]), ("password: a8Kd93jfLs02mQpX71zTgh", ["a8Kd93jfLs02mQpX71zTgh"]), ("fax 020 7946 0958", ["020 7946 0958"]),
    ("commit f33e61083db5dbdf4bd2369d2f80176e57f7fda2 broke it", []), ("The meeting is at 10 dot sharp on 2024-11-05.", []), ("Pages 104-117, vol. 12, 1998, pp. 33.", []), ("It cost 1,250.00 in 1999 and 12,500.75 in 2020", []),
    ("Version 2.14.3 of 12/05/2021 fixes 17 bugs", []), ("Zip 90210-1234 and lot 55-12", []), ("We stayed at home dot after dot on the page", []), ("order 123456789012345678901234 shipped", []),
    ("token count was 4096 in 12 runs", []), ("the hash 11acdfb36bb72224148e6160f674b4be45601bff is public", []),
]


def test_pii_field_on_written_texts():
    field, hit, got, want = pii.learn(), 0, 0, 0
    for text, held in WRITTEN:
        base, every = pii.spans_of(text, field)
        found = {text[a:b] for k, a, b in every if (k, a, b) not in base}
        hit, got, want = hit + len(found & set(held)), got + len(found), want + len(held)
    assert hit / want >= 0.85 and hit / got >= 0.85


def test_pii_no_card_in_a_code():
    field = pii.learn()
    for text in ('of token = "11acdfb36bb72224148e6160f674b4be45601bff" and', "see x4929348385146306y here", "id 4929348385146306abcd"):
        assert not [x for x in pii.spans_of(text, field)[1] if x[0] == "card" and x not in pii.spans_of(text, field)[0]]


def test_pii_in_documents(spark):
    """Every token that is called so is found, and no other code."""
    texts = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    field = pii.learn()
    want = {(d, *m.span(1)) for d, t in texts.items() for m in re.finditer('token = "([0-9a-f]{40})"', t)}
    got = {(d, a, b) for d, t in texts.items() for base, every in [pii.spans_of(t, field)] for k, a, b in every if k == "secret"}
    assert want and got == want


def test_pii_in_long_lists():
    phones = [f"(200) {100 + k // 9000}-{1000 + k % 9000}" for k in range(1000)]
    for sep in (", ", "\n"):
        text = sep.join(phones)
        _, every = pii.spans_of(text, pii.learn())
        assert [text[a:b] for k, a, b in every if k == "phone"] == phones
    text = "5 " + "x" * 42 + " jane.doe [at] example.com"
    assert [t for tokens in pii.regions(text) for t in tokens] == pii.tokenise(text)
    text = "y" * 100 + " z" * 20 + " 12 " + "y" * 300 + " 34"
    assert [tokens[0][1] for tokens in pii.regions(text)] == [0]


def test_pii_spelt_addresses():
    field = pii.learn()
    for text, want in [("please contact john at example dot com", "john at example dot com"), ("mail jane.doe [at] example [dot] com", "jane.doe [at] example [dot] com"), ("mail jane12 (at) example (dot) org, please", "jane12 (at) example (dot) org")]:
        _, every = pii.spans_of(text, field)
        assert [(k, text[a:b]) for k, a, b in every] == [("email", want)]
    assert not list(pii.regions("we met at some point in the year"))
    assert pii.spans_of("we met at some point in the year, at home, on the dot", field) == ([], [])


def test_bpe_equals_tiktoken(texts):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    codec = bpe.Codec(bpe.read_ranks(RANKS), public_tokenizers.PATTERN)
    plain = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(1)
    more = ["".join(rng.choice("abc deß é'stнж 漢字12 \n\t  😀!") for _ in range(rng.randint(0, 60))) for _ in range(500)]
    for t in [*texts.values(), *more, "x" * 5000]:
        ids = plain.encode_ordinary(t)
        assert codec.encode(t) == ids and codec.decode(ids) == t.encode()
        assert codec.both(t) == (",".join(map(str, ids)), t.encode())
    assert all(codec.hash.get(t) == i for t, i in ranks.items()) and codec.hash.get(b"no such token at all") is None
