"""Questions to the content tables: search, paging, coverage, confirmation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folio.functions import text as T
from folio.operators.ordered import blocks_of


def search(rows: DataFrame, query: str, text: str, order: str, limit: int = 10, heading: Column | None = None) -> DataFrame:
    """The `limit` rows with most of the query's terms, ties in order. Score: share of terms, and 0.25 for a heading.
    A limit of the rows of each partition comes first, so one task sees few."""
    terms = sorted(set(query.lower().split()))
    low = F.lower(F.col(text))
    hits = sum((low.contains(t).cast("int") for t in terms), F.lit(0))
    score = hits / F.lit(float(max(1, len(terms))))
    if heading is not None:
        score = score + F.when(heading, 0.25).otherwise(0.0)
    found = rows.withColumn("score", score).where(hits > 0)
    return found.orderBy(F.desc("score"), order).limit(min(limit, 50))


def first_page(rows: DataFrame, key: str, order: str, text: str, budget: int = 24_000) -> DataFrame:
    """The rows of each key that fit in the budget of bytes, one at least, and next_cursor: the first that doesn't."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("__b", F.sum(F.octet_length(text)).over(w)).withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(order)))
    fits = (F.col("__b") <= budget) | (F.col("__n") == 1)
    cursor = F.min(F.when(~fits, F.col(order))).over(Window.partitionBy(key))
    return rows.withColumn("next_cursor", cursor).where(fits).drop("__b", "__n")


def confirmed(candidates: DataFrame, corpus: DataFrame, text: str, body: str) -> DataFrame:
    """candidates with confirmed: whether a text of the corpus holds them, folded; under 12 bytes nothing is confirmed.

    A candidate's anchor is its longest inner word: a text that holds the candidate has the anchor as a word. Words of the texts
    meet anchors in a hash join, and only pairs that share one are compared. Candidates without an inner word take their first
    three characters and the texts' windows of three; that pass is made only if there are any."""
    few = candidates.select(T.normal_form(text).alias("__f")).distinct().where(F.octet_length("__f") >= 12)
    words = F.split("__f", " ")
    inner = F.transform(F.slice(words, 2, F.greatest(F.size(words) - 2, F.lit(0))), lambda w: F.struct((-F.length(w)).alias("n"), w.alias("w")))
    few = few.withColumn("__a", F.array_min(inner)["w"])
    texts = corpus.select(T.normal_form(body).alias("__b"))

    def held(few: DataFrame, keys: Column) -> DataFrame:
        said = texts.select("__b", F.explode(F.array_distinct(keys)).alias("__a")).join(few, "__a")
        return said.where(F.col("__b").contains(F.col("__f"))).select("__f").distinct()

    found = held(few.where("__a IS NOT NULL"), F.split("__b", " "))
    short = few.where("__a IS NULL").withColumn("__a", F.substring("__f", 1, 3))
    if not short.isEmpty():
        found = found.unionByName(held(short, F.transform(F.sequence(F.lit(1), F.greatest(F.length("__b") - 2, F.lit(1))), lambda i: F.substr("__b", i, F.lit(3))))).distinct()
    found = found.withColumn("__hit", F.lit(True))
    return candidates.withColumn("__f", T.normal_form(text)).join(found, "__f", "left").withColumn("confirmed", F.coalesce("__hit", F.lit(False))).drop("__f", "__hit")


def stability(a: DataFrame, b: DataFrame, text: str) -> DataFrame:
    """Shared and own distinct texts of two runs and their Jaccard index."""
    a, b = a.select(F.col(text).alias("x")).distinct().withColumn("a", F.lit(1)), b.select(F.col(text).alias("x")).distinct().withColumn("b", F.lit(1))
    out = a.join(b, "x", "full_outer").agg(F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("shared"), F.count_if(F.col("b").isNull()).alias("only_a"), F.count_if(F.col("a").isNull()).alias("only_b"))
    n = F.col("shared") + F.col("only_a") + F.col("only_b")
    return out.withColumn("jaccard", F.when(n == 0, F.lit(1.0)).otherwise(F.col("shared") / n))


def failure_groups(rows: DataFrame, message: str, order: str) -> DataFrame:
    """Messages alike but for their numbers: count and the first of each."""
    key = F.regexp_replace(message, r"\d[\d.,]*", "N")
    return rows.groupBy(key.alias("reason_key")).agg(F.count("*").alias("n"), F.min_by(message, order).alias("example"))


def robots_decision(paths: DataFrame, rules: DataFrame, path: str) -> DataFrame:
    """paths with allowed: the longest matching rule wins, allow on ties, no rule allows. rules: rule, regex, allow; they
    are a literal few and are tried as one array a row."""
    held = rules.agg(F.collect_list(F.struct(F.length("rule").alias("n"), F.col("allow").alias("allow"), F.col("regex").alias("regex"))).alias("__r"))
    out = paths.crossJoin(F.broadcast(held))
    best = F.array_max(F.transform(F.filter("__r", lambda r: F.regexp_like(F.col(path), r["regex"])), lambda r: F.struct(r["n"], r["allow"])))
    return out.withColumn("allowed", F.coalesce(best["allow"], F.lit(True))).drop("__r")


def rate_slots(requests: DataFrame, host: str, at: str, order: str, delay: float) -> DataFrame:
    """requests (at in seconds) with start: the earliest time that keeps `delay` seconds between a host's requests."""
    w = Window.partitionBy(host).orderBy(at, order)
    i = F.row_number().over(w) - 1
    rows = requests.withColumn("__i", i)
    lead = F.max(F.col(at) - F.col("__i") * F.lit(delay)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("start", F.col("__i") * F.lit(delay) + lead).drop("__i")


def rank_agreement(rows: DataFrame, key: str, a: str, b: str) -> DataFrame:
    """For each key, the pairs at eight offsets of order a and those of them whose order in b agrees. a numbers a key's rows from 1
    without gaps; they are compared block by block."""
    steps = (1, 2, 3, 5, 8, 13, 21, 34)
    w = Window.partitionBy(key, "__b").orderBy(a)
    rows = blocks_of(rows.select(key, a, b), a, after=max(steps))
    rows = rows.select(key, b, "__own", *[F.lead(b, k).over(w).alias(f"__{k}") for k in steps]).where("__own")
    rows = rows.select(key, F.explode(F.array(*[(F.col(f"__{k}") > F.col(b)).cast("int") for k in steps])).alias("agree")).where("agree IS NOT NULL")
    return rows.groupBy(key).agg(F.count("*").alias("pairs"), F.sum("agree").alias("agreeing"))


def ttl(checks: DataFrame, key: str, order: list[str], changed: str, floor: int = 300, ceiling: int = 86_400) -> DataFrame:
    """checks with ttl seconds: doubled on each unchanged one, back to the floor on a change; from cold the floor first."""
    w = Window.partitionBy(key).orderBy(*order)
    rows = checks.withColumn("__e", F.sum(F.col(changed).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    since = F.row_number().over(Window.partitionBy(key, "__e").orderBy(*order)) - F.when(F.col("__e") >= 0, 1)
    n = F.least(since, F.lit(20))
    return rows.withColumn("ttl", F.least(F.lit(float(floor)) * F.pow(F.lit(2.0), n), F.lit(float(ceiling))).cast("long")).drop("__e")


def stable(rows: DataFrame, key: str, order: str, new: str, k: int = 3) -> DataFrame:
    """rows with stable: the last k, this one included, added nothing."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(1 - k, 0)
    return rows.withColumn("stable", (F.max(new).over(w) == 0) & (F.count("*").over(w) == k))


def crawl(edges: DataFrame, roots: DataFrame, depth: int = 2) -> DataFrame:
    """url, depth of what links reach from the roots in so many steps, each at its least depth. edges: src, dst."""
    from folio.sources.store import written

    seen = roots.select("url").distinct().withColumn("depth", F.lit(0))
    front = seen
    for d in range(1, depth + 1):
        new = front.join(edges, front["url"] == edges["src"]).select(F.col("dst").alias("url")).distinct()
        front = written(new.join(seen, "url", "left_anti").withColumn("depth", F.lit(d)), "crawl")
        seen = seen.unionByName(front)
    return seen


def samples(a: DataFrame, b: DataFrame, text: str, most: int = 10, width: int = 80) -> DataFrame:
    """side, sample: the first `most` texts, in order, that only one of two runs has, cut to `width` characters."""
    own = lambda x, y, side: x.select(F.col(text).alias("sample")).distinct().join(y.select(F.col(text).alias("sample")).distinct(), "sample", "left_anti").orderBy("sample").limit(most).select(F.lit(side).alias("side"), T.truncate("sample", width).alias("sample"))
    return own(a, b, "a").unionByName(own(b, a, "b"))


def by_ids(blocks: DataFrame, wanted: DataFrame, *key: str) -> DataFrame:
    """The blocks whose key is wanted; speculative ones are left out."""
    rows = blocks.join(wanted.select(*key).distinct(), list(key), "left_semi")
    return rows.where("verified IS NULL OR verified != 'speculative'") if "verified" in blocks.columns else rows


def section_blocks(blocks: DataFrame, wanted: DataFrame) -> DataFrame:
    """The blocks of the sections (page_id, section) that are wanted."""
    return by_ids(blocks, wanted, "page_id", "section")


def content_pages(rows: DataFrame, key: str, order: str, text: str, budget: int = 24_000) -> DataFrame:
    """rows with page, from 0: in order, a page takes rows while their bytes fit the budget, one at least. A key's sizes are one array,
    folded once."""
    sized = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.octet_length(text).alias("n")))).alias("s"))
    start = F.struct(F.lit(0).alias("page"), F.lit(0).alias("used"), F.array().cast("array<int>").alias("out"))

    def step(acc, x):
        over = (acc["used"] > 0) & (acc["used"] + x["n"] > budget)
        page = F.when(over, acc["page"] + 1).otherwise(acc["page"])
        return F.struct(page.alias("page"), F.when(over, x["n"]).otherwise(acc["used"] + x["n"]).alias("used"), F.concat(acc["out"], F.array(page)).alias("out"))

    pages = F.aggregate("s", start, step)["out"]
    placed = sized.select(key, F.explode(F.arrays_zip(F.transform("s", lambda x: x["o"]).alias("o"), pages.alias("page"))).alias("x")).select(key, F.col("x.o").alias(order), F.col("x.page").alias("page"))
    return rows.join(placed, [key, order])


def snippets(rows: DataFrame, term: str, text: str, width: int = 160) -> DataFrame:
    """rows that hold the term, with snippet: `width` characters round its first place."""
    at = F.instr(F.lower(text), F.lit(term.lower())) - 1
    return rows.where(at >= 0).withColumn("snippet", T.snippet(F.col(text), at, width))


def site_links(links: DataFrame, root: Column, include: str = "") -> DataFrame:
    """page_id, url, chrome of links (page_id, href, region) of the same host, http, without a query, whose path holds `include`; each as
    a crawl counts it."""
    from folio.functions import urls as U

    href = F.col("href")
    rows = links.where((U.host(href) == U.host(root)) & href.rlike("^(?i)https?://") & (U.query(href) == ""))
    if include:
        rows = rows.where(U.path_part(U.path(href)).contains(include.strip("/").lower()))
    return rows.select("page_id", U.crawl_url(href).alias("url"), F.col("region").isin("nav", "header", "footer").alias("chrome")).distinct()


def evicted(jobs: DataFrame, started: str, order: str, most: int = 64) -> DataFrame:
    """The jobs that stay: those started last. A limit of each partition's rows comes first."""
    return jobs.orderBy(F.desc(started), F.desc(order)).limit(most)


def alive(state: DataFrame, key: str, at: str, now: Column, ttl: int) -> DataFrame:
    """The latest row of each key that isn't older than ttl seconds and is ready."""
    rows = state.groupBy(key).agg(F.max_by(F.struct(*[c for c in state.columns if c != key]), F.col(at)).alias("r")).select(key, "r.*")
    return rows.where((F.unix_timestamp(now) - F.unix_timestamp(at) <= ttl) & F.col("ready"))


def merged_memory(old: DataFrame, new: DataFrame, host: str = "host", rank: str = "rank") -> DataFrame:
    """A tier memory and a run's, as one: the higher rank of each host."""
    return old.select(host, rank).unionByName(new.select(host, rank)).groupBy(host).agg(F.max(rank).alias(rank))


def inlined(rows: DataFrame, key: str, order: str, text: str, most: int = 1500) -> DataFrame:
    """key, tokens, body: the texts of a key in order, where they are so few tokens that a manifest may carry them."""
    out = rows.groupBy(key).agg(F.sum(T.tokens(text)).alias("tokens"), F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("t")))).alias("s"))
    return out.select(key, "tokens", F.when(F.col("tokens") <= most, F.array_join(F.transform("s", lambda x: x["t"]), "\n\n")).alias("body"))
