"""From fragments to blocks, sections and page rows. One partitioning by page serves every window."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folio.functions import text as T
from folio.functions import urls as U

# Parts of a page that are furniture, landmarks, tags of code, the height of a screen.
CHROME = ("nav", "header", "footer")
LANDMARKS = ("nav", "header", "footer", "aside", "form", "dialog")
CODE_TAGS = ("code", "pre", "samp", "kbd")
VIEWPORT = 900.0


def pages_of(page: str = "page_id", *order: str):
    return Window.partitionBy(page).orderBy(*order)


def fragments(extracted: DataFrame) -> DataFrame:
    return extracted.select("page_id", F.inline("fragments"))


def links(extracted: DataFrame) -> DataFrame:
    """href, label and absolute address of each link; the first of each (href, label in lower case), by href."""
    rows = extracted.select("page_id", "url", F.inline("links"))
    rows = rows.withColumn("href", U.absolute(F.col("href"), F.col("url"))).withColumn("internal", U.internal(F.col("href"), F.col("url")))
    first = Window.partitionBy("page_id", "href", F.lower("label")).orderBy("seq")
    return rows.withColumn("__n", F.row_number().over(first)).where("__n = 1").drop("__n")


def region(landmark: Column) -> Column:
    return F.when(landmark.isin(*LANDMARKS), landmark).otherwise("main")


def runs(frags: DataFrame) -> DataFrame:
    """Fragments of one line joined in order while style is the same: text gaps follow the source's padding."""
    w = pages_of("page_id", "seq")
    style = F.struct("size", "weight")
    same = (F.col("line") == F.lag("line").over(w)) & (style == F.lag(style).over(w))
    rows = frags.withColumn("run", F.sum(F.when(same, 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    piece = F.struct("seq", "text", "pad", "href", "tag", "role", "landmark", "path", "block", "line", "size", "weight")
    rows = rows.groupBy("page_id", "run").agg(F.array_sort(F.collect_list(piece)).alias("p"))
    glue = lambda acc, x: F.struct(
        F.concat(acc["text"], F.when(acc["open"] | (x["pad"].bitwiseAND(1) > 0), " ").otherwise(""), x["text"]).alias("text"),
        (x["pad"].bitwiseAND(2) > 0).alias("open"),
    )
    start = F.struct(F.lit("").alias("text"), F.lit(False).alias("open"))
    joined = F.trim(F.aggregate("p", start, glue)["text"])
    first = F.element_at("p", 1)
    href = F.coalesce(F.get(F.filter(F.transform("p", lambda x: x["href"]), lambda h: h != ""), F.lit(0)), F.lit(""))
    return rows.select("page_id", F.col("run").alias("ord"), T.clean(joined).alias("text"), href.alias("href"), *[first[k].alias(k) for k in ("tag", "role", "landmark", "path", "block", "line", "size", "weight")])


def long_once(rows: DataFrame, least: int = 32) -> DataFrame:
    """Of texts of `least` characters or more, the first on each page; shorter ones all stay."""
    n = F.row_number().over(Window.partitionBy("page_id", "text").orderBy("ord"))
    return rows.withColumn("__n", n).where((F.col("__n") == 1) | (F.length("text") < least)).drop("__n")


def path_key(path: Column | str) -> Column:
    """A sort key of element paths: segment by segment, by tag, then by number."""
    part = lambda x: F.struct(F.regexp_replace(x, r"\[.*", "").alias("tag"), F.coalesce(F.regexp_extract(x, r"\[(\d+)\]", 1).try_cast("int"), F.lit(0)).alias("n"))
    return F.transform(F.split(path, "/"), part)


def regions(rows: DataFrame, viewport: float = VIEWPORT) -> DataFrame:
    """rows (page_id, block, landmark, tag, text, href, y, bottom, doc_height, fixed) with region and repeats. A landmark
    says it; else what is pinned and short at an edge, or short and linked near the page's top or end, is chrome; code is not, nor
    is a part of a container that holds body text. A short link that a page has four times or more is navigation."""
    n, named = F.length("text"), F.coalesce(F.col("landmark").isin(*LANDMARKS), F.lit(False))
    brief, linked = n <= 60, (n <= 40) & (F.col("href") != "") & ~F.col("tag").isin(*CODE_TAGS)
    band = F.greatest(F.col("doc_height") - viewport * 0.75, F.col("doc_height") * 0.75)
    placed = (
        F.when(named, F.col("landmark")).when(F.col("fixed") & brief & (F.col("bottom") <= viewport * 0.18), "header").when(F.col("fixed") & brief & (F.col("y") >= viewport * 0.82), "footer")
        .when(linked & (F.col("doc_height") > viewport) & (F.col("bottom") > band), "footer").when(linked & (F.col("y") < viewport * 0.12), "nav").otherwise("main")
    )
    rows = rows.withColumn("region", placed)
    held = F.max((F.col("region") == "main") & (F.col("block") != "")).over(Window.partitionBy("page_id", "block"))
    rows = rows.withColumn("region", F.when(~named & (F.col("block") != "") & held, "main").otherwise(F.col("region")))
    same = F.count("*").over(Window.partitionBy("page_id", F.when(n <= 60, F.lower("text"))))
    rows = rows.withColumn("repeats", F.when((n <= 60) & (same >= 3), same).otherwise(0))
    return rows.withColumn("region", F.when((F.col("region") == "main") & (F.col("href") != "") & (n <= 24) & (F.col("repeats") >= 4), "nav").otherwise(F.col("region")))


def size_steps(sizes: Column) -> Column:
    """Sizes from the largest down, those within 8 % of the step before joined to it, six at most."""
    down = F.reverse(F.array_sort(F.array_distinct(sizes)))
    near = lambda acc, x: (F.size(acc) > 0) & (x > 0) & (F.element_at(acc, -1) / x < F.lit(1.08).cast("double"))
    return F.aggregate(down, F.array().cast("array<double>"), lambda acc, x: F.when((F.size(acc) >= 6) | F.coalesce(near(acc, x), F.lit(False)), acc).otherwise(F.concat(acc, F.array(x))))


def separation(sizes: Column) -> Column:
    """How far apart the sizes of headings are, 0 to 1: the tightest step between sizes over 8 % apart, 1.4 being clear."""
    rungs = F.aggregate(F.array_sort(F.array_distinct(sizes)), F.array().cast("array<double>"), lambda acc, x: F.when((F.size(acc) == 0) | (x / F.element_at(acc, -1) > F.lit(1.08).cast("double")), F.concat(acc, F.array(x))).otherwise(acc))
    ratios = F.transform(F.sequence(F.lit(2), F.size(rungs)), lambda i: F.element_at(rungs, i) / F.element_at(rungs, i - 1))
    worst = F.least(F.array_min(ratios), F.lit(10.0))
    return F.when(F.size(rungs) < 2, F.lit(1.0)).otherwise(F.least(F.greatest((worst - F.lit(1.08).cast("double")) / F.lit(0.32).cast("double"), F.lit(0.0)), F.lit(1.0)))


def like_heading(body: Column) -> Column:
    """Whether a run may head something: it is marked so, or set apart by size or weight and not long."""
    n, size = F.length("text"), F.col("size")
    apart = (size >= body * F.lit(1.15)) | (F.col("weight") >= 600) & (size >= body * F.lit(1.02)) & (n <= 90)
    return (F.col("semantic") > 0) | n.between(1, 180) & apart


def confidence(kind: Column, semantic: Column, page_semantic: Column, repeats: Column, opacity: Column, text: Column) -> Column:
    """How sure a block's reading is: 1 less what speaks against it, 0.1 at least, to two places."""
    less = (
        F.when(opacity < 0.5, 0.25).when(opacity < 0.9, 0.08).otherwise(0.0) + F.when((kind == "heading") & (semantic == 0), F.when(page_semantic, 0.1).otherwise(0.15)).otherwise(0.0)
        + F.when(repeats >= 4, 0.05).otherwise(0.0) + F.when(F.length(text) == 1, 0.3).otherwise(0.0)
    )
    return T.round_to(F.greatest(F.lit(1.0) - less, F.lit(0.1)), 0.01)


def typed(rows: DataFrame) -> DataFrame:
    """rows with type, level, score and confidence: tags and roles first, then size against the page's type scale. Levels are
    numbered without gaps over the headings of the content."""
    tag = F.regexp_extract("path", r"/(h[1-6])(?:\[\d+\])?(?:/|$)", 1)
    rows = rows.withColumn("semantic", F.when(tag != "", F.substring(tag, 2, 1).cast("int")).when(F.col("role") == "heading", 2).otherwise(0))
    content = ~F.col("region").isin(*CHROME)
    # windows by page only, over one partitioning; a page's runs are limited by its source
    w = Window.partitionBy("page_id")
    rows = with_body_size(rows, content)
    rows = rows.withColumn("looks", like_heading(F.col("body")))
    rows = rows.withColumn("steps", size_steps(F.collect_set(F.when(content & F.col("looks"), T.round_to(F.col("size"), 0.5))).over(w))).withColumn("marked", F.max(content & (F.col("semantic") > 0)).over(w))
    rung = F.array_position(F.transform("steps", lambda s: T.round_to(F.col("size"), 0.5) >= s * F.lit(0.96)), True).cast("int")
    level = F.when(F.col("semantic") > 0, F.col("semantic")).when(content & F.col("looks"), F.when(rung > 0, rung).otherwise(F.size("steps") + 1)).otherwise(0)
    within = lambda tags: F.col("path").rlike(rf"/({tags})(\[\d+\])?(/|$)")
    kind = (
        F.when(tag != "", "heading").when(F.col("tag").isin(*CODE_TAGS), "code").when(within("li|dt|dd"), "list_item").when(within("blockquote|q"), "quote").when(within("td|th"), "table_cell")
        .when(F.col("tag").isin("label", "legend", "figcaption", "cite", "caption"), "label").when((level > 0) & ~T.closes_like_prose("text"), "heading").otherwise("paragraph")
    )
    rows = rows.withColumn("type", kind).withColumn("level", F.when(F.col("type") == "heading", level))
    used = F.array_sort(F.collect_set(F.when(content, F.col("level"))).over(w))
    rank = F.array_position(used, F.col("level")).cast("int")
    rows = rows.withColumn("level", F.when(rank > 0, rank).otherwise(F.col("level")))
    rows = rows.withColumn("score", confidence(F.col("type"), F.col("semantic"), F.col("marked"), F.col("repeats"), F.lit(1.0), F.col("text")))
    return rows.withColumn("confidence", T.bucket("score")).drop("body", "looks", "steps", "marked", "semantic")


def body_size(rows: DataFrame, page: str = "page_id", size: str = "size", least: int = 40) -> DataFrame:
    """Weighted median of sizes rounded to 0.5, weighted by characters, over runs of `least` characters if there are any."""
    rows = rows.withColumn("__s", T.round_to(F.col(size), 0.5)).withColumn("__w", F.length("text"))
    has = F.max(F.col("__w") >= least).over(Window.partitionBy(page))
    rows = rows.withColumn("__has", has).where(~F.col("__has") | (F.col("__w") >= least))
    sums = rows.groupBy(page, "__s").agg(F.sum("__w").alias("w"))
    return weighted_median(sums, [page], "__s", "w").withColumnRenamed("median", "body")


def with_body_size(rows: DataFrame, content: Column, least: int = 40) -> DataFrame:
    """rows with body: the same weighted median of each page's content as windows, 16 where it has no size. A page without
    content runs of `least` characters takes all its runs."""
    w = Window.partitionBy("page_id")
    n = F.length("text")
    prose = content & (n >= least)
    rows = rows.withColumn("__p", F.max(prose).over(w))
    rows = rows.withColumn("__w", F.when(~F.col("__p") | prose, n).otherwise(0)).withColumn("__s", T.round_to(F.col("size"), 0.5))
    run = F.sum("__w").over(w.orderBy("__s").rangeBetween(Window.unboundedPreceding, Window.currentRow))
    rows = rows.withColumn("__r", run).withColumn("__t", F.sum("__w").over(w))
    body = F.min(F.when((F.col("__w") > 0) & (F.col("__r") >= F.floor(F.col("__t") / 2)), F.col("__s"))).over(w)
    return rows.withColumn("body", F.coalesce(F.when(body > 0, body), F.lit(16.0))).drop("__p", "__w", "__s", "__r", "__t")


def weighted_median(sums: DataFrame, keys: list[str], value: str, weight: str) -> DataFrame:
    """The least value at which the running weight reaches half of the total (halved as an integer)."""
    run = F.sum(weight).over(Window.partitionBy(*keys).orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    total = F.sum(weight).over(Window.partitionBy(*keys))
    return sums.withColumn("__r", run).withColumn("__t", total).where(F.col("__r") >= F.floor(F.col("__t") / 2)).groupBy(*keys).agg(F.min(value).alias("median"))


def echoes(rows: DataFrame, page: str = "page_id", key: str = "key", order: str = "ord") -> DataFrame:
    """rows without what repeats at once: the longest run of at most 24 keys that equals the run before it goes, from
    left to right; blank keys repeat nothing. Keys of a page come together in one row of the fold, so a page is its unit of work."""
    longest = 24

    def kept(keys: list[str]) -> list[int]:
        out, i = [], 0
        while i < len(keys):
            for n in range(min(longest, (len(keys) - i) // 2), 0, -1):
                if keys[i : i + n] == keys[i + n : i + 2 * n] and all(keys[i : i + n]):
                    out += range(i, i + n)
                    i += 2 * n
                    break
            else:
                out.append(i)
                i += 1
        return out

    def mask(keys: list[str]) -> list[bool]:
        out = [False] * len(keys)
        for i in kept(keys):
            out[i] = True
        return out

    @F.arrow_udf("array<boolean>")
    def stays(keys: pa.Array) -> pa.Array:
        return pa.array(map(mask, keys.to_pylist()), pa.list_(pa.bool_()))

    others = [c for c in rows.columns if c not in (page, order)]
    held = rows.groupBy(page).agg(F.array_sort(F.collect_list(F.struct(order, F.struct(*others).alias("r")))).alias("__p"))
    held = held.withColumn("__m", stays(F.transform("__p", lambda x: F.coalesce(x["r"][key], F.lit("")))))
    held = held.select(page, F.explode(F.filter("__p", lambda x, i: F.get("__m", i))).alias("__x"))
    return held.select(page, F.col(f"__x.{order}").alias(order), "__x.r.*").select(*rows.columns)


def templates(rows: DataFrame, page: str = "page_id", text: str = "text", order: str = "ord") -> DataFrame:
    """rows without the second and later of short texts (40 characters) that a page has three times or more."""
    key = T.dedupe_key(text)
    n = F.count("*").over(Window.partitionBy(page, "__k"))
    i = F.row_number().over(Window.partitionBy(page, "__k").orderBy(order))
    rows = rows.withColumn("__k", key).withColumn("__c", n).withColumn("__i", i)
    return rows.where(~((F.length(text) <= 40) & (F.col("__c") >= 3) & (F.col("__i") > 1))).drop("__k", "__c", "__i")


def drop_reason(text: Column) -> Column:
    """Why a block's text is no content; null if it is."""
    return F.when(~T.lexical(text), "non-lexical").when(F.length(text) < 2, "single-character")


def without_link_labels(blocks: DataFrame, links_: DataFrame) -> DataFrame:
    """blocks without linked texts of at most 40 characters that only repeat a link's label; code and contacts stay. links_:
    page_id, labels (an array: a page's links are limited by its source)."""
    may = (F.col("href") != "") & (F.col("type") != "code") & ~T.contact("href") & (F.length("text") <= 40)
    rows = blocks.join(links_.select("page_id", "labels"), "page_id", "left")
    return rows.where(~(may & F.coalesce(F.array_contains("labels", T.dedupe_key("text")), F.lit(False)))).drop("labels")


def sections(blocks: DataFrame, page: str = "page_id", order: str = "ord", heading: Column | None = None) -> DataFrame:
    """blocks with section (number; 0 for what precedes the first heading)."""
    heading = F.col("type") == "heading" if heading is None else heading
    return blocks.withColumn("section", F.sum(heading.cast("int")).over(pages_of(page, order).rowsBetween(Window.unboundedPreceding, 0)))


def section_id(title: Column, ordinal: Column) -> Column:
    """Stable id of a title; the n-th section with the same title carries its number."""
    return section_id_of(title_digest(title), ordinal)


def title_digest(title: Column | str) -> Column:
    return F.sha2(T.dedupe_key(title), 256)


def section_id_of(digest: Column, ordinal: Column) -> Column:
    base = F.concat(F.lit("s_"), F.substring(digest, 1, 10))
    return F.when(ordinal > 1, F.concat(base, F.lit("-"), ordinal.cast("string"))).otherwise(base)


def section_rows(blocks: DataFrame) -> DataFrame:
    """One row a section: id, title, level, blocks, characters, estimated tokens."""
    rows = sections(content(blocks))
    out = rows.groupBy("page_id", "section").agg(
        F.min_by("text", "ord").alias("first"), F.min_by("level", "ord").alias("level"), F.count("*").alias("n_blocks"),
        F.sum(F.length("text")).alias("n_chars"), F.sum(T.tokens("text")).alias("n_tokens"),
    )
    out = out.withColumn("title", F.when(F.col("section") == 0, "(introduction)").otherwise(F.col("first"))).drop("first")
    n = F.row_number().over(Window.partitionBy("page_id", T.dedupe_key("title")).orderBy("section"))
    return out.withColumn("section_id", F.when(F.col("section") == 0, "s_intro").otherwise(section_id(F.col("title"), n)))


def dense_levels(rows: DataFrame, page: str, level: str) -> DataFrame:
    """rows with level_rank: used levels numbered without gaps. Only the distinct levels of a page are sorted."""
    used = rows.select(F.col(page).alias("__page"), F.col(level).alias("__level")).distinct()
    used = used.withColumn("level_rank", F.dense_rank().over(Window.partitionBy("__page").orderBy("__level")))
    return rows.join(used, F.col(page).eqNullSafe(F.col("__page")) & F.col(level).eqNullSafe(F.col("__level"))).drop("__page", "__level")


def boxes(rows: DataFrame) -> DataFrame:
    """Runs of a served page with the box that its line gives: a line each 40 apart, 32 high, nothing pinned."""
    return rows.withColumn("y", F.col("line") * 40.0).withColumn("bottom", F.col("y") + 32).withColumn("doc_height", (F.max("line").over(Window.partitionBy("page_id")) + 1) * 40.0).withColumn("fixed", F.lit(False))


def blocks(extracted: DataFrame) -> DataFrame:
    """The blocks of each page with ids: content in reading order, then chrome by region and place in the markup; pruned.
    One shuffle by page serves all windows and joins up to the echoes."""
    frags = fragments(extracted).repartition("page_id")
    rows = typed(regions(boxes(long_once(runs(frags).where(F.col("text") != "")))))
    chrome = F.col("region").isin(*CHROME)
    place = Window.partitionBy("page_id").orderBy(chrome, F.when(chrome, F.col("region")), F.when(chrome, path_key("path")), "ord")
    rows = rows.withColumn("ord", F.row_number().over(place)).withColumn("key", T.dedupe_key("text"))
    labels = extracted.select("page_id", F.transform("links", lambda x: T.dedupe_key(x["label"])).alias("labels"))
    rows = without_link_labels(echoes(rows).where(drop_reason(F.col("text")).isNull()), labels)
    rows = templates(rows).drop("key", "y", "bottom", "doc_height", "fixed")
    n = F.row_number().over(pages_of("page_id", "ord"))
    return rows.withColumn("ord", n).withColumn("block_id", F.format_string("b_%03d", n - 1))


def content(blocks_: DataFrame) -> DataFrame:
    """Blocks that aren't chrome."""
    return blocks_.where(~F.col("region").isin(*CHROME))


def titles(extracted: DataFrame, blocks_: DataFrame) -> DataFrame:
    """page_id, title (the page's, else its og:title, else its first heading of level 1 or 2) and summary (its description,
    else paragraphs of 40 characters or more until 320 are had, cut at 400, else its first heading, else the title)."""
    rows = content(blocks_)
    long = (F.col("type") == "paragraph") & (F.length("text") >= 40)
    rows = rows.withColumn("had", F.coalesce(F.sum(F.when(long, F.length("text"))).over(pages_of("page_id", "ord").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    heading = F.col("type") == "heading"
    per = rows.groupBy("page_id").agg(
        F.min_by(F.when(heading & (F.col("level") <= 2), F.col("text")), F.when(heading & (F.col("level") <= 2), F.col("ord"))).alias("high"), F.min_by(F.when(heading, F.col("text")), F.when(heading, F.col("ord"))).alias("first"),
        F.array_sort(F.collect_list(F.when(long & (F.col("had") < 320), F.struct("ord", "text")))).alias("said"),
    )
    out = extracted.select("page_id", "title", "description", "og").join(per, "page_id", "left")
    full = lambda c: F.when(F.coalesce(c, F.lit("")) != "", c)
    title = F.coalesce(full(F.col("title")), full(F.element_at("og", "og:title")), "high", F.lit(""))
    joined = T.truncate(F.array_join(F.transform("said", lambda x: x["text"]), " "), 400)
    return out.select("page_id", title.alias("title"), F.coalesce(full(F.col("description")), full(joined), "first", title).alias("summary"))


def actions(extracted: DataFrame) -> DataFrame:
    """page_id, action_id, type, label, href, method, fields, region, internal, disabled: links with an address, forms and
    labelled buttons, each kind, label and address once a page, in that order."""
    none = F.lit(None).cast("array<struct<name:string,type:string,required:boolean>>")
    base = F.col("url")
    linked = extracted.select("page_id", "url", F.inline("links")).select("page_id", F.lit(0).alias("k"), "seq", F.lit("link").alias("type"), T.clean("label").alias("label"), U.absolute(F.col("href"), base).alias("href"), F.lit("").alias("method"), none.alias("fields"), "landmark", F.lit(False).alias("disabled"), "url").where("href != ''")
    forms = extracted.select("page_id", "url", F.inline("forms")).select("page_id", F.lit(1).alias("k"), "seq", F.lit("form").alias("type"), F.lit("").alias("label"), F.when(F.col("action") == "", "").otherwise(U.absolute(F.col("action"), base)).alias("href"), "method", "fields", "landmark", F.lit(False).alias("disabled"), "url")
    pressed = extracted.select("page_id", "url", F.inline("buttons")).select("page_id", F.lit(2).alias("k"), "seq", F.lit("button").alias("type"), T.clean("label").alias("label"), F.lit("").alias("href"), F.lit("").alias("method"), none.alias("fields"), "landmark", "disabled", "url").where("label != ''")
    rows = linked.unionByName(forms).unionByName(pressed)
    first = Window.partitionBy("page_id", "type", F.lower("label"), "href").orderBy("seq")
    rows = rows.withColumn("n", F.row_number().over(first)).where("n = 1")
    n = F.row_number().over(Window.partitionBy("page_id").orderBy("k", "seq"))
    return rows.select("page_id", F.format_string("a_%03d", n - 1).alias("action_id"), "type", "label", "href", "method", "fields", region(F.col("landmark")).alias("region"), U.internal(F.col("href"), base).alias("internal"), "disabled")


def content_hash(rows: DataFrame, key: str, order: str, *parts: str) -> DataFrame:
    """sha256 over the ordered records of each key."""
    record = F.concat_ws("\x1f", *[F.coalesce(F.col(p).cast("string"), F.lit("")) for p in parts])
    out = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), record.alias("r")))).alias("rs"))
    return out.select(key, F.sha2(F.concat(F.array_join(F.transform("rs", lambda x: x["r"]), "\x1e"), F.lit("\x1e")), 256).alias("content_hash"))


def manifest(pages: DataFrame, extracted: DataFrame) -> DataFrame:
    """One row a page: title, blocks, links, forms, hidden texts, tokens of the markup and of the content, saving."""
    inner = ~F.col("region").isin(*CHROME)
    own = lambda c: F.sum(F.when(inner, c).otherwise(0))
    per = blocks(extracted).groupBy("page_id").agg(F.count_if(inner).alias("n_blocks"), F.count_if(~inner).alias("n_chrome"), own(F.length("text")).alias("n_chars"), own(T.tokens("text")).alias("content_tokens"), own((F.col("type") == "heading").cast("int")).alias("n_headings"))
    raw = pages.select(F.col("page_id").cast("long").alias("page_id"), T.html_tokens(F.coalesce("html", F.lit(""))).alias("raw_tokens"))
    out = extracted.select("page_id", "url", "title", F.size("links").alias("n_links"), F.size("forms").alias("n_forms"), F.size("latent").alias("n_latent"))
    out = out.join(raw, "page_id").join(per, "page_id", "left")
    for k in ("n_blocks", "n_chrome", "n_chars", "content_tokens", "n_headings"):
        out = out.withColumn(k, F.coalesce(k, F.lit(0)).cast("long"))
    return out.withColumn("saving", F.round(1 - F.col("content_tokens") / F.greatest("raw_tokens", F.lit(1)), 3))
