"""Content that isn't in the visible blocks: images, folded regions, payload text, served text, canvases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folio.functions import text as T
from folio.functions import urls as U
from folio.operators.graph import CHROME
from folio.sources import structured as S

# Fixed values.
HERO_AREA = 240 * 240
ADOPTED_CHARS, ADOPTION_PROOF = 24, 3
FOLDED = "collapsed disclosure; content was captured into the latent tier"
FOLDED_ABSENT = "collapsed disclosure; its content is not present in the document and was not retrieved"


def meaningful_image(alt: Column, caption: Column, area: Column) -> Column:
    """A caption, three words, 25 characters, or a large image with any text."""
    alt = F.trim(F.coalesce(alt, F.lit("")))
    return (F.coalesce(caption, F.lit("")) != "") | ((alt != "") & ((F.size(F.split(T.collapse(alt), " ")) >= 3) | (F.length(alt) >= 25) | (F.coalesce(area, F.lit(0)) >= HERO_AREA)))


def media(extracted: DataFrame) -> DataFrame:
    """page_id, seq, src (absolute), alt, source, meaningful; images said to be decorative are left out, and the first of a source stays.
    Addresses are made absolute once, on this side, so that joins on src are plain equality."""
    rows = extracted.select("page_id", "url", F.inline("media")).where("NOT (decorative AND alt = '')")
    src = U.absolute(F.col("src"), F.col("url"))
    alt = F.when(F.col("alt") != "", F.col("alt")).otherwise(F.col("title"))
    source = F.when(F.col("alt") != "", "alt").when(F.col("title") != "", "title").otherwise("none")
    rows = rows.select("page_id", "seq", src.alias("src"), T.clean(alt).alias("alt"), source.alias("source"))
    rows = rows.withColumn("__n", F.row_number().over(Window.partitionBy("page_id", "src").orderBy("seq"))).where("__n = 1").drop("__n")
    return rows.withColumn("meaningful", meaningful_image(F.col("alt"), F.lit(""), F.lit(0)))


def gaps(disclosures: DataFrame, latent: DataFrame) -> DataFrame:
    """page_id, label, kind, reason, latent_ids of controls (page_id, label, kind, open) that are shut, with the hidden texts
    (page_id, latent_id, control) that they open."""
    held = latent.where("control != ''").groupBy("page_id", F.col("control").alias("label")).agg(F.array_sort(F.collect_list("latent_id")).alias("latent_ids"))
    rows = disclosures.where("NOT coalesce(open, false)").join(held, ["page_id", "label"], "left")
    return rows.select("page_id", "label", "kind", F.when(F.col("latent_ids").isNull(), FOLDED_ABSENT).otherwise(FOLDED).alias("reason"), F.coalesce("latent_ids", F.array().cast("array<string>")).alias("latent_ids"))


def latent(extracted: DataFrame) -> DataFrame:
    """Hidden texts, each (text in lower case, control) once a page; never part of the content."""
    rows = extracted.select("page_id", F.inline("latent")).withColumn("text", T.clean("text")).where("text != ''")
    rows = rows.withColumn("__n", F.row_number().over(Window.partitionBy("page_id", F.lower("text"), "control").orderBy("seq"))).where("__n = 1").drop("__n")
    n = F.row_number().over(Window.partitionBy("page_id").orderBy("seq"))
    return rows.withColumn("latent_id", F.format_string("h_%03d", n))


def page_gaps(extracted: DataFrame) -> DataFrame:
    """Gaps of served pages, whose disclosures are the closed details elements."""
    hidden = latent(extracted)
    shut = hidden.where("reason = 'closed-details' AND control != ''").select("page_id", F.col("control").alias("label"), F.lit("details").alias("kind"), F.lit(False).alias("open")).distinct()
    return gaps(shut, hidden)


def payload_blocks(extracted: DataFrame, blocks: DataFrame) -> DataFrame:
    """page_id, seq, text of payload strings that no block, fact, title or description says."""
    said = blocks.select("page_id", "text").unionByName(S.facts(extracted).select("page_id", F.col("value").alias("text")))
    said = said.unionByName(extracted.select("page_id", F.explode(F.array("title", "description")).alias("text")))
    said = said.select("page_id", T.dedupe_key("text").alias("key")).distinct()
    rows = S.payload_texts(extracted).withColumn("text", T.clean("text")).withColumn("key", T.dedupe_key("text")).where("key != ''")
    rows = rows.join(said, ["page_id", "key"], "left_anti")
    rows = rows.withColumn("__n", F.row_number().over(Window.partitionBy("page_id", "key").orderBy("seq"))).where("__n = 1")
    return rows.select("page_id", "seq", "text")


def payload_links(extracted: DataFrame, links: DataFrame) -> DataFrame:
    """page_id, href, label of payload links whose address no link of the page has."""
    return S.payload_links(extracted).select("page_id", "href", T.clean("label").alias("label")).join(links.select("page_id", "href").distinct(), ["page_id", "href"], "left_anti")


def adoption_keys(c: Column | str) -> Column:
    """Sentences of at least 24 characters, in lower case."""
    parts = F.transform(F.split(F.lower(T.clean(c)), r"[.!?·\n]"), T.collapse)
    return F.filter(parts, lambda x: F.length(x) >= ADOPTED_CHARS)


def adopted(served: DataFrame, witnessed: DataFrame) -> DataFrame:
    """page_id, text, reason, proof: hidden served texts (page_id, seq, text, reason) that a page is shown to reveal, because
    three or more sentences of its other hidden texts are among the witnessed ones (page_id, text)."""
    seen = witnessed.select("page_id", F.explode(adoption_keys("text")).alias("key")).distinct()
    rows = served.where(F.col("reason").isin("aria-hidden", "opacity-zero")).withColumn("text", T.clean("text")).where(F.length("text") >= ADOPTED_CHARS)
    keys = rows.select("page_id", "seq", F.explode(adoption_keys("text")).alias("key"))
    hits = keys.join(seen, ["page_id", "key"]).groupBy("page_id", "seq").agg(F.count("*").alias("hits"))
    proof = hits.groupBy("page_id").agg(F.sum("hits").alias("proof")).where(F.col("proof") >= ADOPTION_PROOF)
    rows = rows.join(hits.select("page_id", "seq"), ["page_id", "seq"], "left_anti").join(proof, "page_id")
    rows = rows.withColumn("__n", F.row_number().over(Window.partitionBy("page_id", F.lower("text")).orderBy("seq"))).where("__n = 1")
    return rows.select("page_id", "seq", "text", "reason", "proof")


def served_text(extracted: DataFrame, blocks: DataFrame) -> DataFrame:
    """Adopted texts of pages, witnessed by content, questions, answers and facts."""
    pairs = S.faq(extracted).select("page_id", F.explode(F.array("question", "answer")).alias("text"))
    seen = blocks.where(~F.col("region").isin(*CHROME)).select("page_id", "text").unionByName(pairs).unionByName(S.facts(extracted).select("page_id", F.col("value").alias("text")))
    return adopted(extracted.select("page_id", F.inline("latent")), seen)


def canvases(rows: DataFrame, scenes: DataFrame, assets: DataFrame, share: float = 0.25, calls: int = 4) -> DataFrame:
    """page_id, path, text, source, score, confirmed of canvases (page_id, path, fallback, label, viewport_share, uniform, ocr,
    vision, confirmed), by the first of: fallback, label, the page's scene (page_id, text; used once), its assets (page_id, url,
    text; one each, by url), text read from pixels, a description. confirmed: null where there is no corpus to ask."""
    said = lambda c: (lambda t: F.when(F.length(t) >= 3, F.substring(t, 1, 2000)))(T.clean(c))
    own = F.coalesce(said("fallback"), said("label"))
    by_path = Window.partitionBy("page_id", F.col("own").isNull()).orderBy("path")
    rows = rows.withColumn("own", own).withColumn("turn", F.when(F.col("own").isNull(), F.row_number().over(by_path)))
    scenes = scenes.where("text != ''").groupBy("page_id").agg(F.min("text").alias("scene"))
    rows = rows.join(scenes, "page_id", "left").withColumn("rank", F.col("turn") - F.col("scene").isNotNull().cast("int"))
    ranked = assets.where("text != ''").select("page_id", F.col("text").alias("asset"), F.row_number().over(Window.partitionBy("page_id").orderBy("url")).alias("rank"))
    rows = rows.join(ranked, ["page_id", "rank"], "left").withColumn("scene", F.when(F.col("turn") == 1, F.col("scene")))
    shown = F.col("own").isNull() & F.col("scene").isNull() & F.col("asset").isNull() & (F.col("viewport_share") >= share) & ~F.coalesce("uniform", F.lit(False))
    rows = rows.withColumn("read", F.when(shown, said("ocr"))).withColumn("asks", shown & F.col("read").isNull())
    turn = F.row_number().over(Window.partitionBy("page_id", "asks").orderBy("path"))
    rows = rows.withColumn("told", F.when(F.col("asks") & (turn <= calls), said("vision")))
    text = F.coalesce("own", "scene", "asset", "read", "told")
    source = F.when(F.col("own").isNotNull(), "fallback").when(F.coalesce("scene", "asset").isNotNull(), "scene").when(F.col("read").isNotNull(), "ocr").when(F.col("told").isNotNull(), "vision")
    base = F.when(said("fallback").isNotNull(), 0.98).when(F.col("own").isNotNull(), 0.9).when(F.col("scene").isNotNull(), 0.8).when(F.col("asset").isNotNull(), 0.75).when(F.col("read").isNotNull(), 0.6).when(F.col("told").isNotNull(), 0.4).otherwise(0.0)
    asked = F.coalesce("read", "told").isNotNull()
    score = F.when(~asked, base).when(F.col("confirmed").isNull(), base * 0.7).when(F.col("confirmed"), 0.9).otherwise(base * 0.5)
    return rows.select("page_id", "path", text.alias("text"), source.alias("source"), score.alias("score"), (asked & F.coalesce("confirmed", F.lit(False))).alias("confirmed"))
