"""Runs of recorded captures: what was seen of a node over its checkpoints, and which runs are kept."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folio.functions import text as T

# Fixed values.
VISIBLE, REVEALED = 0.12, 3
UNSEEN, COLOUR, TWIN = "never reached visible opacity", "text colour matches background", "declared duplicate"


def reinforced(nodes: DataFrame) -> DataFrame:
    """One row a (page_id, path, text) of nodes (and checkpoint, seq, opacity, visible, same_colour, x, y, w, h): how far its
    opacity went, whether it was ever visible, whether its colour always matched, and the box of its clearest sighting (the earliest
    of equals)."""
    best = F.min(F.struct(-F.col("opacity"), ~F.col("visible"), "checkpoint", "seq", F.struct("x", "y", "w", "h").alias("box")))
    return nodes.groupBy("page_id", "path", "text").agg(
        F.max("opacity").alias("max_opacity"), F.min("opacity").alias("min_opacity"), F.bool_or("visible").alias("ever_visible"), F.bool_and("same_colour").alias("same_colour"),
        F.min("checkpoint").alias("first_checkpoint"), F.count("*").alias("seen"), best["box"].alias("box"),
    )


def kept(runs: DataFrame) -> DataFrame:
    """runs (page_id, ord, text, min_opacity, max_opacity, same_colour, revealable) with keep, declared and drop_reason. A page on
    which three runs or more crossed the visible floor animates its text, so that runs still under it are declared, not
    hidden; of declared runs the first of a text stays, if no run that was seen says it."""
    w = Window.partitionBy("page_id")
    crossed = F.count_if((F.col("max_opacity") >= VISIBLE) & (F.col("min_opacity") < VISIBLE)).over(w)
    unseen = F.col("max_opacity") < VISIBLE
    rows = runs.withColumn("declared", unseen & (F.coalesce("revealable", F.lit(False)) | (crossed >= REVEALED)) & ~F.col("same_colour"))
    rows = rows.withColumn("drop_reason", F.when(F.col("same_colour"), COLOUR).when(unseen & ~F.col("declared"), UNSEEN))
    said = Window.partitionBy("page_id", T.dedupe_key("text"))
    told = F.max(F.col("drop_reason").isNull() & ~F.col("declared")).over(said)
    turn = F.row_number().over(said.orderBy(~F.col("declared"), "ord"))
    rows = rows.withColumn("drop_reason", F.when(F.col("declared") & (told | (turn > 1)), TWIN).otherwise(F.col("drop_reason")))
    return rows.withColumn("keep", F.col("drop_reason").isNull())


def observed_chars(runs: DataFrame) -> DataFrame:
    """page_id, observed: characters of runs that reached the visible floor and weren't the colour of what is behind them."""
    return runs.where((F.col("max_opacity") >= VISIBLE) & ~F.col("same_colour")).groupBy("page_id").agg(F.sum(F.length("text")).alias("observed"))


def retention(observed: Column, emitted: Column) -> Column:
    """The share of what was seen that was emitted, 1 at most, to three places; 1 where nothing was seen."""
    return F.when(F.coalesce(observed, F.lit(0)) == 0, F.lit(1.0)).otherwise(T.round_to(F.least(emitted / observed, F.lit(1.0)), 0.001))


def verified(declared: Column, source: Column) -> Column:
    return F.when(declared, "speculative").otherwise(source)


def flags(text: Column, same_colour: Column, declared: Column) -> Column:
    """What a reader has to know of a block's text before it quotes it."""
    said = (("bidi-control-removed", text.rlike(T.BIDI)), ("invisible-characters-removed", text.rlike(T.INVISIBLE)), ("text-colour-matches-background", same_colour), ("declared-reveal-not-observed", declared))
    return F.array_compact(F.array(*[F.when(c, name) for name, c in said]))


def merged_media(rows: DataFrame) -> DataFrame:
    """One row a (page_id, src, or path without one) of rows (and seq, alt, decorative, w, h): the largest box, the first alt text,
    decorative only if it always was."""
    key = F.when(F.coalesce("src", F.lit("")) != "", F.col("src")).otherwise(F.col("path"))
    alt = F.when(F.coalesce("alt", F.lit("")) != "", F.col("alt"))
    size = F.struct(-(F.col("w") * F.col("h")), "seq", "w", "h")
    out = rows.groupBy("page_id", key.alias("key")).agg(F.min(size).alias("s"), F.min_by(alt, F.when(alt.isNotNull(), F.col("seq"))).alias("alt"), F.bool_and("decorative").alias("decorative"), F.min("seq").alias("seq"))
    return out.select("page_id", "key", "seq", F.coalesce("alt", F.lit("")).alias("alt"), "decorative", F.col("s.w").alias("w"), F.col("s.h").alias("h"))


def merged_disclosures(rows: DataFrame) -> DataFrame:
    """One row a (page_id, kind, label in any case): open if it ever was, null if no sighting says."""
    return rows.groupBy("page_id", "kind", F.lower("label").alias("key")).agg(F.min_by("label", "seq").alias("label"), F.bool_or("open").alias("open"))


def union_box(x: Column, y: Column, w: Column, h: Column) -> list[Column]:
    """Aggregates x, y, w, h of the box round all."""
    left, top = F.min(x), F.min(y)
    return [left.alias("x"), top.alias("y"), (F.max(x + w) - left).alias("w"), (F.max(y + h) - top).alias("h")]


def same_line(a: Column, b: Column, size: Column) -> Column:
    return F.abs(a - b) <= F.greatest(F.lit(6.0), size * 0.5)


def capped(rows: DataFrame, key: str, order: str, cap: int) -> DataFrame:
    """The first `cap` rows of each key, with saturated: whether the key has more. A capture's own bound, which is reported."""
    w = Window.partitionBy(key)
    rows = rows.withColumn("saturated", F.count("*").over(w) > cap).withColumn("__n", F.row_number().over(w.orderBy(order)))
    return rows.where(F.col("__n") <= cap).drop("__n")


def within_budget(rows: DataFrame, key: str, order: str, size: str, each: int, total: int) -> DataFrame:
    """rows of at most `each` bytes, in order while their running sum is at most `total`."""
    run = F.sum(size).over(Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return rows.where(F.col(size) <= each).withColumn("__r", run).where(F.col("__r") <= total).drop("__r")
