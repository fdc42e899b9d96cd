"""Which tier a page needs, from cheap measures: a score of weighted factors, floors, a memory by host."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Tiers by rank, thresholds and weights.
TIERS = ("fetch", "render", "sweep", "recover")


@dataclass(frozen=True)
class Thresholds:
    chars: tuple[int, int, int] = (100, 400, 1600)
    ratio: tuple[float, float, float] = (0.004, 0.012, 0.036)
    render: float = 0.35
    sweep: float = 0.55
    recover: float = 0.75


def rank(tier: Column) -> Column:
    return F.coalesce(F.array_position(F.array(*map(F.lit, TIERS)), tier).cast("int") - 1, F.lit(0))


def tier_of(rank_: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, TIERS)), rank_ + 1)


def _steps(c: Column, *arms: tuple[float, float]) -> Column:
    out = F
    for below, value in arms:
        out = out.when(c < below, F.lit(float(value)))
    return out.otherwise(F.lit(0.0))


def factors(t: Thresholds = Thresholds()) -> dict[str, tuple[float, Column]]:
    """Weight and value of each factor, over the columns of a signals table."""
    c = F.col
    text, markup = c("text_chars"), c("markup_chars")
    ratio = text / F.greatest(c("html_bytes"), F.lit(1))
    structure = c("headings") + c("paragraphs") + c("landmarks")
    per_char = c("script_bytes") / F.greatest(text, F.lit(1))
    one = F.lit(1.0)
    return {
        "text": (0.35, _steps(text, (t.chars[0], 1), (t.chars[1], 0.7), (t.chars[2], 0.3))),
        "ratio": (0.20, F.when(c("html_bytes") > 0, _steps(ratio, (t.ratio[0], 1), (t.ratio[1], 0.6), (t.ratio[2], 0.2))).otherwise(0.0)),
        "struct": (0.15, _steps(structure, (1, 1), (5, 0.6), (15, 0.2))),
        "declared": (0.10, F.when(c("noscript"), one).when(c("hydration"), 0.5).otherwise(0.0)),
        "script": (0.10, F.when((text > 0) & (per_char > 400), one).when((text > 0) & (per_char > 120), 0.5).otherwise(0.0)),
        "canvas": (0.10, F.when(c("canvases") > 0, one).otherwise(0.0)),
        "opaque": (0.08, F.when((c("sheets") > 2) | (c("complex_rules") > 20), one).when((c("sheets") > 0) | (c("complex_rules") > 0), 0.5).otherwise(0.0)),
        "lib": (0.20, F.col("lib_weight").cast("double")),
        "shortfall": (0.30, F.when((text > 0) & (markup > 0) & (text / F.greatest(markup, F.lit(1)) < 0.5) & (markup - text >= 2000), one).otherwise(0.0)),
        "folded": (0.30, F.when((c("folded_controls") > 0) & (c("folded_chars") >= 200), one).otherwise(0.0)),
    }


DEFAULTS = {"lib_weight": 0.0, "folded_controls": 0, "folded_chars": 0, "noscript": False, "hydration": False, "canvases": 0, "sheets": 0, "complex_rules": 0, "headings": 0, "paragraphs": 0, "landmarks": 0, "script_bytes": 0, "text_runs": 0, "short_runs": 0}


def decide(signals: DataFrame, t: Thresholds = Thresholds()) -> DataFrame:
    """signals with score, tier and the three weightiest factors that count."""
    for k, v in DEFAULTS.items():
        if k not in signals.columns:
            signals = signals.withColumn(k, F.lit(v))
    parts = factors(t)
    total = sum((F.lit(w) * v for w, v in parts.values()), F.lit(0.0))
    rounded = F.floor(F.least(total, F.lit(1.0)) * 1000 + F.lit(0.5)) / F.lit(1000.0)
    lifted = (parts["shortfall"][1] > 0) | (parts["folded"][1] > 0)
    out = signals.withColumn("score", F.when(lifted, F.greatest(rounded, F.lit(t.render))).otherwise(rounded))
    by_score = F.when((F.col("score") >= t.recover) & (F.col("canvases") > 0), 3).when(F.col("score") >= t.sweep, 2).when(F.col("score") >= t.render, 1).otherwise(0)
    library = F.when(F.col("lib_weight") >= 0.85, 2).when(F.col("lib_weight") >= 0.55, 1).otherwise(0)
    split = F.when((F.col("short_runs") >= 8) & (F.col("short_runs") / F.greatest(F.col("text_runs"), F.lit(1)) >= 0.18), 2).otherwise(0)
    out = out.withColumn("tier", tier_of(F.when(library > by_score, library).otherwise(F.greatest(by_score, split))))
    named = F.array(*[F.struct((-F.lit(w) * v).alias("k"), F.lit(i).alias("i"), F.lit(n).alias("name"), v.alias("value"), F.lit(w).alias("weight")) for i, (n, (w, v)) in enumerate(parts.items())])
    top = F.slice(F.array_sort(F.filter(named, lambda x: x["value"] > 0)), 1, 3)
    return out.withColumn("factors", F.transform(top, lambda x: F.struct(x["name"].alias("name"), x["value"].alias("value"), x["weight"].alias("weight"))))


def ratchet(visits: DataFrame, host: str = "host", at: str = "t", tier: str = "rank") -> DataFrame:
    """visits with pinned: the highest rank that the host has had so far."""
    return visits.withColumn("pinned", F.max(tier).over(Window.partitionBy(host).orderBy(at).rowsBetween(Window.unboundedPreceding, 0)))


def clamp(rank_: Column, low: int, high: int) -> Column:
    return F.least(F.greatest(rank_, F.lit(low)), F.lit(high))


def static_preferred(static_chars: Column, rendered_chars: Column) -> Column:
    return (static_chars >= 400) & (static_chars > 3 * rendered_chars)
