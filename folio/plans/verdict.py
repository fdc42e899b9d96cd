"""Whether a benchmark run clears its four bars: fewer tokens, a gain in accuracy, coverage and fidelity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The bars, and the characters that a served page must show for token reduction to apply.
TOKEN_REDUCTION, ACCURACY_GAIN, COVERAGE, FIDELITY = 0.90, 0.20, 0.90, 0.98
READABLE_CHARS = 400


def paired_gain(answers: DataFrame, *by: str) -> DataFrame:
    """by, compared, accuracy_gain: over the questions that were graded under both conditions. answers: by, question_id,
    condition (raw or artifact), accuracy (null where it was not graded)."""
    side = lambda name: F.max(F.when(F.col("condition") == name, F.col("accuracy")))
    pairs = answers.groupBy(*by, "question_id").agg(side("raw").alias("r"), side("artifact").alias("a")).where("r IS NOT NULL AND a IS NOT NULL")
    return pairs.groupBy(*by).agg(F.count("*").alias("compared"), F.round(F.avg(F.col("a") - F.col("r")), 3).alias("accuracy_gain"))


def verdict(runs: DataFrame) -> DataFrame:
    """runs with token_reduction, reduction_applies, missed (bars not met, in order), passed. runs: raw_scored, artifact_scored,
    raw_tokens, artifact_tokens (means a question), accuracy_gain, coverage, fidelity (null: not measured), visible_chars.
    Where a condition has no graded answer nothing is compared: token_reduction, missed and passed are null."""
    measured = (F.col("raw_scored") > 0) & (F.col("artifact_scored") > 0)
    reduction = F.when(F.col("raw_tokens") > 0, F.round(1 - F.col("artifact_tokens") / F.col("raw_tokens"), 3)).otherwise(0.0)
    applies = F.coalesce(F.col("visible_chars") >= READABLE_CHARS, F.lit(False))
    met = {
        "token reduction": ~applies | (reduction >= TOKEN_REDUCTION), "accuracy gain": F.col("accuracy_gain") >= ACCURACY_GAIN,
        "coverage": F.col("coverage") >= COVERAGE, "fidelity": F.col("fidelity") >= FIDELITY,
    }
    missed = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(bar)) for bar, ok in met.items()]))
    out = runs.withColumn("token_reduction", F.when(measured, reduction)).withColumn("reduction_applies", applies).withColumn("missed", F.when(measured, missed))
    return out.withColumn("passed", F.when(F.col("missed").isNotNull(), F.size("missed") == 0))
