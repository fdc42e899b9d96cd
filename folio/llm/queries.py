"""One query an operator: production parameters, over the whole table."""

from __future__ import annotations

import public_tokenizers

from folio.llm import audio, bpe, decontaminate, language_id, line_dedup, ngram_join, pii, sharding, suffix_dedup, token_counts
from folio.llm._shared import table

RANKS = "byte_bpe_multi_50k.tiktoken"


def _docs(spark, sf_dir):
    return table(spark, sf_dir, "documents")


QUERIES = {
    "op1_language_id": lambda spark, sf_dir: language_id.identify(_docs(spark, sf_dir)),
    "op2_sharding": lambda spark, sf_dir: sharding.shard(_docs(spark, sf_dir)),
    "op3_line_dedup": lambda spark, sf_dir: line_dedup.digests(_docs(spark, sf_dir)),
    "op4_suffix_dedup": lambda spark, sf_dir: suffix_dedup.repeats(_docs(spark, sf_dir)),
    "op5_decontamination": lambda spark, sf_dir: decontaminate.leaks(_docs(spark, sf_dir), table(spark, sf_dir, "benchmark")),
    "op6_audio_features": lambda spark, sf_dir: audio.digests(_docs(spark, sf_dir)),
    "op7_ngram_join": lambda spark, sf_dir: ngram_join.join(_docs(spark, sf_dir)),
    "op8_token_counts": lambda spark, sf_dir: token_counts.token_counts(_docs(spark, sf_dir), public_tokenizers.path(RANKS), public_tokenizers.PATTERN),
    "op9_pii": lambda spark, sf_dir: pii.find(_docs(spark, sf_dir)),
    "op10_byte_bpe": lambda spark, sf_dir: bpe.digests(_docs(spark, sf_dir), public_tokenizers.path(RANKS), public_tokenizers.PATTERN),
}
ORACLES = {"op3_line_dedup": line_dedup.ORACLE}
