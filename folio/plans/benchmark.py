"""Questions, answers and grades of a benchmark run, and the corpus that confirms recovered text."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from folio.functions import text as T

# Fixed values.
ABSENT, CONDITIONS, CORPUS_CHARS = "NOT IN THE PROVIDED TEXT", ("raw", "artifact"), 8 << 20
TRUNCATED = "\n\n[... truncated: this page is larger than the context available ...]"


def question_set(spark: SparkSession, path: str) -> DataFrame:
    """url, name, id, band, ask, expect, facts of the questions in JSON files; a question without id gets q and its number."""
    kinds = "url string, name string, questions array<struct<id:string,band:string,ask:string,expect:string,facts:array<string>>>"
    rows = spark.read.schema(kinds).json(path, multiLine=True).select("url", "name", F.posexplode("questions").alias("i", "q"))
    named = F.when(F.coalesce("q.id", F.lit("")) != "", F.col("q.id")).otherwise(F.format_string("q%02d", F.col("i") + 1))
    return rows.select("url", "name", named.alias("id"), "q.band", "q.ask", "q.expect", "q.facts")


def tasks(questions: DataFrame) -> DataFrame:
    """Each question under each condition."""
    return questions.withColumn("condition", F.explode(F.array(*map(F.lit, CONDITIONS))))


def graded(answers: DataFrame) -> DataFrame:
    """answers (text, n_facts, n_found) with graded, accuracy, note: without facts nothing is graded, an answer that says the text
    lacks it has found none."""
    absent = F.upper("text").contains(ABSENT)
    none = F.col("n_facts") == 0
    out = answers.withColumn("graded", ~none & (absent | F.col("n_found").isNotNull()))
    score = F.when(~F.col("graded"), None).when(absent, 0.0).otherwise(T.round_to(F.col("n_found") / F.col("n_facts"), 0.001))
    note = F.when(none, "no ground-truth facts supplied for this question; not scored").when(absent, "the answer reported the information was absent")
    return out.withColumn("accuracy", score).withColumn("note", note)


def agreement(grades: DataFrame, *by: str) -> DataFrame:
    """by, n, agreeing, share: of answers that two graders scored (a, b), those scored within 0.001."""
    both = grades.where("a IS NOT NULL AND b IS NOT NULL")
    out = both.groupBy(*by).agg(F.count("*").alias("n"), F.count_if(F.abs(F.col("a") - F.col("b")) < 0.001).alias("agreeing"))
    return out.withColumn("share", T.round_to(F.col("agreeing") / F.col("n"), 0.001))


def fidelity(claims: DataFrame, *by: str) -> DataFrame:
    """by, n, supported, fidelity: of emitted texts (claim) those that the page's own text (source) holds, folded."""
    held = T.normal_form("source").contains(T.normal_form("claim"))
    out = claims.groupBy(*by).agg(F.count("*").alias("n"), F.count_if(held).alias("supported"))
    return out.withColumn("fidelity", T.round_to(F.col("supported") / F.col("n"), 0.001))


def dominant_failure(groups: DataFrame) -> DataFrame:
    """The commonest reason of groups (reason, n), the first in order of equals, cut at 220 bytes, and how many reasons there are."""
    out = groups.agg(F.count("*").alias("reasons"), F.min(F.struct(-F.col("n"), "reason")).alias("top"))
    said = F.trim("top.reason")
    return out.select("reasons", (-F.col("top.col1")).alias("n"), F.when(F.octet_length(said) > 220, F.concat(T.cut_bytes(said, 217), F.lit("..."))).otherwise(said).alias("reason"))


def raw_context(html: Column, cap: int) -> list[Column]:
    """text and tokens of what of a page fits `cap` tokens: its first cap * bytes / tokens bytes and a mark."""
    n = T.html_tokens(html)
    keep = F.floor(F.lit(cap) * F.octet_length(html) / n).cast("int")
    cut = F.concat(F.rtrim(F.make_valid_utf8(F.substring(html.cast("binary"), F.lit(1), keep).cast("string")), F.lit("�")), F.lit(TRUNCATED))
    text = F.when(n > cap, cut).otherwise(html)
    return [text.alias("text"), T.html_tokens(text).alias("tokens"), (n > cap).alias("truncated")]


@F.arrow_udf(ArrayType(StringType()))
def script_literals(scripts: pa.Array) -> pa.Array:
    """The string literals of each script, 8 to 4,096 bytes long, comments left out."""
    import re

    token = re.compile(r"//[^\n]*|/\*.*?(?:\*/|\Z)|\"((?:\\.|[^\"\\\n])*)(?:\"|(?=\n)|\Z)|'((?:\\.|[^'\\\n])*)(?:'|(?=\n)|\Z)|`((?:\\.|[^`\\])*)(?:`|\Z)", re.DOTALL)
    out = []
    for s in scripts.to_pylist():
        found = [next(g for g in m.groups() if g is not None) for m in token.finditer(s or "") if any(g is not None for g in m.groups())]
        out.append([x for x in found if 8 <= len(x.encode("utf-8", "surrogatepass")) <= 4096])
    return pa.array(out, pa.list_(pa.string()))


def corpus(sources: DataFrame, cap: int = CORPUS_CHARS) -> DataFrame:
    """page_id, text, chars, saturated, n_text, n_script of sources (page_id, seq, kind: text or script, body): texts as they are, of scripts
    the literals that read as prose, joined in order and cut at `cap` characters, which is reported: a text that a saturated corpus
    lacks may stand in the rest."""
    said = F.when(F.col("kind") == "text", F.array("body")).otherwise(F.filter(script_literals("body"), T.literal_prose))
    rows = sources.select("page_id", "seq", "kind", F.posexplode(said).alias("i", "said"))
    out = rows.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("seq", "i", "said"))).alias("s"), F.count_if(F.col("kind") == "text").alias("n_text"), F.count_if(F.col("kind") != "text").alias("n_script"))
    whole = F.array_join(F.transform("s", lambda x: x["said"]), "\n")
    return out.select("page_id", F.substring(whole, 1, cap).alias("text"), F.length(whole).cast("long").alias("chars"), (F.length(whole) > cap).alias("saturated"), "n_text", "n_script")


def library_weights(found: DataFrame, specs: DataFrame, *by: str) -> DataFrame:
    """by, lib_weight, library, notes: the heaviest of the libraries found (name) by specs (name, weight, note), the first by name of
    equals, and the notes of all that have one."""
    rows = found.join(specs, "name")
    out = rows.groupBy(*by).agg(F.min(F.struct(-F.col("weight"), "name")).alias("b"), F.array_sort(F.collect_set(F.when(F.coalesce("note", F.lit("")) != "", F.concat("name", F.lit(": "), "note")))).alias("notes"))
    return out.select(*by, (-F.col("b.col1")).alias("lib_weight"), F.col("b.name").alias("library"), "notes")
