"""Text that a page ships as data: JSON-LD facts, question and answer pairs, and the payloads of hydrating frameworks.

A kernel walks each parsed JSON value and emits raw strings in document order; cleaning, tests, de-duplication and
limits are column expressions and windows of one page each. A value that isn't JSON gives nothing.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from decimal import Decimal

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folio.functions import text as T

# Properties that are read, those that hold further objects, containers of questions, and limits.
PROPERTIES = frozenset(
    "name legalName alternateName brand identifier vatID taxID duns description disambiguatingDescription slogan "
    "foundingDate datePublished dateModified dateCreated startDate endDate "
    "author creator publisher founder contactPoint telephone email "
    "address addressLocality addressRegion addressCountry streetAddress postalCode areaServed location "
    "price priceCurrency availability sku offers aggregateRating ratingValue reviewCount material color size "
    "headline articleSection keywords inLanguage wordCount "
    "itemListElement position url openingHours openingHoursSpecification".split()
)
HOLDERS = frozenset("address offers aggregateRating contactPoint author publisher brand founder creator itemListElement openingHoursSpecification location".split())
QUESTION_HOLDERS = ("mainEntity", "mainEntityOfPage", "itemListElement", "@graph", "hasPart")
LD_DEPTH, FACTS, FACT_CHARS = 6, 60, 400
PAIRS, ANSWER_CHARS = 30, 1200
PAYLOAD_DEPTH, PAYLOAD_RUNS, PAYLOAD_BYTES, PAYLOAD_LINKS = 32, 400, 40_000, 120


def _number(_):
    raise ValueError("not JSON")


def parsed(body: str):
    """The JSON value of body, or None; NaN and infinities aren't JSON."""
    try:
        return json.loads(body, parse_constant=_number)
    except (ValueError, RecursionError):
        return None


def leaf(v) -> str:
    """A string, number or boolean as text, the first twelve of a list joined by commas, "" for all else."""
    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, (int, float)):
        v = float(v)
        return f"{Decimal(repr(v)).normalize():f}" if 1e-6 <= abs(v) < 1e21 or not v else repr(v)
    if isinstance(v, str):
        return v.strip()
    if isinstance(v, list):
        said = [x for x in map(leaf, v) if x]
        return ", ".join(said[:12])
    return ""


def _found_facts(v, kind: str, depth: int) -> Iterator[tuple[str, str, str]]:
    if depth > LD_DEPTH:
        return
    if isinstance(v, list):
        for x in v:
            yield from _found_facts(x, kind, depth + 1)
    elif isinstance(v, dict):
        own = v.get("@type")
        kind = own if isinstance(own, str) and own else kind
        for field in sorted(PROPERTIES & v.keys()):
            x = v[field]
            if field in HOLDERS and not isinstance(x, str):
                yield from _found_facts(x, kind, depth + 1)
            elif said := leaf(x):
                yield kind, field, said


def _answers(v) -> list[str]:
    if isinstance(v, list):
        return [a for x in v for a in _answers(x)]
    return [v] if isinstance(v, str) else [leaf(v.get("text"))] if isinstance(v, dict) else []


def _found_pairs(v, depth: int) -> Iterator[tuple[list[str], list[str]]]:
    if depth > LD_DEPTH:
        return
    if isinstance(v, list):
        for x in v:
            yield from _found_pairs(x, depth + 1)
    elif isinstance(v, dict):
        if str(v.get("@type") if isinstance(v.get("@type"), str) else "").lower() == "question":
            yield [leaf(v.get("name")), leaf(v.get("text"))], _answers(v.get("acceptedAnswer")) + _answers(v.get("suggestedAnswer"))
        else:
            for k in QUESTION_HOLDERS:
                yield from _found_pairs(v.get(k), depth + 1)


def _found_strings(v, depth: int) -> Iterator[str]:
    if depth > PAYLOAD_DEPTH:
        return
    if isinstance(v, str):
        yield v.strip()
    elif isinstance(v, (list, dict)):
        for x in v if isinstance(v, list) else v.values():
            yield from _found_strings(x, depth + 1)


def _found_links(v, depth: int) -> Iterator[tuple[str, str]]:
    """Neighbours in a list, a label and an address, before what lies deeper."""
    if depth > PAYLOAD_DEPTH or not isinstance(v, (list, dict)):
        return
    if isinstance(v, list):
        yield from ((a.strip(), b.strip()) for a, b in zip(v, v[1:]) if isinstance(a, str) and isinstance(b, str) and b.strip().startswith(("http://", "https://")))
    for x in v if isinstance(v, list) else v.values():
        yield from _found_links(x, depth + 1)


def _walked(extracted: DataFrame, column: str, walk, fields: str) -> DataFrame:
    """page_id, seq and what walk finds in each JSON text of an array column, in order."""
    names = [f.strip().split(" ")[0] for f in fields.split(",")]
    schema = f"page_id long, seq int, {fields}"

    def run(batches):
        for b in batches:
            rows = []
            for page, bodies in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                found = (x for body in bodies or () for x in walk(parsed(body.strip())))
                rows += [{"page_id": page, "seq": i, **dict(zip(names, x))} for i, x in enumerate(found)]
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    text, texts = pa.string(), pa.list_(pa.string())
    arrow = pa.schema([("page_id", pa.int64()), ("seq", pa.int32()), *[(f.strip().split(" ")[0], texts if "array" in f else text) for f in fields.split(",")]])
    return extracted.where(F.size(column) > 0).select("page_id", column).mapInArrow(run, schema)


def _first(rows: DataFrame, *keys: str, limit: int) -> DataFrame:
    """The first row of each key on its page, and of those the first `limit` of the page."""
    rows = rows.withColumn("__n", F.row_number().over(Window.partitionBy("page_id", *keys).orderBy("seq"))).where("__n = 1")
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy("page_id").orderBy("seq"))).where(F.col("__n") <= limit).drop("__n")


def facts(extracted: DataFrame) -> DataFrame:
    """page_id, ord, type, field, value: whitelisted properties with the nearest type, in order of type, field and value."""
    rows = _walked(extracted, "json_ld", lambda v: _found_facts(v, "", 0), "type string, field string, value string")
    rows = rows.withColumn("value", T.truncate(T.clean("value"), FACT_CHARS)).where("value != ''")
    rows = _first(rows, "type", "field", "value", limit=FACTS)
    return rows.select("page_id", (F.row_number().over(Window.partitionBy("page_id").orderBy("type", "field", "value")) - 1).alias("ord"), "type", "field", "value")


def faq(extracted: DataFrame) -> DataFrame:
    """page_id, seq, question, answer: each question once, with the first answer that has text."""
    rows = _walked(extracted, "json_ld", lambda v: _found_pairs(v, 0), "question array<string>, answer array<string>")
    said = lambda c: F.coalesce(F.get(F.filter(F.transform(c, T.clean), lambda x: x != ""), F.lit(0)), F.lit(""))
    rows = rows.withColumn("question", T.truncate(said("question"), FACT_CHARS)).withColumn("answer", T.truncate(said("answer"), ANSWER_CHARS))
    return _first(rows.where("question != '' AND answer != ''"), "question", limit=PAIRS)


def payload_texts(extracted: DataFrame) -> DataFrame:
    """page_id, seq, text, key: strings of hydration payloads that read as prose, each once. A page's harvest ends with the
    string that reaches the byte limit, or at the limit of strings."""
    rows = _walked(extracted, "payloads", lambda v: ((s,) for s in _found_strings(v, 0)), "text string")
    rows = rows.where(T.hydration_prose("text")).withColumn("key", T.dedupe_key("text"))
    rows = _first(rows, "key", limit=PAYLOAD_RUNS)
    before = Window.partitionBy("page_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("__b", F.coalesce(F.sum(F.octet_length("text")).over(before), F.lit(0)))
    return rows.where(F.col("__b") < PAYLOAD_BYTES).drop("__b")


def payload_links(extracted: DataFrame) -> DataFrame:
    """page_id, seq, label, href: labelled addresses of hydration payloads, each address once."""
    rows = _walked(extracted, "payloads", lambda v: _found_links(v, 0), "label string, href string")
    return _first(rows.where(T.hydration_label("label") & (F.length("href") <= 300)), "href", limit=PAYLOAD_LINKS)
