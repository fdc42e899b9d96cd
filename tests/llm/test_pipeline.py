import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from folio.llm import language_id

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen, kept = docs, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        seen = stage(spark, seen, SF)
        assert seen.columns == docs.columns, name
        kept.append({r.doc_id: r.text for r in seen.collect()})
    whole = {r.doc_id: r.text for r in docs.collect()}
    assert set(kept[0]) == {r.doc_id for r in language_id.identify(docs).where("NOT rejected").collect()}
    assert set(kept[1]) == set(kept[0]) and any(kept[1][d] != whole[d] for d in kept[1])
    assert set(kept[2]) < set(kept[1]) and len(set(kept[2].values())) >= len(kept[2]) - 1
    assert set(kept[3]) < set(kept[2])
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert not any(x in t for x in items for t in kept[3].values())
    out = corpus_pipeline.run(spark, SF)
    assert {r.doc_id for r in out.collect()} == set(kept[3])


def test_stages_on_nulls_and_repeats(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    some = docs.limit(40)
    odd = spark.createDataFrame([(10**9, None, None, None, None), (10**9 + 1, "", None, None, 0), (None, None, "en", "s", None), (10**9 + 2, "1 2 3", "xx", None, 5)], docs.schema)
    rows = docs.unionByName(some).unionByName(odd)
    whole = rows.count()
    seen = [whole]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        rows = stage(spark, rows, SF)
        assert rows.columns == docs.columns
        seen.append(rows.count())
    # rows without a language go first; a repeated row has one doc_id, so it stays or goes with the other
    assert seen[1] == whole - 4 and seen == sorted(seen, reverse=True)
    none = docs.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, SF).collect() == [], name


@pytest.mark.parametrize("told", [None, "9m"])
def test_stages_hold_few_bytes_of_text_at_a_time(spark, told):
    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], names=["n", "size"])

    limit = "spark.sql.execution.arrow.maxBytesPerBatch"
    none = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    wide = spark.range(0, 12_000, 1, 1).select(F.repeat(F.lit("x"), 2000).alias("text"))
    for name, stage in corpus_pipeline.STAGES:
        spark.conf.unset(limit)
        if told:
            spark.conf.set(limit, told)
        try:
            stage(spark, none, SF)
            rows = wide.mapInArrow(sizes, "n long, size long").collect()
        finally:
            spark.conf.unset(limit)
        assert sum(r.n for r in rows) == 12_000, name
        assert max(r["size"] for r in rows) < (10 << 20 if told else 5 << 20), name
        assert not told or max(r["size"] for r in rows) > 8 << 20, name
