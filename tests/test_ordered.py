import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from folio.operators import graph as G
from folio.operators import retrieve as R
from folio.operators.ordered import blocks_of, numbered


@pytest.fixture
def parted(spark):
    """Without AQE, so that small tables are range-partitioned as large ones are."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    yield spark
    spark.conf.set("spark.sql.adaptive.enabled", "true")


def keyed(spark, n=3000):
    """A key with most of the rows, null keys and keys of one row."""
    key = F.when(F.col("id") % 7 == 0, F.lit(None)).when(F.col("id") % 50 == 1, F.col("id").cast("string")).otherwise(F.lit("hot"))
    return spark.range(n).select(key.alias("k"), F.xxhash64("id").alias("o"), "id")


def test_numbered_is_row_number_over_many_partitions(parted):
    rows = keyed(parted)
    out = numbered(rows, "n", "k", "o")
    assert out.columns == ["k", "o", "id", "n"]
    plain = rows.withColumn("n", F.row_number().over(Window.partitionBy("k").orderBy("o")).cast("long"))
    assert sorted(out.collect(), key=lambda r: r.id) == sorted(plain.collect(), key=lambda r: r.id)
    hot = rows.where("k = 'hot'").repartitionByRange("k", "o").select(F.spark_partition_id().alias("p")).distinct().count()
    assert hot > 1, "the hot key is to lie in several partitions"


def test_numbered_ties_and_empty(parted):
    tied = parted.createDataFrame([("a", 1)] * 5 + [(None, 2)] * 3 + [("b", None)], "k string, o int")
    assert sorted((r.k or "", r.n) for r in numbered(tied, "n", "k", "o").collect()) == [("", 1), ("", 2), ("", 3), ("a", 1), ("a", 2), ("a", 3), ("a", 4), ("a", 5), ("b", 1)]
    assert numbered(tied.limit(0), "n", "k", "o").collect() == []


@pytest.mark.parametrize("block", [3, 7, 4096])
def test_blocks_hold_all_neighbours(parted, block):
    rows = numbered(keyed(parted, 400), "n", "k", "o")
    near, whole = Window.partitionBy("k", "__b").orderBy("n"), Window.partitionBy("k").orderBy("n")
    out = blocks_of(rows, "n", before=2, after=3, block=block).withColumn("was", F.lag("id", 2).over(near)).withColumn("next", F.lead("id", 3).over(near))
    plain = rows.withColumn("was", F.lag("id", 2).over(whole)).withColumn("next", F.lead("id", 3).over(whole))
    said = out.where("__own").select("id", "was", "next").collect()
    assert sorted(said, key=lambda r: r.id) == sorted(plain.select("id", "was", "next").collect(), key=lambda r: r.id)
    with pytest.raises(ValueError):
        blocks_of(rows, "n", before=block + 1, block=block)


def test_rank_agreement_equals_all_pairs_at_the_offsets(parted):
    rows = numbered(numbered(keyed(parted, 400), "a", "k", "id"), "b", "k", "o")
    held = {}
    for r in rows.collect():
        held.setdefault(r.k, {})[r.a] = r.b
    want = {}
    for k, b in held.items():
        pairs = [b[i + s] > b[i] for i in b for s in (1, 2, 3, 5, 8, 13, 21, 34) if i + s in b]
        if pairs:
            want[k] = (len(pairs), sum(pairs))
    assert {r.k: (r.pairs, r.agreeing) for r in R.rank_agreement(rows, "k", "a", "b").collect()} == want


def test_dense_levels_keeps_null_and_repeated_rows(spark):
    rows = spark.createDataFrame([("a", 3), ("a", 3), ("a", 9), ("a", None), (None, 5)], "page string, level int")
    out = G.dense_levels(rows, "page", "level")
    assert out.columns == ["page", "level", "level_rank"]
    assert sorted(map(tuple, out.collect()), key=str) == sorted([("a", 3, 2), ("a", 3, 2), ("a", 9, 3), ("a", None, 1), (None, 5, 1)], key=str)
