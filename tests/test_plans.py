"""The physical plans that the operators rely on."""

import re

import pytest
from pyspark.sql import functions as F

from helixframe.functions import kmers
from helixframe.operators import counts, intervals, reads


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def shuffled(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield spark
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_range_joins_have_a_key(shuffled):
    a = shuffled.range(10).select(F.lit("x").alias("chr"), F.col("id").alias("pos"))
    b = shuffled.range(10).select(F.lit("x").alias("chr"), F.col("id").alias("start"), (F.col("id") + 5).alias("end"))
    for df in (intervals.points_in(a, b), intervals.points_in(a, b, how="left_semi"), intervals.overlaps(b.withColumnsRenamed({"start": "s", "end": "e"}), b, a_range=("s", "e"), b_range=("start", "end"))):
        assert "SortMergeJoin" in plan(df) and "NestedLoop" not in plan(df) and "Cartesian" not in plan(df)


def test_scans_read_what_is_used(spark, tmp_path):
    wide = spark.range(5).select(F.lit("1").alias("chr"), F.col("id").alias("pos"), *(F.lit(1).cast("long").alias(c) for c in counts.COUNTS), F.lit("").alias("indels"), F.lit("x").alias("more"))
    wide.write.parquet(f"{tmp_path}/counts")
    p = plan(counts.group_counts(spark.read.parquet(f"{tmp_path}/counts").where("pos > 2"), spark.createDataFrame([("1", 0, 9, "g")], "chr string, start long, end long, gene string")))
    assert "ReadSchema: struct<chr:string,pos:bigint,nA:bigint,nC:bigint,nG:bigint,nT:bigint,nI:bigint,nD:bigint>" in p and "GreaterThan(pos,2)" in p


def test_samples_are_taken_before_the_shuffle(spark):
    seqs = spark.createDataFrame([("ACGT" * 20,)], "seq string")
    p = plan(reads.sketch_histogram(seqs))
    # Where k-mers are packed they are also sampled, and what is shuffled are sums of longs.
    assert p.rindex("Exchange") < p.index("MapInArrow") and "partial_sum" in p[p.rindex("Exchange") :]
    # The chain of the hash isn't written out several times over.
    p = plan(reads.bottom_k(seqs, 8, 10))
    assert "__h" in p and len(p) < 60_000


def test_kmers_are_compiled(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        p = plan(kmers.both_strands(kmers.kmers(spark.createDataFrame([("ACGT",)], "seq string"), 3)))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert len(re.findall(r"\*\(\d+\) Generate", p)) == 2 and "Python" not in p


def test_merging_counts_sums_before_the_shuffle(spark):
    df = spark.createDataFrame([("1", 1, *[1] * 9, "")], "chr string, pos long, " + ", ".join(f"{c} long" for c in counts.COUNTS) + ", indels string")
    p = plan(counts.merge_counts(df).drop("indels"))
    assert "partial_sum" in p and "Python" not in p
