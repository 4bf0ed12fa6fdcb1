"""What the native operators run, and what is never in a plan."""

import pytest
from pyspark.sql import functions as F

from helixframe.llm import decontamination, pii


FOREIGN = ("Python", "Pandas", "ArrowEval", "MapInArrow", "NestedLoop", "Cartesian")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("limit", [32 << 20, 0])
def test_decontamination_is_native(spark, monkeypatch, limit):
    monkeypatch.setattr(decontamination, "BROADCAST_BYTES", limit)
    docs = spark.createDataFrame([(1, "a b c d e f g")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a b c d e f g")], "item_id long, text string")
    name = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(name)
    spark.conf.set(name, "-1")
    p = plan(decontamination.overlaps(docs, items))
    spark.conf.set(name, before)
    assert not any(x in p for x in FOREIGN)
    assert ("BroadcastHashJoin" in p) == bool(limit) and ("SortMergeJoin" in p) == (not limit)


def test_the_hits_join_is_compiled(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        docs = spark.range(5).select(F.col("id").alias("doc_id"), F.lit("a b c d e f g").alias("text"))
        p = plan(decontamination.overlaps(docs, docs.withColumnRenamed("doc_id", "item_id")))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    stage = p.split("BroadcastHashJoin")[0].rsplit("*(", 1)[1].split(")")[0]
    assert p.count(f"*({stage}) Generate") == 2


def test_personal_data_is_native(spark, monkeypatch):
    """The plans of all tables that are written on the way, and the last one."""
    plans = []

    def seen(df, name, real=pii.written):
        plans.append(plan(df))
        return real(df, name)

    monkeypatch.setattr(pii, "written", seen)
    docs = spark.createDataFrame([(1, "a@b.com, Mrs Anna Smith, 10.0.0.1")], "doc_id long, text string")
    plans.append(plan(pii.pseudonymised(docs, "k")))
    assert len(plans) >= 8 and not any(x in p for p in plans for x in FOREIGN)
