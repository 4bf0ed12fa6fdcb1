import glob
import math
import os

import duckdb
import pytest

from helixframe import catalog
from helixframe.streaming import incremental

SF = "/root/testdata/sf0.001"


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    return v if isinstance(v, (int, str, type(None))) else str(v)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are absent")
@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, duck, name):
    df = catalog.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(norm(r[c]) for c in columns) for r in df.collect()), key=str)
    sql = catalog.oracle_sql().get(name)
    if sql is None:
        assert got
        return
    r = duck.execute(sql)
    names = [d[0] for d in r.description]
    assert sorted(names) == columns
    order = sorted(range(len(names)), key=names.__getitem__)
    assert got == sorted((tuple(norm(x[i]) for i in order) for x in r.fetchall()), key=str)


def test_entry_without_the_optional_part(spark):
    import __spark_entry__ as entry

    assert set(catalog.queries()) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).columns == ["chr", "pos", "n", "sx", "slx", "sxlx", "k", "theta"]


def test_merging_sink(spark, tmp_path):
    ddl = "chr string, pos long, nA long, nC long, nG long, nT long, nN long, nX0 long, nX1 long, nI long, nD long, indels string"
    sink = incremental.merging_sink(spark, f"file://{tmp_path}")
    for i in (0, 1, 1):  # a batch that runs again changes nothing
        sink(spark.createDataFrame([("1", 5, 1 + i, 0, 0, 0, 0, 0, 0, 1, 0, f"^A={i + 1}")], ddl), i)
    row = spark.read.parquet(f"{tmp_path}/version=1").first()
    assert (row.nA, row.indels) == (3, "^A=3")


def test_windowed_counts(spark, tmp_path):
    rows = [(f"2024-01-01 00:{m:02d}:00", "a", 1.0) for m in (0, 5, 12)] + [("2024-01-02 00:00:00", "b", 2.0)]
    df = spark.createDataFrame(rows, "ts string, event_type string, value double").selectExpr("cast(ts as timestamp) ts", "event_type", "value")
    df.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
    q = incremental.windowed_counts(stream).writeStream.format("memory").queryName("w").outputMode("append").option("checkpointLocation", f"{tmp_path}/log").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted((str(r.start), r.n, r.total) for r in spark.table("w").collect()) == [("2024-01-01 00:00:00", 2, 2.0), ("2024-01-01 00:10:00", 1, 1.0)]
