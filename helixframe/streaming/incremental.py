"""Counts and gamma statistics kept up to date as files of them arrive."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from helixframe.functions.chrom import chr_key
from helixframe.functions.stats import gamma_parameters
from helixframe.operators.counts import COUNTS, merge_counts


def merged_counts(counts: DataFrame) -> DataFrame:
    """Running sums per locus of a stream of counts, for output mode complete or update; the longer events aside."""
    return counts.groupBy(chr_key(F.col("chr")).alias("key"), "pos").agg(F.min("chr").alias("chr"), *(F.sum(c).cast("long").alias(c) for c in COUNTS)).select("chr", "pos", *COUNTS)


def gamma_statistics(scores: DataFrame) -> DataFrame:
    """Running gamma statistics and parameters per locus of a stream of scores (chr, pos, kld)."""
    x = F.when(F.col("kld") > 0, F.col("kld"))
    sums = scores.groupBy(chr_key(F.col("chr")).alias("key"), "pos").agg(
        F.min("chr").alias("chr"), F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(x), F.lit(0.0)).alias("sx"), F.coalesce(F.sum(F.log(x)), F.lit(0.0)).alias("slx"), F.coalesce(F.sum(x * F.log(x)), F.lit(0.0)).alias("sxlx")
    )
    k, theta = gamma_parameters(F.col("n"), F.col("sx"), F.col("slx"), F.col("sxlx"))
    return sums.select("chr", "pos", "n", "sx", "slx", "sxlx", k.alias("k"), theta.alias("theta"))


def merging_sink(spark: SparkSession, folder: str) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: the counts table below ``folder``, longer events included, merged with each batch.

    Every batch writes a version of its own, so a batch that is run again gives the same version again.
    """

    def merge(batch: DataFrame, number: int) -> None:
        if number:
            batch = batch.unionByName(spark.read.parquet(f"{folder}/version={number - 1}"))
        merge_counts(batch).write.mode("overwrite").parquet(f"{folder}/version={number}")

    return merge


def merged_table(spark: SparkSession, folder: str) -> DataFrame:
    """The last version that merging_sink() has written below ``folder``."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)
    last = max(int(f.getPath().getName().partition("=")[2]) for f in found)
    return spark.read.parquet(f"{folder}/version={last}")


def windowed_counts(events: DataFrame, width: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """(start, event_type, n, total) of a stream of events (ts, event_type, value) by time, closed when none can be late any more."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")
