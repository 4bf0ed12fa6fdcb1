"""Chromosome names: order, equality and the linear genome axis."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Lengths of the sequences of a human assembly, and of the primary chromosomes of a later one, whose hundreds of
#: alternative sequences come as a table of sizes (fixed values).
HG19 = dict(
    chr1=249250621, chr2=243199373, chr3=198022430, chr4=191154276, chr5=180915260, chr6=171115067, chr7=159138663, chr8=146364022,
    chr9=141213431, chr10=135534747, chr11=135006516, chr12=133851895, chr13=115169878, chr14=107349540, chr15=102531392, chr16=90354753,
    chr17=81195210, chr18=78077248, chr19=59128983, chr20=63025520, chr21=48129895, chr22=51304566, chrX=155270560, chrY=59373566, chrM=16571,
    chr4_ctg9_hap1=590426, chr6_apd_hap1=4622290, chr6_cox_hap2=4795371, chr6_dbb_hap3=4610396, chr6_mann_hap4=4683263, chr6_mcf_hap5=4833398,
    chr6_qbl_hap6=4611984, chr6_ssto_hap7=4928567, chr17_ctg5_hap1=1680828, chr1_gl000191_random=106433, chr1_gl000192_random=547496,
    chr4_gl000193_random=189789, chr4_gl000194_random=191469, chr7_gl000195_random=182896, chr8_gl000196_random=38914, chr8_gl000197_random=37175,
    chr9_gl000198_random=90085, chr9_gl000199_random=169874, chr9_gl000200_random=187035, chr9_gl000201_random=36148, chr11_gl000202_random=40103,
    chr17_gl000203_random=37498, chr17_gl000204_random=81310, chr17_gl000205_random=174588, chr17_gl000206_random=41001, chr18_gl000207_random=4262,
    chr19_gl000208_random=92689, chr19_gl000209_random=159169, chr21_gl000210_random=27682, chrUn_gl000211=166566, chrUn_gl000212=186858,
    chrUn_gl000213=164239, chrUn_gl000216=172294, chrUn_gl000217=172149, chrUn_gl000218=161147, chrUn_gl000219=179198, chrUn_gl000220=161802,
    chrUn_gl000221=155397, chrUn_gl000222=186861, chrUn_gl000223=180455, chrUn_gl000224=179693, chrUn_gl000225=211173, chrUn_gl000226=15008,
    chrUn_gl000227=128374, chrUn_gl000228=129120, chrUn_gl000229=19913, chrUn_gl000230=43691, chrUn_gl000231=27386, chrUn_gl000232=40652,
    chrUn_gl000233=45941, chrUn_gl000234=40531, chrUn_gl000235=34474, chrUn_gl000236=41934, chrUn_gl000237=45867, chrUn_gl000238=39939,
    chrUn_gl000239=33824, chrUn_gl000240=41933, chrUn_gl000241=42152, chrUn_gl000242=43523, chrUn_gl000243=43341, chrUn_gl000244=39929,
    chrUn_gl000245=36651, chrUn_gl000246=38154, chrUn_gl000247=36422, chrUn_gl000248=39786, chrUn_gl000249=38502,
)
HG38 = dict(
    chr1=248956422, chr2=242193529, chr3=198295559, chr4=190214555, chr5=181538259, chr6=170805979, chr7=159345973, chr8=145138636,
    chr9=138394717, chr10=133797422, chr11=135086622, chr12=133275309, chr13=114364328, chr14=107043718, chr15=101991189, chr16=90338345,
    chr17=83257441, chr18=80373285, chr19=58617616, chr20=64444167, chr21=46709983, chr22=50818468, chrX=156040895, chrY=57227415, chrM=16569,
)
#: A genome with more sequences than this is joined by shuffle, not broadcast.
BROADCAST_SEQUENCES = 100_000


def chr_ord(chrom: Column) -> Column:
    """1 to 22, X as 23 and Y as 24, with or without "chr"; null for any other name."""
    name = F.regexp_extract(chrom, "^(?:chr)?([1-9]|1[0-9]|2[0-2]|X|Y)$", 1)
    return F.when(name == "X", 23).when(name == "Y", 24).when(name != "", name.try_cast("int"))


def chr_key(chrom: Column) -> Column:
    """What names of one chromosome have in common: "1" and "chr1" share a key, unknown names keep their own."""
    return F.coalesce(chr_ord(chrom).cast("string"), F.concat(F.lit("raw:"), chrom))


def locus_order(chrom: str = "chr", pos: str = "pos") -> list[Column]:
    """Sort order of loci: known chromosomes by number, then unknown ones by name, then position."""
    return [chr_ord(F.col(chrom)).asc_nulls_last(), F.col(chrom), F.col(pos)]


def genome_map(spark: SparkSession, sizes: dict[str, int] | str) -> DataFrame:
    """(chrom, size, start) of a genome given as sizes or as the text of a JSON object; starts run in order of the names."""
    if isinstance(sizes, str):
        sizes = json.loads(sizes)
    rows, start = [], 0
    for chrom in sorted(sizes):
        rows.append((chrom, sizes[chrom], start))
        start += sizes[chrom]
    found = spark.createDataFrame(rows, "chrom string, size long, start long")
    return F.broadcast(found) if len(rows) <= BROADCAST_SEQUENCES else found


def to_linear(loci: DataFrame, genome: DataFrame, chrom: str = "chr", pos: str = "pos", *, missing: str = "error") -> DataFrame:
    """``loci`` with linear, the position on the genome's one axis.

    A locus on a sequence that the genome lacks is an error; with ``missing`` "null" it has no linear position, with
    "drop" it goes.
    """
    if missing not in ("error", "null", "drop"):
        raise ValueError(f"missing must be error, null or drop, not {missing}")
    g = genome.select(F.col("chrom").alias("__chrom"), F.col("start").alias("__start"))
    linear = F.col("__start") + F.col(pos)
    if missing == "error":
        unknown = F.raise_error(F.concat(F.lit("no such sequence: "), F.coalesce(F.col(chrom), F.lit("null")))).cast("long")
        linear = F.when(F.col("__start").isNull(), unknown).otherwise(linear)
    met = loci.join(g, F.col(chrom) == F.col("__chrom"), "inner" if missing == "drop" else "left")
    return met.withColumn("linear", linear).drop("__chrom", "__start")


def from_linear(points: DataFrame, genome: DataFrame, linear: str = "linear") -> DataFrame:
    """``points`` with chr and pos, also for the last sequence; points off the axis are dropped.

    The sequences' starts become one ordered array, in which every point finds its own without a join per sequence.
    """
    ends = genome.agg(F.array_sort(F.collect_list(F.struct("start", "size", "chrom"))).alias("__g"))
    at = F.get(F.filter("__g", lambda g: (g["start"] <= F.col(linear)) & (F.col(linear) < g["start"] + g["size"])), F.lit(0))
    found = points.crossJoin(F.broadcast(ends)).withColumn("__at", at)
    return found.where("__at is not null").withColumns({"chr": F.col("__at.chrom"), "pos": F.col(linear) - F.col("__at.start")}).drop("__g", "__at")
