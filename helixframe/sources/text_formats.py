"""Readers and writers of line-based formats. Compressed files (.gz and the like) are read as they are."""

from __future__ import annotations

import json
from pathlib import PurePosixPath

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from helixframe.functions.text import pairs, pairs_text, typed, untyped

COUNTS_DDL = "chr string, pos bigint, nA bigint, nC bigint, nG bigint, nT bigint, nN bigint, nX0 bigint, nX1 bigint, nI bigint, nD bigint, indels string"
SCORES_DDL = "chr string, pos bigint, kld double, pval double"
GAMMA_DDL = "chr string, pos bigint, n bigint, sx double, slx double, sxlx double, k double, theta double"
GENES_DDL = "gene string, len bigint, cnt bigint"
REFGENE_DDL = "bin int, name string, chrom string, strand string, txStart bigint, txEnd bigint, cdsStart bigint, cdsEnd bigint, exonCount int, exonStarts string, exonEnds string, score int, name2 string, cdsStartStat string, cdsEndStat string, exonFrames string"
SAM_DDL = "name string, flags int, chr string, pos bigint, mapq int, cigar string, mate_chr string, mate_pos bigint, tlen int, seq string, qual string"


def read_tsv(spark: SparkSession, path: str, schema: str | StructType, header: bool = True) -> DataFrame:
    """Tab-separated rows; lines that begin with "#" are skipped, and the header is not interpreted. Missing text is empty."""
    found = spark.read.csv(path, schema=schema, sep="\t", comment="#", header=header, enforceSchema=True, quote="", emptyValue="", nullValue="\0")
    return found.select(*(F.coalesce(F.col(c), F.lit("")).alias(c) if t == "string" else F.col(c) for c, t in found.dtypes))


def read_typed(spark: SparkSession, path: str, types: dict[str, str], header: bool = True) -> DataFrame:
    """Tab-separated rows with columns of named types; see functions.text.TYPES."""
    return typed(read_tsv(spark, path, ", ".join(f"`{c}` string" for c in types), header), types)


def write_tsv(df: DataFrame, path: str, types: dict[str, str] | None = None, header: bool = True) -> None:
    """Tab-separated rows with all digits of numbers; a .gz suffix compresses them."""
    out = untyped(df, types) if types else df
    out.write.csv(path, sep="\t", header=header, quote="", emptyValue="", compression="gzip" if path.endswith(".gz") else "none")


def read_bed(spark: SparkSession, path: str) -> DataFrame:
    """(chr, start, end, gene); gene is empty in files of three columns. There is no header."""
    return read_tsv(spark, path, "chr string, start bigint, end bigint, gene string", header=False)


def read_refgene(spark: SparkSession, path: str) -> DataFrame:
    """Gene table rows, with exons as array<struct<first, last>>."""
    numbers = lambda c: F.transform(F.filter(F.split(c, ","), lambda x: x != ""), lambda x: x.cast("long"))
    # The header begins with "#".
    rows = read_tsv(spark, path, REFGENE_DDL, header=False)
    return rows.withColumn("exons", F.zip_with(numbers(F.col("exonStarts")), numbers(F.col("exonEnds")), lambda a, b: F.struct(a.alias("first"), b.alias("last"))))


def read_sam(spark: SparkSession, path: str) -> DataFrame:
    """Alignment text: header lines are skipped, optional fields ignored."""
    f = F.split("value", "\t")
    lines = spark.read.text(path).where(~F.col("value").startswith("@") & (F.col("value") != ""))
    kinds = [x.rsplit(" ", 1) for x in SAM_DDL.split(", ")]
    return lines.select(*(f[i].cast(t).alias(c) for i, (c, t) in enumerate(kinds)))


def read_gff3(spark: SparkSession, path: str) -> DataFrame:
    """Features, attributes in order; a line of other than eight or nine columns is an error."""
    lines = spark.read.text(path).where(~F.col("value").startswith("#") & (F.col("value") != ""))
    f = F.split("value", "\t")
    bad = F.raise_error(F.concat(F.lit("not a feature: "), "value")).cast("array<string>")
    rows = lines.select(F.when(F.size(f).isin(8, 9), f).otherwise(bad).alias("f"))
    c = lambda i: F.col("f")[i]
    return rows.select(c(0).alias("seqid"), c(1).alias("source"), c(2).alias("type"), c(3).cast("long").alias("start1"), c(4).cast("long").alias("end1"), c(5).alias("score"), c(6).alias("strand"), c(7).alias("phase"), pairs(F.coalesce(F.get("f", F.lit(8)), F.lit(""))).alias("attributes"))


def attribute(attributes: Column, key: str) -> Column:
    return F.get(F.filter(attributes, lambda x: x["key"] == key), F.lit(0))["value"]


def gff3_features(gff: DataFrame) -> DataFrame:
    """(id, parent, type, chr, start, end): a row per parent, start and end as they stand."""
    parents = F.split(attribute(F.col("attributes"), "Parent"), ",")
    return gff.select(F.coalesce(attribute(F.col("attributes"), "ID"), F.concat_ws(":", "seqid", F.col("start1").cast("string"), F.col("end1").cast("string"))).alias("id"), F.explode_outer(parents).alias("parent"), "type", F.col("seqid").alias("chr"), F.col("start1").alias("start"), F.col("end1").alias("end"))


def info(text: Column) -> Column:
    """INFO as ordered pairs; flags without a value are left out."""
    return pairs(text, ";", lone=False)


def genotypes(form: Column, samples: Column) -> Column:
    """For each sample the pairs of FORMAT's keys and its values; another number of values is an error."""
    keys = F.split(form, ":")

    def one(s: Column) -> Column:
        values = F.split(s, ":")
        bad = F.raise_error(F.concat(F.lit("sample does not match its format: "), s)).cast("array<struct<key:string,value:string>>")
        return F.when(F.size(values) == F.size(keys), F.zip_with(keys, values, lambda k, v: F.struct(k.alias("key"), v.alias("value")))).otherwise(bad)

    return F.transform(samples, one)


def read_vcf(spark: SparkSession, path: str) -> DataFrame:
    """Records; qual is null for ".", info and genotypes are parsed only where they are used. Lines of fewer than eight columns are left out."""
    lines = spark.read.text(path).where(~F.col("value").startswith("#"))
    f = F.split("value", "\t")
    rows = lines.select(f.alias("f")).where(F.size("f") >= 8)
    c = lambda i: F.col("f")[i]
    none = F.array().cast("array<array<struct<key:string,value:string>>>")
    calls = F.when(F.size("f") > 9, genotypes(F.get("f", F.lit(8)), F.slice("f", 10, F.greatest(F.size("f") - 9, F.lit(0))))).otherwise(none)
    return rows.select(c(0).alias("chr"), c(1).cast("long").alias("pos"), c(2).alias("id"), c(3).alias("ref"), c(4).alias("alt"), c(5).try_cast("double").alias("qual"), c(6).alias("filter"), info(c(7)).alias("info"), calls.alias("genotypes"))


def bad_vcf_lines(spark: SparkSession, path: str) -> DataFrame:
    """The lines that read_vcf() leaves out."""
    return spark.read.text(path).where(~F.col("value").startswith("#") & (F.col("value") != "") & (F.size(F.split("value", "\t")) < 8))


def vcf_meta(lines: DataFrame) -> DataFrame:
    """(kind, value, kvs) of the "##" lines of ``lines`` (value): pairs of "<...>" without their quotes, else the value."""
    body = F.expr("substring(value, 3)")
    kind, rest = F.substring_index(body, "=", 1), F.expr("substring(value, instr(value, '=') + 1)")
    piece = r'([^=,<>]+)=("[^"\\]*+(?:\\.[^"\\]*+)*+"|[^,>]*)'
    keys, values = (F.regexp_extract_all(F.expr("substring(rest, 2, length(rest) - 2)"), F.lit(piece), F.lit(i)) for i in (1, 2))
    plain = lambda v: F.regexp_replace(v, '^"(.*)"$', "$1")
    kvs = F.zip_with(keys, values, lambda k, v: F.struct(k.alias("key"), plain(v).alias("value")))
    shaped = F.col("rest").rlike("^<.*>$")
    meta = lines.where(F.col("value").startswith("##")).select(kind.alias("kind"), rest.alias("rest"))
    return meta.select("kind", F.when(~shaped, F.col("rest")).alias("value"), F.when(shaped, kvs).alias("kvs"))


def write_vcf(records: DataFrame, path: str, samples: list[str] = (), meta: list[str] = ()) -> None:
    """Write records (as read_vcf() gives them, in their order) as one file with its header."""
    sample_text = lambda g: F.array_join(F.transform(g, lambda x: x["value"]), ":")
    columns = [F.col("chr"), F.col("pos").cast("string"), F.col("id"), F.col("ref"), F.col("alt"), F.coalesce(F.col("qual").cast("string"), F.lit(".")), F.col("filter"), pairs_text(F.col("info"))]
    if samples:
        form = F.array_join(F.transform(F.get("genotypes", F.lit(0)), lambda x: x["key"]), ":")
        columns += [form, F.array_join(F.transform("genotypes", sample_text), "\t")]
    heading = ["##fileformat=VCFv4.2", *(f"##{m}" for m in meta), "\t".join(["#CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", *(["FORMAT", *samples] if samples else [])])]
    spark = records.sparkSession
    head = spark.createDataFrame([(i, x) for i, x in enumerate(heading)], "o long, value string")
    body = records.select(F.concat_ws("\t", *columns).alias("value")).withColumn("o", F.monotonically_increasing_id() + len(heading))
    head.unionByName(body.select("o", "value")).coalesce(1).sortWithinPartitions("o").select("value").write.text(path)


def read_transcripts(spark: SparkSession, path: str) -> DataFrame:
    """Transcripts from a JSON list, with exons as array<struct<first, last>>."""
    rows = spark.read.json(path, multiLine=True, schema="accession string, chr string, gene string, strand string, txStart bigint, txEnd bigint, cdsStart bigint, cdsEnd bigint, exons array<array<bigint>>")
    return rows.withColumn("exons", F.transform("exons", lambda e: F.struct(e[0].alias("first"), e[1].alias("last"))))


def read_paths(spark: SparkSession, path: str) -> list[str]:
    """The paths that a list file names, a line each, below the list's own folder."""
    folder = path.rsplit("/", 1)[0]
    names = [r["value"].strip() for r in spark.read.text(path).collect()]
    return [x if PurePosixPath(x).is_absolute() or "://" in x else f"{folder}/{x}" for x in names if x]


def read_sizes(spark: SparkSession, path: str) -> dict[str, int]:
    """Sequence lengths from a JSON object, for functions.chrom.genome_map()."""
    return json.loads("\n".join(r["value"] for r in spark.read.text(path, wholetext=True).collect()))
