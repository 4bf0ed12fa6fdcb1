"""Sequence files: FASTA, FASTQ, BAM and GenBank."""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import ArrayType, StructType
from pyspark.sql.window import Window

from helixframe.sources.text_formats import SAM_DDL


def _numbered(spark: SparkSession, path: str, mark: str) -> DataFrame:
    """(file, idx, value): the pieces of text files between marks, numbered from 0 in each file.

    Files are read in blocks by many tasks; pieces are numbered inside of a block and moved on by the earlier blocks' sizes.
    """
    rows = spark.read.text(path, lineSep=mark).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    sizes = rows.groupBy("file", "block").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("file").orderBy("block")
    base = sizes.select("file", "block", F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    inside = Window.partitionBy("file", "block").orderBy("at")
    return rows.withColumn("i", F.row_number().over(inside)).join(base, ["file", "block"]).select("file", (F.col("base") + F.col("i") - 1).alias("idx"), "value")


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(file, idx, name, seq): names are whole header lines; lines of a sequence are trimmed and joined, and it may be empty.

    Text before the first header is an error.
    """
    rows = _numbered(spark, path, "\n>")
    # A separator at the very start isn't one: the first piece has its ">" still.
    bad = F.raise_error(F.concat(F.lit("no header at the start of "), "file")).cast("string")
    value = F.when(F.col("idx") > 0, F.col("value")).when(F.col("value").startswith(">"), F.expr("substring(value, 2)")).otherwise(bad)
    rows = rows.where("idx > 0 or value <> ''").withColumn("value", value)
    body = F.slice(F.split("value", "\n"), 2, F.greatest(F.size(F.split("value", "\n")) - 1, F.lit(0)))
    return rows.select("file", "idx", F.rtrim(F.regexp_replace(F.substring_index("value", "\n", 1), "\r$", "")).alias("name"), F.array_join(F.transform(body, lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), "").alias("seq"))


#: Names that the file of a chromosome may have in a folder, in the order in which they are tried.
GENOME_FILES = ("{0}.fa.gz", "chr{0}.fa.gz", "{0}.fa", "chr{0}.fa")


def read_genome(spark: SparkSession, folder: str, chroms: list[str]) -> DataFrame:
    """(acc, seq) of the first sequence in the file of each chromosome; one without a file is an error."""
    fs_of = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files, found = fs_of.getFileSystem(spark._jsc.hadoopConfiguration()), {}
    for chrom in chroms:
        names = [f"{folder.rstrip('/')}/{n.format(chrom)}" for n in GENOME_FILES]
        found[chrom] = next((n for n in names if files.exists(spark._jvm.org.apache.hadoop.fs.Path(n))), None)
        if found[chrom] is None:
            raise FileNotFoundError(f"no sequence of {chrom} in {folder}")
    each = [read_fasta(spark, path).where("idx = 0").select(F.lit(chrom).alias("acc"), "seq") for chrom, path in found.items()]
    return reduce(DataFrame.unionByName, each)


def write_kmers(counted: DataFrame, path: str) -> None:
    """Counted k-mers (kmer, n) in their order, so that neighbours share most of their letters in the files."""
    counted.repartitionByRange("kmer").sortWithinPartitions("kmer").write.option("compression", "zstd").parquet(path)


def read_fastq(spark: SparkSession, path: str) -> DataFrame:
    """(file, idx, id, seq, id2, qual) of four-line records; one that isn't such a record is an error."""
    lines = _numbered(spark, path, "\n").where("value <> '' or idx % 4 <> 0")
    at = F.col("idx") % 4
    one = lambda i: F.max(F.when(at == i, F.regexp_replace("value", "\r$", "")))
    rows = lines.groupBy("file", F.floor(F.col("idx") / 4).alias("idx")).agg(one(0).alias("a"), one(1).alias("seq"), one(2).alias("b"), one(3).alias("qual"))
    good = F.col("a").startswith("@") & F.col("b").startswith("+") & (F.length("seq") == F.length("qual"))
    bad = F.raise_error(F.concat(F.lit("bad read number "), F.col("idx").cast("string"), F.lit(" in "), "file")).cast("string")
    return rows.select("file", "idx", F.when(F.coalesce(good, F.lit(False)), F.expr("substring(a, 2)")).otherwise(bad).alias("id"), "seq", F.expr("substring(b, 2)").alias("id2"), "qual")


def read_pairs(spark: SparkSession, first: str, second: str) -> DataFrame:
    """(idx, mate1, mate2) of two FASTQ files read side by side; files of unequal length are an error."""
    from helixframe.operators.tables import zipped

    each = [read_fastq(spark, p).select("idx", F.struct("id", "seq", "id2", "qual").alias(f"mate{i}")) for i, p in enumerate((first, second), 1)]
    return zipped(each[0], each[1], "idx")


def write_fastq(reads: DataFrame, path: str, *by: str, compression: str = "gzip") -> None:
    """Write reads (id, seq, id2, qual), in folders by the columns ``by``."""
    text = F.concat(F.lit("@"), "id", F.lit("\n"), "seq", F.lit("\n+"), F.coalesce("id2", F.lit("")), F.lit("\n"), "qual")
    out = reads.select(*by, text.alias("value")).write.option("compression", compression)
    (out.partitionBy(*by) if by else out).text(path)


#: Letters of packed bases and operations of packed CIGARs, by their codes (fixed values).
BAM_BASES, BAM_OPS = "=ACMGRSVTWYHKDBN", "MIDNSHP=X"


def _members(f) -> Iterator[bytes]:
    z, data = zlib.decompressobj(31), f.read(1 << 20)
    while data:
        yield z.decompress(data)
        if z.eof:
            data, z = z.unused_data or f.read(1 << 20), zlib.decompressobj(31)
        else:
            data = f.read(1 << 20)


class _Bytes:
    def __init__(self, parts: Iterator[bytes]):
        self.parts, self.held = parts, bytearray()

    def take(self, n: int) -> bytes | None:
        while len(self.held) < n:
            more = next(self.parts, None)
            if more is None:
                if self.held:
                    raise ValueError("alignment file ends inside a record")
                return None
            self.held.extend(more)
        out = bytes(self.held[:n])
        del self.held[:n]
        return out

    def number(self) -> int | None:
        raw = self.take(4)
        return None if raw is None else struct.unpack("<i", raw)[0]


def bam_records(f) -> Iterator[tuple]:
    """Rows of SAM_DDL from an open BAM file, one at a time; positions from 1, "*" for no reference."""
    src = _Bytes(_members(f))
    if src.take(4) != b"BAM\1":
        raise ValueError("not an alignment file")
    src.take(src.number())
    names = []
    for _ in range(src.number()):
        names.append(src.take(src.number())[:-1].decode())
        src.number()
    name_of = lambda i: names[i] if i >= 0 else "*"
    while (size := src.number()) is not None:
        raw = src.take(size)
        ref, pos, l_name, mapq, _, n_ops, flags, n_bases, mate, mate_pos, tlen = struct.unpack_from("<iiBBHHHiiii", raw)
        at = 32
        name = raw[at : at + l_name - 1].decode()
        at += l_name
        ops = struct.unpack_from(f"<{n_ops}I", raw, at)
        at += 4 * n_ops
        seq = "".join(BAM_BASES[b >> 4] + BAM_BASES[b & 15] for b in raw[at : at + (n_bases + 1) // 2])[:n_bases]
        at += (n_bases + 1) // 2
        qual = raw[at : at + n_bases]
        cigar = "".join(f"{x >> 4}{BAM_OPS[x & 15]}" for x in ops)
        yield name, flags, name_of(ref), pos + 1, mapq, cigar or "*", name_of(mate), mate_pos + 1, tlen, seq or "*", "*" if not qual or qual[0] == 255 else "".join(chr(q + 33) for q in qual)


class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _BamReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[_File]:
        from pyarrow import fs

        files, at = fs.FileSystem.from_uri(self.path if "://" in self.path else f"file://{self.path}")
        root = self.path[: len(self.path) - len(at)] if self.path.endswith(at) else ""
        found = files.get_file_info(at)
        if found.type == fs.FileType.Directory:
            return [_File(root + x.path) for x in files.get_file_info(fs.FileSelector(at)) if x.path.endswith(".bam")]
        return [_File(self.path)]

    def read(self, part: _File) -> Iterator[tuple]:
        from pyarrow import fs

        files, at = fs.FileSystem.from_uri(part.path if "://" in part.path else f"file://{part.path}")
        with files.open_input_stream(at, compression=None) as f:
            yield from bam_records(f)


class Bam(DataSource):
    """spark.read.format("bam").load(path): a partition to each file, read as a stream."""

    @classmethod
    def name(cls) -> str:
        return "bam"

    def schema(self) -> str:
        return SAM_DDL

    def reader(self, schema) -> DataSourceReader:
        return _BamReader(self.options["path"])


def read_bam(spark: SparkSession, path: str) -> DataFrame:
    spark.dataSource.register(Bam)
    return spark.read.format("bam").load(path)


GENBANK_DDL = "entries array<struct<name:string,value:string,sub_entries:array<struct<key:string,value:string>>>>, features array<struct<type:string,location:string,qualifiers:array<struct<key:string,value:string>>>>, sequence string"


def genbank_record(text: str) -> dict:
    """Entries, features and sequence of one record of a flat file, told apart by how far their lines are indented."""
    entries: list[dict] = []
    features: list[dict] = []
    sequence: list[str] = []
    part = "entries"
    for line in text.split("\n"):
        line = line.rstrip()
        if not line:
            continue
        blank = len(line) - len(line.lstrip(" "))
        if blank == 0:
            name, _, value = line.partition(" ")
            part = {"FEATURES": "features", "ORIGIN": "sequence"}.get(name, "entries")
            if part == "entries":
                entries.append({"name": name, "value": value.strip(), "sub_entries": []})
        elif part == "sequence":
            sequence.append(re.sub(r"[\s\d]", "", line))
        elif part == "features":
            body = line.strip()
            if blank < 21:
                kind, _, location = body.partition(" ")
                features.append({"type": kind, "location": location.strip(), "qualifiers": []})
            elif body.startswith("/"):
                key, _, value = body[1:].partition("=")
                features[-1]["qualifiers"].append({"key": key, "value": value})
            elif features[-1]["qualifiers"]:
                last = features[-1]["qualifiers"][-1]
                last["value"] += ("" if last["key"] == "translation" else " ") + body
            else:
                features[-1]["location"] += body
        elif blank < 12:
            key, _, value = line.strip().partition(" ")
            entries[-1]["sub_entries"].append({"key": key, "value": value.strip()})
        else:
            at = entries[-1]["sub_entries"][-1] if entries[-1]["sub_entries"] else entries[-1]
            at["value"] += "\n" + line.strip()
    for f in features:
        for q in f["qualifiers"]:
            if len(q["value"]) > 1 and q["value"][0] == q["value"][-1] == '"':
                q["value"] = q["value"][1:-1].replace('""', '"')
    return {"entries": entries, "features": features, "sequence": "".join(sequence)}


def read_genbank(spark: SparkSession, path: str) -> DataFrame:
    """Records of GenBank flat files; a file is divided at the ends of its records."""

    record = F.udf(genbank_record, StructType.fromDDL(GENBANK_DDL), useArrow=True)
    rows = spark.read.text(path, lineSep="\n//").where(F.trim(F.regexp_replace("value", r"\s", "")) != "")
    return rows.select(record(F.regexp_replace("value", "^\\s*\n", "")).alias("r")).select("r.*")


#: One or two positions of a location; partial ends are marked with < and >.
LOCATION = re.compile(r"(?P<wrap>complement|join|order)\(|(?P<pos>[<>]?\d+(?:\.\.[<>]?\d+|\^\d+)?)|(?P<comma>,)|(?P<close>\))")


def location_ranges(text: str) -> list[tuple[int, int, str]]:
    """(first, last, strand) of the ranges of a location, in its order."""
    out: list[tuple[int, int, str]] = []
    stack: list[tuple[str, int]] = []
    for m in LOCATION.finditer(re.sub(r"\s", "", text)):
        if m["wrap"]:
            stack.append((m["wrap"], len(out)))
        elif m["pos"]:
            ends = [int(x) for x in re.findall(r"\d+", m["pos"])]
            out.append((ends[0], ends[-1], "+"))
        elif m["close"] and stack:
            kind, start = stack.pop()
            if kind == "complement":
                out[start:] = [(a, b, "-" if s == "+" else "+") for a, b, s in reversed(out[start:])]
    return out


def _ranges(location: str | None) -> list[tuple[int, int, str]] | None:
    return None if location is None else location_ranges(location)


def ranges_of(location: Column) -> Column:
    """array<struct<first, last, strand>> of a feature's location."""
    return F.udf(_ranges, ArrayType(StructType.fromDDL("first long, last long, strand string")), useArrow=True)(location)


def feature_table(records: DataFrame) -> DataFrame:
    """(accession, type, first, last, strand, qualifiers): a row to each range of each feature."""
    acc: Column = F.get(F.filter("entries", lambda e: e["name"] == "ACCESSION"), F.lit(0))["value"]
    each = records.select(F.substring_index(acc, " ", 1).alias("accession"), F.explode("features").alias("f"))
    return each.select("accession", "f.type", F.explode(ranges_of(F.col("f.location"))).alias("r"), "f.qualifiers").select("accession", "type", "r.first", "r.last", "r.strand", "qualifiers")
