import gzip
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from helixframe.sources import sequences as seqs, text_formats as tf


def write(tmp_path, name, content):
    path = tmp_path / name
    (gzip.open(path, "wt") if name.endswith(".gz") else open(path, "w")).write(content)
    return str(path)


def test_tsv_and_bed(spark, tmp_path):
    path = write(tmp_path, "a.tsv.gz", "# comment\nchr\tpos\tkld\tpval\n1\t5\t0.25\t1e-300\nX\t6\t0\t1\n")
    df = tf.read_tsv(spark, path, tf.SCORES_DDL)
    assert sorted(map(tuple, df.collect())) == [("1", 5, 0.25, 1e-300), ("X", 6, 0.0, 1.0)]
    out = str(tmp_path / "out.gz")
    tf.write_tsv(df, out)
    assert sorted(map(tuple, tf.read_tsv(spark, out, tf.SCORES_DDL).collect())) == sorted(map(tuple, df.collect()))
    bed = write(tmp_path, "r.bed", "chr1\t1\t9\tg1\nchr2\t2\t4\tg2\n")
    assert [tuple(r) for r in tf.read_bed(spark, bed).orderBy("chr").collect()] == [("chr1", 1, 9, "g1"), ("chr2", 2, 4, "g2")]
    typed = write(tmp_path, "t.tsv", "a\tb\n1\tx=1;y=2\n")
    row = tf.read_typed(spark, typed, {"a": "int", "b": "[str=uint]"}).first()
    assert row.a == 1 and [tuple(x) for x in row.b] == [("x", 1), ("y", 2)]


def test_sam_and_gff(spark, tmp_path):
    sam = write(tmp_path, "a.sam", "@HD\tVN:1\nr1\t99\t18\t29769796\t60\t27M1I47M\t=\t29769954\t250\tACGT\tIIII\tNM:i:1\n")
    row = tf.read_sam(spark, sam).first()
    assert (row.name, row.flags, row.chr, row.pos, row.cigar, row.tlen) == ("r1", 99, "18", 29769796, "27M1I47M", 250)
    gff = write(tmp_path, "a.gff3", "##gff\n1\ts\tgene\t5\t9\t.\t+\t.\tID=g;Note=a=b\n1\ts\texon\t5\t7\t.\t+\t.\tID=e;Parent=t1,t2\n")
    rows = tf.gff3_features(tf.read_gff3(spark, gff)).collect()
    assert sorted((r.id, r.parent) for r in rows if r.parent) == [("e", "t1"), ("e", "t2")] and len(rows) == 3
    assert [tuple(x) for x in tf.read_gff3(spark, gff).where("type = 'gene'").first().attributes] == [("ID", "g"), ("Note", "a=b")]
    with pytest.raises(Exception, match="not a feature"):
        tf.read_gff3(spark, write(tmp_path, "b.gff3", "1\ts\tgene\n")).collect()


VCF = "##fileformat=VCFv4.2\n##ALT=<ID=NON_REF,Description=\"Any, =allele\">\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tS1\tS2\n1\t5\t.\tA\tC\t.\tPASS\tAC=3;DB;AF=0.5=x\tGT:AD\t0/1:3,4\t0/0:1,0\nbad\t1\n2\t6\trs1\tG\tT\t12.5\tq10\tDP=1\n"


def test_vcf(spark, tmp_path):
    path = write(tmp_path, "a.vcf", VCF)
    a, b = tf.read_vcf(spark, path).orderBy("chr").collect()
    assert a.qual is None and [tuple(x) for x in a.info] == [("AC", "3"), ("AF", "0.5=x")]
    assert [[tuple(x) for x in g] for g in a.genotypes] == [[("GT", "0/1"), ("AD", "3,4")], [("GT", "0/0"), ("AD", "1,0")]] and b.qual == 12.5 and b.genotypes == []
    assert tf.bad_vcf_lines(spark, path).count() == 1
    meta = {r.kind: r for r in tf.vcf_meta(spark.read.text(path)).collect()}
    assert meta["fileformat"].value == "VCFv4.2" and [tuple(x) for x in meta["ALT"].kvs] == [("ID", "NON_REF"), ("Description", "Any, =allele")]
    out = str(tmp_path / "out.vcf")
    tf.write_vcf(tf.read_vcf(spark, path).where("chr = '1'"), out, ["S1", "S2"], ["source=x"])
    back = tf.read_vcf(spark, out).first()
    assert back.genotypes == a.genotypes and back.info == a.info
    with pytest.raises(Exception, match="does not match"):
        tf.read_vcf(spark, write(tmp_path, "b.vcf", "1\t5\t.\tA\tC\t.\tPASS\tA=1\tGT:AD\t0/1\n")).collect()


def test_fasta_and_fastq(spark, tmp_path):
    fa = write(tmp_path, "a.fa", ">foo x>y\n" + "ACGT " * 3 + "\nAC\r\n>bar\n>qux\nGG\n\n")
    rows = seqs.read_fasta(spark, fa).orderBy("idx").collect()
    assert [(r.idx, r.name, r.seq) for r in rows] == [(0, "foo x>y", "ACGT ACGT ACGTAC"), (1, "bar", ""), (2, "qux", "GG")]
    with pytest.raises(Exception, match="no header"):
        seqs.read_fasta(spark, write(tmp_path, "b.fa", "ACGT\n>x\nA\n")).collect()
    text = "".join(f"@r{i}\nACGT{'A' * (i % 3)}\n+r{i}\n@III{'I' * (i % 3)}\n" for i in range(500))
    fq, gz = write(tmp_path, "a.fastq", text), write(tmp_path, "b.fastq.gz", text)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2k")
    try:
        for path in (fq, gz):
            got = seqs.read_fastq(spark, path).orderBy("idx").collect()
            assert [r.id for r in got] == [f"r{i}" for i in range(500)] and got[4].qual == "@IIII" and got[4].id2 == "r4"
        pair = seqs.read_pairs(spark, fq, gz)
        assert pair.count() == 500 and pair.where("mate1.id <> mate2.id").isEmpty()
        with pytest.raises(Exception, match="unequal"):
            seqs.read_pairs(spark, fq, write(tmp_path, "c.fastq", text[: text.index("@r499")])).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    with pytest.raises(Exception, match="bad read"):
        seqs.read_fastq(spark, write(tmp_path, "d.fastq", "@a\nAC\n+\nI\n")).collect()
    out = str(tmp_path / "parts")
    seqs.write_fastq(seqs.read_fastq(spark, fq).withColumn("part", F.col("idx") % 3), out, "part")
    assert seqs.read_fastq(spark, out + "/part=0").count() == 167


def bam_bytes():
    def record(name, ref, pos, flags, cigar, seq, qual):
        ops = b"".join(struct.pack("<I", n << 4 | seqs.BAM_OPS.index(o)) for n, o in cigar)
        codes = [seqs.BAM_BASES.index(c) for c in seq] + [0]
        packed = bytes(codes[i] << 4 | codes[i + 1] for i in range(0, len(seq), 2))
        body = struct.pack("<iiBBHHHiiii", ref, pos, len(name) + 1, 60, 0, len(cigar), flags, len(seq), -1, -1, 7) + name.encode() + b"\0" + ops + packed + bytes(qual)
        return struct.pack("<i", len(body)) + body

    head = b"BAM\1" + struct.pack("<i", 3) + b"@HD" + struct.pack("<i", 1) + struct.pack("<i", 5) + b"chr7\0" + struct.pack("<i", 1000)
    parts = [head, record("r1", 0, 99, 16, [(3, "M"), (1, "I")], "ACGTN"[:4], [30] * 4), record("r2", -1, -1, 4, [], "ACG", [255] * 3)]
    out = b""
    whole = b"".join(parts)
    for i in range(0, len(whole), 50):
        z = zlib.compressobj(6, zlib.DEFLATED, 31)
        out += z.compress(whole[i : i + 50]) + z.flush()
    return out


def test_bam(spark, tmp_path):
    (tmp_path / "a.bam").write_bytes(bam_bytes())
    got = sorted(tuple(r) for r in seqs.read_bam(spark, str(tmp_path / "a.bam")).collect())
    assert got == [("r1", 16, "chr7", 100, 60, "3M1I", "*", 0, 7, "ACGT", "????"), ("r2", 4, "*", 0, 60, "*", "*", 0, 7, "ACG", "*")]


GENBANK = """LOCUS       AB_1 20 bp
DEFINITION  First line
            second line.
ACCESSION   AB_1 OTHER
SOURCE      Some virus
  ORGANISM  Some virus
            Viruses; More.
FEATURES             Location/Qualifiers
     source          1..20
                     /organism="Some
                     virus"
     CDS             complement(join(2..5,
                     8..10))
                     /pseudo
                     /translation="MK
                     LV"
ORIGIN
        1 acgtacgtac gtacgtacgt
//
LOCUS       AB_2 4 bp
ACCESSION   AB_2
FEATURES             Location/Qualifiers
     gene            <1..>4
ORIGIN
        1 acgt
//
"""


def test_genbank(spark, tmp_path):
    df = seqs.read_genbank(spark, write(tmp_path, "a.gbk", GENBANK))
    a, b = sorted(df.collect(), key=lambda r: -len(r.sequence))
    assert a.sequence == "acgtacgtacgtacgtacgt" and b.sequence == "acgt"
    assert a.entries[1].value == "First line\nsecond line." and a.entries[3].sub_entries[0].key == "ORGANISM"
    assert a.features[0].qualifiers[0].value == "Some virus" and a.features[1].qualifiers[1].value == "MKLV" and a.features[1].qualifiers[0].key == "pseudo"
    rows = sorted((r.accession, r.type, r.first, r["last"], r.strand) for r in seqs.feature_table(df).collect())
    assert rows == [("AB_1", "CDS", 2, 5, "-"), ("AB_1", "CDS", 8, 10, "-"), ("AB_1", "source", 1, 20, "+"), ("AB_2", "gene", 1, 4, "+")]


def test_small_files(spark, tmp_path):
    t = write(tmp_path, "t.json", '[{"accession": "NM_1", "chr": "1", "strand": "+", "txStart": 1, "txEnd": 9, "cdsStart": 2, "cdsEnd": 8, "exons": [[1, 4], [6, 9]]}]')
    assert [tuple(e) for e in tf.read_transcripts(spark, t).first().exons] == [(1, 4), (6, 9)]
    listing = write(tmp_path, "list.txt", "a.fa\n/abs/b.fa\n\n")
    assert tf.read_paths(spark, listing) == [f"{tmp_path}/a.fa", "/abs/b.fa"]
    assert tf.read_sizes(spark, write(tmp_path, "g.json", '{"b": 1,\n "a": 2}')) == {"a": 2, "b": 1}
    ref = write(tmp_path, "ref.tsv", "#bin\tname\n1\tNM_1\tchr1\t+\t1\t9\t2\t8\t2\t1,6,\t4,9,\t0\tG\tc\tc\t0,1,\n")
    assert [tuple(e) for e in tf.read_refgene(spark, ref).first().exons] == [(1, 4), (6, 9)]


def test_genome_folder_and_kmer_files(spark, tmp_path):
    write(tmp_path, "chr1.fa", ">1\nACGT\n>other\nG\n")
    write(tmp_path, "X.fa.gz", ">X\nGG\n")
    assert sorted(map(tuple, seqs.read_genome(spark, str(tmp_path), ["1", "X"]).collect())) == [("1", "ACGT"), ("X", "GG")]
    with pytest.raises(FileNotFoundError):
        seqs.read_genome(spark, str(tmp_path), ["7"])
    df = spark.createDataFrame([("CC", 2), ("AA", 1)], "kmer string, n long")
    seqs.write_kmers(df, f"{tmp_path}/kmers")
    assert [r.kmer for r in spark.read.parquet(f"{tmp_path}/kmers").orderBy("kmer").collect()] == ["AA", "CC"]
