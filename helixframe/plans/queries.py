"""The library's operators as queries over the views of plans.fixtures."""

from __future__ import annotations

import inspect
import sys
import tempfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from helixframe.functions import alignment, chrom, coding, kmers, registry, stats, text, variants
from helixframe.operators import counts, features, intervals, reads, tables
from helixframe.plans.fixtures import view
from helixframe.sources import sequences, text_formats
from helixframe.streaming import incremental

Query = Callable[[SparkSession, str], DataFrame]


def _whole(spark: SparkSession, sf: str) -> DataFrame:
    return counts.merge_counts(view(spark, sf, "counts"))


def _scores(spark: SparkSession, sf: str) -> DataFrame:
    return counts.divergences(view(spark, sf, "counts"), _whole(spark, sf))


def _r(c: str, n: int = 6):
    return F.round(F.col(c), n).alias(c)


def kld_fit(spark: SparkSession, sf: str) -> DataFrame:
    return counts.gamma_fit(counts.own_divergences(view(spark, sf, "counts"))).select("chr", "pos", "n", _r("sx"), _r("slx"), _r("sxlx"), _r("k", 3), _r("theta"))


def pileup_counts(spark: SparkSession, sf: str) -> DataFrame:
    return counts.count_bases(view(spark, sf, "alignments"))


def pileup_long_regions(spark: SparkSession, sf: str) -> DataFrame:
    regions = view(spark, sf, "regions").select("chr", (F.col("start") + 1000).alias("start"), (F.col("end") + 1000).alias("end"))
    return counts.pileup(view(spark, sf, "alignments"), regions)


def counts_merge(spark: SparkSession, sf: str) -> DataFrame:
    return _whole(spark, sf).drop("indels")


def counts_merge_indels(spark: SparkSession, sf: str) -> DataFrame:
    return _whole(spark, sf).select("chr", "pos", "indels")


def gene_group(spark: SparkSession, sf: str) -> DataFrame:
    return counts.group_counts(_whole(spark, sf), view(spark, sf, "regions"))


def kld_dist(spark: SparkSession, sf: str) -> DataFrame:
    return _scores(spark, sf).select("sample", "chr", "pos", _r("kld"), "pval")


def gamma_fit_merge(spark: SparkSession, sf: str) -> DataFrame:
    parts = [counts.gamma_fit(_scores(spark, sf).where(F.col("sample") % 2 == i)) for i in (0, 1)]
    return counts.merge_gamma(parts[0].unionByName(parts[1])).select("chr", "pos", "n", _r("sx"), _r("slx"), _r("sxlx"))


def gamma_pval(spark: SparkSession, sf: str) -> DataFrame:
    scores = counts.own_divergences(view(spark, sf, "counts"))
    fitted = counts.gamma_fit(scores)
    return counts.tails(scores, fitted).select("sample", "chr", "pos", _r("kld"), _r("pval", 4))


def _named(spark: SparkSession, sf: str) -> DataFrame:
    """The merged counts, with all chromosomes spelled one way."""
    return counts.merge_counts(view(spark, sf, "counts").withColumn("chr", F.concat(F.lit("chr"), F.regexp_replace("chr", "^chr", ""))))


def _annotated(spark: SparkSession, sf: str) -> DataFrame:
    whole = _named(spark, sf)
    scores = whole.select("chr", "pos", F.lit(0.5).alias("kld"), F.try_divide(F.lit(1.0), 1 + F.col("nA")).alias("pval"))
    return counts.annotated(whole, scores, view(spark, sf, "bases"), 0.05)


def annot_loci(spark: SparkSession, sf: str) -> DataFrame:
    return _annotated(spark, sf).select("chr", "pos", "nA", "cov", "ref", "alt", _r("raf"), _r("vaf"), _r("pval"), "exac")


def _calls(spark: SparkSession, sf: str) -> DataFrame:
    whole = _named(spark, sf)
    scores = whole.select("chr", "pos", F.lit(0.5).alias("kld"), F.try_divide(F.lit(0.002), 1 + F.col("nA")).alias("pval"))
    return counts.variants(whole, scores, view(spark, sf, "bases"))


def call_variants(spark: SparkSession, sf: str) -> DataFrame:
    return _calls(spark, sf).select("chr", "pos", "ref", "alt", _r("qual", 4), "ac", _r("af"), "dp", "hgvsg")


def vcf_lines(spark: SparkSession, sf: str) -> DataFrame:
    return counts.vcf_lines(_calls(spark, sf)).select("chr", "pos", "alt", "line")


def exon_read_counts(spark: SparkSession, sf: str) -> DataFrame:
    return features.exon_reads(view(spark, sf, "alignments"), view(spark, sf, "features"))


def feature_parent_paths(spark: SparkSession, sf: str) -> DataFrame:
    return features.parent_paths(view(spark, sf, "features").select("id", "parent").distinct())


def _genome(spark: SparkSession) -> DataFrame:
    return chrom.genome_map(spark, chrom.HG19)


def tx_span_stats(spark: SparkSession, sf: str) -> DataFrame:
    found = features.span_statistics(view(spark, sf, "genes"), _genome(spark))
    return found.select("n", "total", "covered", _r("mean_depth"), "max_depth", _r("fraction", 12))


def tx_depth_hist(spark: SparkSession, sf: str) -> DataFrame:
    return intervals.depth_histogram(features.spans(view(spark, sf, "genes"), _genome(spark)))


def interval_segments(spark: SparkSession, sf: str) -> DataFrame:
    found = intervals.segments(view(spark, sf, "regions"), "gene")
    return found.select("chr", "start", "end", F.array_join("labels", ",").alias("labels"))


def interval_overlap(spark: SparkSession, sf: str) -> DataFrame:
    regions = view(spark, sf, "regions")
    a = regions.select("chr", F.col("start").alias("a_start"), F.col("end").alias("a_end"), F.col("gene").alias("a"))
    b = regions.select("chr", (F.col("start") + 7).alias("b_start"), (F.col("end") + 3).alias("b_end"), F.col("gene").alias("b"))
    return intervals.overlaps(a, b).groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), F.sum("a_start").alias("at"))


def region_filter(spark: SparkSession, sf: str) -> DataFrame:
    return intervals.in_regions(_whole(spark, sf).select("chr", "pos", "nA"), view(spark, sf, "regions"))


def chrom_to_genome(spark: SparkSession, sf: str) -> DataFrame:
    return chrom.to_linear(view(spark, sf, "bases"), _genome(spark)).select("chr", "pos", "linear")


def genome_to_chrom(spark: SparkSession, sf: str) -> DataFrame:
    linear = chrom.to_linear(view(spark, sf, "bases"), _genome(spark)).select("linear")
    return chrom.from_linear(linear, _genome(spark)).select("linear", "chr", "pos")


def locus_order(spark: SparkSession, sf: str) -> DataFrame:
    loci = _whole(spark, sf).select("chr", "pos", chrom.chr_ord(F.col("chr")).alias("ord"), chrom.chr_key(F.col("chr")).alias("key"))
    return loci.orderBy(*chrom.locus_order())


def order_check(spark: SparkSession, sf: str) -> DataFrame:
    rows = view(spark, sf, "alignments").groupBy("chr", "id").agg(F.min("pos").alias("pos"))
    return tables.out_of_order(rows, ["chr"], "id", ["pos"]).groupBy("chr").agg(F.count(F.lit(1)).alias("n"))


def ordered_merge(spark: SparkSession, sf: str) -> DataFrame:
    each = view(spark, sf, "counts")
    a, b = (each.where(half).groupBy("pos").agg(F.sum("nA").alias("nA"), F.sum("nC").alias("nC")) for half in (F.col("sample") < 5, F.col("sample") >= 5))
    return tables.combined(a, b, ["pos"], lambda name, left, right: left + right)


def positional_zip(spark: SparkSession, sf: str) -> DataFrame:
    s = view(spark, sf, "seqs")
    return tables.zipped(s.select(F.col("seq_id").alias("idx"), F.length("seq").alias("n1")), s.select(F.col("seq_id").alias("idx"), F.length(F.regexp_replace("seq", "N", "")).alias("n2")))


def tsv_map(spark: SparkSession, sf: str) -> DataFrame:
    r = view(spark, sf, "regions")
    return tables.columns_copied(r.withColumn("len", F.col("end") - F.col("start")), 0, 5)


def rank_select(spark: SparkSession, sf: str) -> DataFrame:
    r = view(spark, sf, "regions")
    # Values over many of the stretches that ranks are counted in.
    return tables.ranks(r.select((F.col("start") * 7919 % 99991 * 1009).alias("value")), r.select((F.col("end") * 104729 % 99991 * 1009).alias("query")))


def scatter_round_robin(spark: SparkSession, sf: str) -> DataFrame:
    return tables.dealt(view(spark, sf, "seqs").withColumnRenamed("seq_id", "idx"), 7).groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("seq")).alias("bases"))


def cigar_decode(spark: SparkSession, sf: str) -> DataFrame:
    ops = view(spark, sf, "alignments").select("cigar").distinct().select("cigar", F.posexplode(alignment.cigar_ops(F.col("cigar"))).alias("i", "o"))
    return ops.select("cigar", "i", "o.op", "o.len")


def flag_predicates(spark: SparkSession, sf: str) -> DataFrame:
    reads_ = view(spark, sf, "alignments")
    return reads_.groupBy("flags").agg(*(F.count_if(alignment.flag(n, F.col("flags"))).alias(n) for n in alignment.FLAGS))


def revcomp(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, "seqs").select("seq_id", F.md5(kmers.complemented(F.col("seq"))).alias("digest"))


def hamming(spark: SparkSession, sf: str) -> DataFrame:
    found = kmers.kmers(view(spark, sf, "reference"), 15, "seq_id").select("seq_id", "pos", kmers.packed(F.col("kmer")).alias("x"))
    other = found.select((F.col("seq_id") - 1).alias("seq_id"), "pos", F.col("x").alias("y"))
    return found.join(other, ["seq_id", "pos"]).select("seq_id", "pos", "x", kmers.unpacked(F.col("x"), 15).alias("kmer"), kmers.hamming(F.col("x"), F.col("y")).alias("distance"))


def gc_entropy(spark: SparkSession, sf: str) -> DataFrame:
    return reads.entropy(view(spark, sf, "seqs")).select("seq_id", _r("entropy"))


def murmur_hash(spark: SparkSession, sf: str) -> DataFrame:
    rows = view(spark, sf, "alignments").select("id").distinct().withColumn("x", F.col("id") * 4294967311)
    return kmers.with_hash32(rows, "x", "hash", 17).select("id", "hash")


def xlr_hash(spark: SparkSession, sf: str) -> DataFrame:
    rows = view(spark, sf, "alignments").select("id").distinct()
    return rows.select("id", kmers.mixed64(F.lit(17).cast("long"), F.col("id")).alias("hash"), kmers.mixed64_text(F.lit(17).cast("long"), F.concat(F.lit("read"), F.col("id").cast("string"))).alias("text_hash"))


def hash_bias(spark: SparkSession, sf: str) -> DataFrame:
    return reads.bit_bias(murmur_hash(spark, sf), "hash").where("bit < 32").select("bit", "ones", "total", _r("chi2"))


def hash_bins(spark: SparkSession, sf: str) -> DataFrame:
    found = reads.bin_bias(murmur_hash(spark, sf), "hash", 64)
    return found.select("total", _r("chi2"), F.round(stats.chi_squared_sf(F.lit(63).cast("long"), F.col("chi2")), 4).alias("p"))


def kmer_generate(spark: SparkSession, sf: str) -> DataFrame:
    return kmers.kmers(view(spark, sf, "reference"), 9, "seq_id")


def kmer_positions(spark: SparkSession, sf: str) -> DataFrame:
    found = kmers.both_strands(kmers.kmers(view(spark, sf, "reference"), 9, "seq_id", "seq"))
    at = F.when(F.col("strand") == "+", F.col("pos")).otherwise(F.length("seq") - 9 - F.col("pos"))
    return found.select("seq_id", "strand", at.cast("long").alias("at"), "kmer")


def kmer_canonical_hist(spark: SparkSession, sf: str) -> DataFrame:
    return reads.sketch_histogram(view(spark, sf, "seqs"), 11, 1, 1)


def kmer_sketch_hist(spark: SparkSession, sf: str) -> DataFrame:
    return reads.sketch_histogram(view(spark, sf, "seqs"))


def kmer_both_strands_hist(spark: SparkSession, sf: str) -> DataFrame:
    return reads.strand_histogram(view(spark, sf, "seqs"))


def kmer_nonoverlap(spark: SparkSession, sf: str) -> DataFrame:
    return reads.repeats(view(spark, sf, "seqs"))


def kmer_label_unique(spark: SparkSession, sf: str) -> DataFrame:
    return reads.label_counts(view(spark, sf, "seqs"), 25)


def read_pair_labels(spark: SparkSession, sf: str) -> DataFrame:
    found = reads.pair_labels(view(spark, sf, "pairs"), reads.labels(view(spark, sf, "reference"), 25))
    return found.select("pair_id", *(F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c) for c in ("lhs", "rhs")))


def kmer_pulldown(spark: SparkSession, sf: str) -> DataFrame:
    return reads.pulldown(view(spark, sf, "pairs"), view(spark, sf, "reference"))


def minhash_bottom_k(spark: SparkSession, sf: str) -> DataFrame:
    return reads.bottom_k(view(spark, sf, "seqs"), 8, 100)


def minhash_by_sequence(spark: SparkSession, sf: str) -> DataFrame:
    return reads.bottom_k_by(view(spark, sf, "reference"), "seq_id", 12, 10)


def allele_typing(spark: SparkSession, sf: str) -> DataFrame:
    return reads.allele_counts(view(spark, sf, "pairs"), view(spark, sf, "alleles"))


def allele_json(spark: SparkSession, sf: str) -> DataFrame:
    return reads.allele_json(allele_typing(spark, sf))


def positional_hits(spark: SparkSession, sf: str) -> DataFrame:
    return reads.placements(view(spark, sf, "reference").withColumnRenamed("seq_id", "read_id"), view(spark, sf, "seqs"))


def allele_runs(spark: SparkSession, sf: str) -> DataFrame:
    return intervals.runs(view(spark, sf, "counts").select("sample", "pos"), "pos", "sample")


def hgvsg_parse(spark: SparkSession, sf: str) -> DataFrame:
    v = F.col("v")
    found = view(spark, sf, "descriptions").select("id", variants.parsed_genomic(F.col("text")).alias("v"))
    return found.select("id", *(v[c].alias(c) for c in ("kind", "acc", "version", "first", "last", "ref", "alt")))


def hgvsg_format(spark: SparkSession, sf: str) -> DataFrame:
    p = hgvsg_parse(spark, sf)
    return p.select("id", variants.genomic(F.concat("acc", F.lit("."), F.col("version").cast("string")), *(F.col(c) for c in ("kind", "first", "last", "ref", "alt"))).alias("text"))


def hgvs_grammar(spark: SparkSession, sf: str) -> DataFrame:
    v = F.col("v")
    found = view(spark, sf, "descriptions").select("id", variants.parsed(F.col("text")).alias("v"))
    return found.select("id", *(v[c].alias(c) for c in ("system", "kind", "first", "last", "alt")))


def vcf_to_hgvsg(spark: SparkSession, sf: str) -> DataFrame:
    d = variants.described(view(spark, sf, "alleles_vcf"))
    return d.select("id", "kind", "first", "last", variants.genomic(F.col("chr"), F.col("kind"), F.col("first"), F.col("last"), F.col("dref"), F.col("dalt")).alias("text"))


def _transcripts(spark: SparkSession, sf: str) -> DataFrame:
    t = view(spark, sf, "transcripts")
    exon = lambda a, b: F.struct((F.col("txStart") + a).alias("first"), (F.col("txStart") + b).alias("last"))
    return t.withColumn("exons", F.array(exon(0, 30), exon(45, 60), exon(75, 90)))


def transcript_overlap(spark: SparkSession, sf: str) -> DataFrame:
    loci = view(spark, sf, "bases").select("chr", (F.col("pos") + 999).alias("pos0"))
    return features.transcripts_near(loci, _transcripts(spark, sf).drop("exons")).select("chr", "pos0", "accession")


def hgvsc_map(spark: SparkSession, sf: str) -> DataFrame:
    loci = view(spark, sf, "bases").select("chr", (F.col("pos") + 1000).alias("pos"), "ref", F.translate("ref", "ACGT", "CATG").alias("alt"))
    return features.on_transcripts(loci, _transcripts(spark, sf))


def info_parse(spark: SparkSession, sf: str) -> DataFrame:
    p = view(spark, sf, "counts").where("indels <> ''").select("sample", "chr", "pos", F.explode(text.pairs(F.col("indels"))).alias("p"))
    return p.groupBy(F.col("p.key").alias("key")).agg(F.count(F.lit(1)).alias("rows_with"), F.sum(F.col("p.value").cast("long")).alias("total"))


def kv_list_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    kind = text.column_type("[str=uint]")
    rows = view(spark, sf, "counts").select("sample", "pos", "indels", kind.write(kind.read(F.col("indels"))).alias("again"))
    return rows.groupBy("sample").agg(F.count_if(F.col("indels") == F.col("again")).alias("same"), F.count(F.lit(1)).alias("n"))


def sequence_slices(spark: SparkSession, sf: str) -> DataFrame:
    s = view(spark, sf, "seqs").select(F.col("seq_id").alias("acc"), "seq")
    wanted = s.select("acc", (F.length("seq") / 3).cast("long").alias("begin"), (F.length("seq") / 3 + 200).cast("long").alias("end"))
    return features.slices(wanted, features.pieces(s, 128), 128)


def human_numbers(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, "counts").groupBy("sample").agg(F.sum(F.col("nA") * 100).alias("n")).select("sample", "n", stats.human(F.col("n")).alias("text"))


def vbyte_code(spark: SparkSession, sf: str) -> DataFrame:
    rows = view(spark, sf, "bases").select("pos", (F.col("pos") * F.col("pos") * 9973).alias("x")).withColumn("code", coding.vbyte(F.col("x")))
    return rows.select("pos", F.array_join(F.transform("code", lambda b: b.cast("string")), ",").alias("code"), coding.from_vbyte(F.col("code")).alias("back"))


def locus_parse(spark: SparkSession, sf: str) -> DataFrame:
    rows = view(spark, sf, "bases").select(F.concat("chr", F.lit(":"), F.col("pos").cast("string")).alias("text"))
    return rows.select("text", variants.parsed_locus(F.col("text")).alias("l")).select("text", "l.chr", "l.pos")


def gamma_moments(spark: SparkSession, sf: str) -> DataFrame:
    x = F.col("nA").cast("double")
    sums = view(spark, sf, "counts").groupBy("sample").agg(F.count(F.lit(1)).alias("n"), F.sum(x).alias("sx"), F.sum(x * x).alias("sxx"))
    k, theta = stats.moments(F.col("n"), F.col("sx"), F.col("sxx"))
    return sums.select("sample", F.round(k, 6).alias("k"), F.round(theta, 6).alias("theta"))


def base_divergence(spark: SparkSession, sf: str) -> DataFrame:
    total = F.col("nA") + F.col("nC") + F.col("nG") + F.col("nT")
    shares = F.array(*(F.try_divide(F.col(c).cast("double"), total) for c in ("nA", "nC", "nG", "nT")))
    even = F.array(*(F.lit(0.25) for _ in range(4)))
    return view(spark, sf, "counts").where(total > 0).select("sample", "chr", "pos", F.round(stats.relative_entropy(shares, even), 6).alias("divergence"))


def annot_exac(spark: SparkSession, sf: str) -> DataFrame:
    whole = _named(spark, sf)
    scores = whole.select("chr", "pos", F.lit(0.5).alias("kld"), F.try_divide(F.lit(1.0), 1 + F.col("nA")).alias("pval"))
    known = view(spark, sf, "bases").select("chr", "pos", F.translate("ref", "ACGT", "CGTA").alias("alt"), (F.col("pos") % 100).alias("af"))
    return counts.annotated(whole, scores, view(spark, sf, "bases"), 1.0, known).select("chr", "pos", "alt", "exac")


def reference_bases(spark: SparkSession, sf: str) -> DataFrame:
    s = view(spark, sf, "seqs").select(F.col("seq_id").cast("string").alias("acc"), "seq")
    n = F.length("seq").cast("long")
    at = F.array(*(F.lit(i).cast("long") for i in (1, 128, 129)), F.floor(n / 2), n, n + 1)
    loci = s.select(F.col("acc").alias("chr"), F.explode(at).alias("pos")).where("pos > 0")
    return features.bases_at(loci, features.pieces(s, 128), 128)


def rope_functions(spark: SparkSession, sf: str) -> DataFrame:
    s = view(spark, sf, "reference").withColumn("at", (F.length("seq") / 3).cast("int"))
    whole = text.joined(F.col("seq"), F.lit("-"), F.reverse("seq"))
    cut = text.split_at(whole, F.col("at"))
    return s.select("seq_id", F.md5(whole).alias("whole"), text.sliced(whole, F.col("at") - 3, F.col("at") + 5).alias("slice"), cut["left"].alias("head"), F.length(cut["right"]).alias("rest"), text.found_at(whole, F.lit("-")).alias("mark"), text.found_at(whole, F.lit("?")).alias("none"))


def sql_functions(spark: SparkSession, sf: str) -> DataFrame:
    registry.register(spark)
    rows = kmers.kmers(view(spark, sf, "reference"), 11, "seq_id").select("seq_id", "pos", "kmer")
    names = ("revcomp", "canonical_kmer", "kmer_pack", "gc_fraction")
    return rows.select("seq_id", "pos", *(F.expr(f"hx_{n}(kmer)").alias(n) for n in names), F.expr("hx_kmer_unpack(hx_kmer_pack(kmer), 11)").alias("back"), F.expr("hx_info_value(concat('a=1;k=', kmer), 'k')").alias("info"))


def _kept(spark: SparkSession, name: str) -> str:
    """A new folder below the shared one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = f"file://{tempfile.mkdtemp(prefix='helixframe-')}"
    return f"{root.rstrip('/')}/{name}-{spark._jvm.java.util.UUID.randomUUID()}"


def tsv_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    at = _kept(spark, "tsv")
    text_formats.write_tsv(_whole(spark, sf).select("chr", "pos", *counts.COUNTS, "indels"), at)
    return text_formats.read_tsv(spark, at, text_formats.COUNTS_DDL)


def bed_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    at = _kept(spark, "bed")
    text_formats.write_tsv(view(spark, sf, "regions").select("chr", "start", "end", "gene"), at, header=False)
    return text_formats.read_bed(spark, at)


def sam_read(spark: SparkSession, sf: str) -> DataFrame:
    at = _kept(spark, "sam")
    fields = [F.concat(F.lit("read"), "id"), "flags", "chr", "pos", F.lit(60), "cigar", F.lit("*"), F.lit(0), "tlen", "seq", F.lit("*"), F.lit("NM:i:0")]
    view(spark, sf, "alignments").select(F.concat_ws("\t", *(F.col(f).cast("string") if isinstance(f, str) else f.cast("string") for f in fields))).write.text(at)
    return text_formats.read_sam(spark, at).select("name", "flags", "chr", "pos", "cigar", "tlen", "seq", "qual")


def fastq_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    at = _kept(spark, "fastq")
    rows = view(spark, sf, "seqs").where("length(seq) > 0").select(F.concat(F.lit("r"), "seq_id").alias("id"), "seq", F.lit("").alias("id2"), F.repeat(F.lit("I"), F.length("seq")).alias("qual"))
    sequences.write_fastq(rows, at)
    return sequences.read_fastq(spark, at).select("id", F.md5("seq").alias("seq"), F.length("qual").alias("n"))


def fasta_read(spark: SparkSession, sf: str) -> DataFrame:
    at = _kept(spark, "fasta")
    view(spark, sf, "reference").select(F.concat(F.lit(">s"), "seq_id", F.lit(" some words\n"), F.regexp_replace("seq", "(.{60})(?=.)", "$1\n"))).write.text(at)
    return sequences.read_fasta(spark, at).select("name", F.md5("seq").alias("seq"))


def vcf_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    at = _kept(spark, "vcf")
    c = _calls(spark, sf)
    parts = F.array(*(F.struct(F.lit(k).alias("key"), v.cast("string").alias("value")) for k, v in (("AC", F.col("ac")), ("DP", F.col("dp")))))
    text_formats.write_vcf(c.select("chr", "pos", "id", "ref", "alt", F.round("qual", 2).alias("qual"), "filter", parts.alias("info")), at)
    found = text_formats.read_vcf(spark, at)
    return found.select("chr", "pos", "ref", "alt", "qual", "filter", text.pairs_text(F.col("info")).alias("info"))


def gff3_read(spark: SparkSession, sf: str) -> DataFrame:
    at = _kept(spark, "gff3")
    attributes = F.concat(F.lit("ID="), "id", F.when(F.col("parent").isNull(), F.lit("")).otherwise(F.concat(F.lit(";Parent="), "parent")))
    f = view(spark, sf, "features")
    f.select(F.concat_ws("\t", "chr", F.lit("."), "type", F.col("start").cast("string"), F.col("end").cast("string"), F.lit("."), F.lit("+"), F.lit("."), attributes)).write.text(at)
    return text_formats.gff3_features(text_formats.read_gff3(spark, at))


def refgene_read(spark: SparkSession, sf: str) -> DataFrame:
    at = _kept(spark, "refgene")
    t = view(spark, sf, "transcripts")
    exons = [F.concat_ws(",", *((F.col("txStart") + n).cast("string") for n in ns), F.lit("")) for ns in ((0, 45, 75), (30, 60, 90))]
    fields = [F.lit(0), "accession", "chr", "strand", "txStart", "txEnd", "cdsStart", "cdsEnd", F.lit(3), *exons, F.lit(0), F.lit("gene"), F.lit("cmpl"), F.lit("cmpl"), F.lit("0,0,0,")]
    t.select(F.concat_ws("\t", *(F.col(f).cast("string") if isinstance(f, str) else f.cast("string") for f in fields))).write.text(at)
    found = text_formats.read_refgene(spark, at)
    return found.select("name", "chrom", "strand", "txStart", "txEnd", F.size("exons").alias("n_exons"), F.col("exons")[2]["last"].alias("last_base"))


def intervals_saved(spark: SparkSession, sf: str) -> DataFrame:
    at = _kept(spark, "intervals")
    intervals.save(view(spark, sf, "regions"), at)
    return intervals.load(spark, at)


def stream_counts_indels(spark: SparkSession, sf: str) -> DataFrame:
    """Counts with their longer events, merged file by file as they arrive."""
    at = _kept(spark, "merge")
    rows = view(spark, sf, "counts").drop("sample")
    rows.repartition(4).write.parquet(f"{at}/in")
    arriving = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2).parquet(f"{at}/in")
    arriving.writeStream.option("checkpointLocation", f"{at}/log").trigger(availableNow=True).foreachBatch(incremental.merging_sink(spark, f"{at}/out")).start().awaitTermination()
    return incremental.merged_table(spark, f"{at}/out").select("chr", "pos", "indels")


def _as_stream(spark: SparkSession, rows: DataFrame, query: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The final state of ``query`` over ``rows`` as a stream of files."""
    at = _kept(spark, "stream")
    rows.repartition(4).write.parquet(f"{at}/in")
    arriving = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2).parquet(f"{at}/in")

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{at}/out")

    query(arriving).writeStream.outputMode("complete").option("checkpointLocation", f"{at}/log").trigger(availableNow=True).foreachBatch(put).start().awaitTermination()
    return spark.read.parquet(f"{at}/out")


def stream_counts_merge(spark: SparkSession, sf: str) -> DataFrame:
    return _as_stream(spark, view(spark, sf, "counts"), incremental.merged_counts)


def stream_gamma_fit(spark: SparkSession, sf: str) -> DataFrame:
    return _as_stream(spark, _scores(spark, sf), incremental.gamma_statistics).select("chr", "pos", "n", _r("sx"), _r("slx"), _r("sxlx"))


def queries() -> dict[str, Query]:
    own = sys.modules[__name__]
    return {n: f for n, f in vars(own).items() if inspect.isfunction(f) and f.__module__ == __name__ and not n.startswith("_") and n != "queries"}
