"""Features of a genome: reads over exons, paths to the root, spans of transcripts, reference bases."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from helixframe.functions.alignment import flag
from helixframe.functions.chrom import to_linear
from helixframe.functions.kmers import complemented
from helixframe.functions.variants import coding, locus_text, transcript_locus
from helixframe.operators.intervals import depth_histogram, overlaps

#: Template lengths of reads that count, and bases to a piece of a stored sequence.
LONGEST_TEMPLATE, PIECE = 4096, 1 << 16
#: Levels above a feature that a path can have; more are taken for a cycle.
DEEPEST = 64


def parent_paths(features: DataFrame) -> DataFrame:
    """(id, path): every way from a feature of ``features`` (id, parent) up to its root, "/" between the ids.

    A feature can stand in several rows with a parent each. One join a level, until no path has a parent left.
    """
    up = features.select(F.col("id").alias("__id"), F.col("parent").alias("__parent"))
    now = features.select("id", F.col("parent").alias("next"), F.col("id").alias("path"))
    done = now.where("next is null")
    now = now.where("next is not null")
    for _ in range(DEEPEST):
        step = now.join(up, F.col("next") == F.col("__id"), "left").select("id", F.when(F.col("__id").isNotNull(), F.col("__parent")).alias("next"), F.concat_ws("/", "path", "next").alias("path"))
        done = done.unionByName(step.where("next is null"))
        now = step.where("next is not null")
        if now.isEmpty():
            return done.select("id", "path")
    raise ValueError(f"features nest deeper than {DEEPEST} levels or in a circle")


def exon_reads(reads: DataFrame, features: DataFrame, longest: int = LONGEST_TEMPLATE) -> DataFrame:
    """(id, path, n): reads over each exon of ``features`` (id, parent, type, chr, start, end), zeros included, by path.

    Reads (chr, pos, flags, tlen) count if they are mapped and their template is 0 to ``longest`` bases long; they cover
    the template from their position.
    """
    kinds = features.where(F.col("type").isin("exon", "transcript", "mRNA", "gene"))
    exons = kinds.where("type = 'exon'").select("id", "chr", "start", "end").distinct()
    use = reads.where(~flag("unmapped", F.col("flags")) & F.col("tlen").between(0, longest))
    # Equal templates are counted once before the join.
    spans = use.groupBy("chr", F.col("pos").alias("a"), (F.col("pos") + F.greatest("tlen", F.lit(1))).alias("z")).agg(F.count(F.lit(1)).alias("k"))
    hit = overlaps(spans, exons, a_range=("a", "z"), b_range=("start", "end")).groupBy("id").agg(F.sum("k").alias("n"))
    paths = parent_paths(kinds.select("id", "parent").distinct())
    return exons.select("id").distinct().join(hit, "id", "left").join(paths, "id").select("id", "path", F.coalesce("n", F.lit(0)).alias("n"))


def spans(genes: DataFrame, genome: DataFrame) -> DataFrame:
    """(start, end) of the distinct transcripts of ``genes`` (chrom, txStart, txEnd) on the genome's one axis."""
    each = genes.select("chrom", "txStart", "txEnd").distinct()
    at = to_linear(each.withColumnRenamed("chrom", "chr"), genome, pos="txStart")
    return at.select(F.lit("genome").alias("chr"), F.col("linear").alias("start"), (F.col("linear") + F.col("txEnd") - F.col("txStart")).alias("end"))


def span_statistics(genes: DataFrame, genome: DataFrame) -> DataFrame:
    """One row: n and total of the spans, covered bases, their fraction of the genome, mean and greatest depth over them."""
    s = spans(genes, genome)
    plain = s.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("end") - F.col("start")).alias("total"))
    deep = depth_histogram(s).agg(F.sum("bases").alias("covered"), (F.sum(F.col("bases") * F.col("depth")) / F.sum("bases")).alias("mean_depth"), F.max("depth").alias("max_depth"))
    size = genome.agg(F.sum("size").alias("__size"))
    return plain.crossJoin(deep).crossJoin(size).withColumn("fraction", F.col("covered") / F.col("__size")).drop("__size")


def pieces(seqs: DataFrame, piece: int = PIECE) -> DataFrame:
    """``seqs`` (acc, seq) as rows (acc, piece, seq) of a fixed number of bases: the stored form that lookups join with."""
    raw, n = F.col("__raw"), F.octet_length("__raw")
    # As bytes, so that no piece is looked for from the start of the sequence.
    at = seqs.select("acc", F.col("seq").cast("binary").alias("__raw")).withColumn("piece", F.explode(F.when(n > 0, F.sequence(F.lit(0), F.floor((n - 1) / piece).cast("int")))))
    return at.select("acc", "piece", F.substring(raw, F.col("piece") * piece + 1, F.lit(piece)).cast("string").alias("seq"))


def slices(wanted: DataFrame, stored: DataFrame, piece: int = PIECE) -> DataFrame:
    """``wanted`` (acc, begin, end and more) with bases, the half-open piece of the stored sequence; short at its end."""
    key = [c for c in wanted.columns]
    each = wanted.withColumn("piece", F.explode(F.sequence(F.floor(F.col("begin") / piece).cast("int"), F.floor(F.greatest("begin", F.col("end") - 1) / piece).cast("int"))))
    from_, to = F.greatest(F.col("begin") - F.col("piece") * piece, F.lit(0)), F.least(F.col("end") - F.col("piece") * piece, F.lit(piece))
    cut = each.join(stored.withColumnRenamed("seq", "__s"), ["acc", "piece"], "left").withColumn("__c", F.substring("__s", from_.cast("int") + 1, (to - from_).cast("int")))
    return cut.groupBy(*key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("piece", "__c"))), lambda x: x["__c"]), "").alias("bases"))


def bases_at(loci: DataFrame, stored: DataFrame, piece: int = PIECE) -> DataFrame:
    """(chr, pos, ref) of the distinct ``loci`` (chr, pos from 1) in a genome stored as pieces(), each fetched by its piece.

    What annotated() and variants() take as bases, without a row for every base of the genome. A locus off its sequence,
    or on one that isn't stored, is left out.
    """
    at = loci.select("chr", "pos").distinct().withColumn("piece", F.floor((F.col("pos") - 1) / piece).cast("int"))
    met = at.join(stored.select(F.col("acc").alias("chr"), "piece", F.col("seq").alias("__s")), ["chr", "piece"])
    base = F.substring("__s", (F.col("pos") - F.col("piece") * piece).cast("int"), F.lit(1))
    return met.select("chr", "pos", F.upper(base).alias("ref")).where(F.col("ref") != "")


def transcripts_near(loci: DataFrame, transcripts: DataFrame, window: int = 250) -> DataFrame:
    """``loci`` (chr, pos0) with every transcript (accession, chr, txStart, txEnd and more) within ``window`` bases of them."""
    points = loci.withColumn("__z", F.col("pos0") + 1)
    met = overlaps(points, transcripts, a_range=("pos0", "__z"), b_range=("txStart", "txEnd"), pad=window)
    return met.drop("__z")


def on_transcripts(variants: DataFrame, transcripts: DataFrame, window: int = 250, *, compat: bool = False) -> DataFrame:
    """Substitutions (chr, pos, ref, alt) written for each transcript nearby: accession, zone, place, rel and hgvsc.

    Bases are complemented for transcripts of the reverse strand.
    """
    met = transcripts_near(variants.withColumn("pos0", F.col("pos") - 1), transcripts, window)
    met = met.withColumn("tx", F.struct("strand", "txStart", "txEnd", "cdsStart", "cdsEnd", "exons")).withColumn("l", transcript_locus(F.col("pos"), compat=compat))
    base = lambda c: F.when(F.col("strand") == "-", F.translate(c, "ACGT", "TGCA")).otherwise(F.col(c))
    text = F.concat("accession", F.lit(":c."), locus_text(F.col("l.zone"), F.col("l.pos"), F.col("l.rel")), base("ref"), F.lit(">"), base("alt"))
    return met.select("chr", "pos", "ref", "alt", "accession", F.col("l.zone").alias("zone"), F.col("l.pos").alias("place"), F.col("l.rel").alias("rel"), text.alias("hgvsc"))


def described_on_transcripts(described: DataFrame, transcripts: DataFrame, window: int = 250, *, compat: bool = False) -> DataFrame:
    """Variants of any kind (chr, kind, first, last, dref, dalt) written for each transcript nearby: accession and hgvsc.

    Each end of the range is placed on the transcript by itself; on the reverse strand the ends change places and
    sequences are complemented.
    """
    met = transcripts_near(described.withColumn("pos0", F.col("first") - 1), transcripts, window)
    met = met.withColumn("tx", F.struct("strand", "txStart", "txEnd", "cdsStart", "cdsEnd", "exons"))
    met = met.withColumns({"__a": transcript_locus(F.col("first"), compat=compat), "__z": transcript_locus(F.col("last"), compat=compat)})
    back = F.col("strand") == "-"
    low, high = F.when(back, F.col("__z")).otherwise(F.col("__a")), F.when(back, F.col("__a")).otherwise(F.col("__z"))
    base = lambda c: F.when(back, complemented(F.col(c))).otherwise(F.col(c))
    text = coding(F.col("accession"), F.col("kind"), low, high, base("dref"), base("dalt"))
    return met.select("chr", "kind", "first", "last", "dref", "dalt", "accession", text.alias("hgvsc"))
