"""Base counts per locus: from reads to divergence, tails and variant calls.

All operators take and give DataFrames and are lazy, so a whole study is one plan over a ``sample`` column. Names of a
chromosome with and without "chr" are one key; see functions.chrom.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from helixframe.functions.alignment import atoms, flag
from helixframe.functions.chrom import chr_key
from helixframe.functions.stats import CATEGORIES, gamma_parameters, gamma_sf, kld, phred, ratio
from helixframe.functions.text import formatted, pairs
from helixframe.operators.intervals import in_regions, points_in

#: Column of each single-character event; all other events go to ``indels``.
EVENTS = {"A": "nA", "C": "nC", "G": "nG", "T": "nT", "N": "nN", ">": "nX0", "<": "nX1", "I": "nI", "D": "nD"}
COUNTS = tuple(EVENTS.values())


def _indels(event: Column, n: Column) -> Column:
    """key=n;... in order of the keys."""
    found = F.array_sort(F.collect_list(F.when(n.isNotNull() & event.isNotNull(), F.struct(event.alias("k"), n.alias("n")))))
    return F.array_join(F.transform(found, lambda x: F.concat(x["k"], F.lit("="), x["n"].cast("string"))), ";")


def mapped(reads: DataFrame) -> DataFrame:
    return reads.where(~flag("unmapped", F.col("flags")))


def pileup(reads: DataFrame, regions: DataFrame | None = None) -> DataFrame:
    """(chr, pos, base, count) of every event of the mapped ``reads``; with ``regions`` (chr, start, end), of loci inside of them."""
    events = atoms(mapped(reads).select("chr", "pos", "cigar", "seq"))
    if regions is not None:
        events = in_regions(events, regions)
    return events.groupBy("chr", "pos", F.col("atom").alias("base")).agg(F.count(F.lit(1)).alias("count"))


def count_bases(reads: DataFrame, regions: DataFrame | None = None) -> DataFrame:
    """The counts table of ``reads``: chr, pos, a column for each event, and the longer events as text."""
    events = pileup(reads, regions)
    sums = [F.coalesce(F.sum(F.when(F.col("base") == e, F.col("count"))), F.lit(0)).alias(c) for e, c in EVENTS.items()]
    longer = ~F.col("base").isin(*EVENTS)
    return events.groupBy("chr", "pos").agg(*sums, _indels(F.when(longer, F.col("base")), F.when(longer, F.col("count"))).alias("indels"))


def merge_counts(counts: DataFrame, *by: str) -> DataFrame:
    """Sums per locus (and ``by``), with the longer events summed key by key; the least spelling of a chromosome stays."""
    key = chr_key(F.col("chr")).alias("__key")
    plain = counts.groupBy(*by, key, "pos").agg(F.min("chr").alias("chr"), *(F.sum(c).cast("long").alias(c) for c in COUNTS))
    each = counts.where("indels <> ''").select(*by, key, "pos", F.explode(pairs(F.col("indels"))).alias("p"))
    each = each.groupBy(*by, "__key", "pos", F.col("p.key").alias("k")).agg(F.sum(F.col("p.value").cast("long")).alias("n"))
    texts = each.groupBy(*by, "__key", "pos").agg(_indels(F.col("k"), F.col("n")).alias("indels"))
    return plain.join(texts, [*by, "__key", "pos"], "left").select(*by, "chr", "pos", *COUNTS, F.coalesce("indels", F.lit("")).alias("indels"))


def group_counts(counts: DataFrame, regions: DataFrame) -> DataFrame:
    """(gene, len, cnt): loci of ``counts`` in each gene of ``regions`` (chr, start, end, gene), and their bases and indels."""
    total = sum((F.col(c) for c in CATEGORIES), F.lit(0))
    hit = points_in(counts.select("chr", "pos", total.alias("n")), regions.select("chr", "start", "end", "gene")).dropDuplicates(["chr", "pos", "gene"])
    return hit.groupBy("gene").agg(F.count(F.lit(1)).alias("len"), F.sum("n").cast("long").alias("cnt"))


def divergences(counts: DataFrame, whole: DataFrame) -> DataFrame:
    """``counts``' chr and pos (and sample, if there) with kld from ``whole`` and pval 1; a locus that ``whole`` lacks gives 0."""
    w = whole.select(chr_key(F.col("chr")).alias("__key"), F.col("pos").alias("__pos"), *(F.col(c).alias(f"__{c}") for c in CATEGORIES))
    keep = [c for c in ("sample",) if c in counts.columns]
    met = counts.withColumn("__key", chr_key(F.col("chr"))).join(w.withColumnRenamed("__pos", "pos"), ["__key", "pos"], "left")
    d = kld([F.col(c) for c in CATEGORIES], [F.col(f"__{c}") for c in CATEGORIES])
    return met.select(*keep, "chr", "pos", F.when(F.col("__nA").isNull(), 0.0).otherwise(d).alias("kld"), F.lit(1.0).alias("pval"))


def own_divergences(counts: DataFrame) -> DataFrame:
    """divergences() of ``counts`` from its own merged counts, with key, what names of one chromosome share.

    The rows of a locus, one to a sample, are summed where they meet, so the counts are read and dealt out once; a fit per
    key and position needs no further shuffle.
    """
    w = Window.partitionBy("key", "pos")
    keyed = counts.withColumn("key", chr_key(F.col("chr")))
    met = keyed.select("*", *(F.sum(c).over(w).alias(f"__{c}") for c in CATEGORIES))
    d = kld([F.col(c) for c in CATEGORIES], [F.col(f"__{c}") for c in CATEGORIES])
    keep = [c for c in ("sample",) if c in counts.columns]
    return met.select(*keep, "chr", "pos", d.alias("kld"), F.lit(1.0).alias("pval"), "key")


def _key(scores: DataFrame) -> Column:
    return F.col("key") if "key" in scores.columns else chr_key(F.col("chr")).alias("key")


def _fitted(stats: DataFrame) -> DataFrame:
    k, theta = gamma_parameters(F.col("n"), F.col("sx"), F.col("slx"), F.col("sxlx"))
    return stats.select("chr", "pos", "n", "sx", "slx", "sxlx", k.alias("k"), theta.alias("theta"))


def gamma_fit(scores: DataFrame) -> DataFrame:
    """The gamma table of ``scores`` (chr, pos, kld): count, sums over positive values, shape and scale per locus."""
    x = F.when(F.col("kld") > 0, F.col("kld"))
    sums = scores.groupBy(_key(scores), "pos").agg(
        F.min("chr").alias("chr"), F.count(F.lit(1)).alias("n"), *(F.coalesce(F.sum(e), F.lit(0.0)).alias(c) for c, e in (("sx", x), ("slx", F.log(x)), ("sxlx", x * F.log(x))))
    )
    return _fitted(sums)


def merge_gamma(parts: DataFrame) -> DataFrame:
    """One gamma table of several partial ones: sums added up, parameters fitted anew."""
    return _fitted(parts.groupBy(chr_key(F.col("chr")).alias("__key"), "pos").agg(F.min("chr").alias("chr"), *(F.sum(c).alias(c) for c in ("n", "sx", "slx", "sxlx"))))


def tails(scores: DataFrame, gamma: DataFrame) -> DataFrame:
    """``scores`` with pval, the upper tail of their locus' gamma distribution; a locus without one is an error.

    A shape of 0, where all divergences are 0, gives 1 for 0 and 0 for more.
    """
    g = _fitted(gamma).select(chr_key(F.col("chr")).alias("__key"), "pos", "k", "theta")
    met = scores.withColumn("__key", chr_key(F.col("chr"))).join(g, ["__key", "pos"], "left")
    missing = F.raise_error(F.concat(F.lit("no gamma parameters for "), "chr", F.lit(":"), F.col("pos").cast("string"))).cast("double")
    shape = F.when(F.col("k").isNull() & F.col("theta").isNull(), missing).otherwise(F.col("k"))
    keep = [c for c in ("sample",) if c in scores.columns]
    return met.select(*keep, "chr", "pos", "kld", gamma_sf(shape, F.col("theta"), F.col("kld")).alias("pval"))


def annotated(counts: DataFrame, scores: DataFrame, bases: DataFrame, cutoff: float = 1.0, known: DataFrame | None = None) -> DataFrame:
    """Counts and scores of the same loci side by side, with coverage, reference and likeliest other allele.

    ``bases`` (chr, pos, ref) holds reference bases, ``known`` (chr, pos, alt, af) frequencies for the exac column. Loci
    in one of the two tables only are an error; rows with a pval above ``cutoff`` are dropped. Of other alleles with the
    same count the later letter wins.
    """
    c = counts.withColumnsRenamed({"chr": "__c1", "pos": "__p1"}).withColumn("__k", chr_key(F.col("__c1")))
    s = scores.select(F.col("chr").alias("__c2"), F.col("pos").alias("__p2"), "kld", "pval").withColumn("__k2", chr_key(F.col("__c2")))
    met = c.join(s, (F.col("__k") == F.col("__k2")) & (F.col("__p1") == F.col("__p2")), "full")
    # The check is the filter, for a filter on pval alone would drop the rows that it is about.
    differs = F.raise_error(F.lit("counts and scores are not of the same loci")).cast("boolean")
    met = met.where(F.when(F.col("__c1").isNull() | F.col("__c2").isNull(), differs).otherwise(F.col("pval") <= cutoff))
    met = met.withColumn("chr", F.col("__c1")).withColumn("pos", F.col("__p1")).join(bases.select("chr", "pos", F.upper("ref").alias("ref")), ["chr", "pos"], "left")
    letters = "ACGT"
    cov = sum((F.col(x) for x in CATEGORIES), F.lit(0).cast("long"))
    own = sum((F.when(F.col("ref") == x, F.col(f"n{x}")).otherwise(0) for x in letters), F.lit(0).cast("long"))
    others = [F.when(F.coalesce(F.col("ref"), F.lit("")) != x, F.struct(F.col(f"n{x}").alias("n"), F.lit(x).alias("l"))) for x in letters]
    others += [F.struct(F.col("nI").alias("n"), F.lit("I").alias("l")), F.struct(F.col("nD").alias("n"), F.lit("D").alias("l"))]
    met = met.withColumns({"cov": cov, "__alt": F.greatest(*others), "__own": own})
    out = met.select("chr", "pos", *COUNTS, "indels", "kld", "pval", "cov", ratio(F.col("__own"), F.col("cov")).alias("raf"), ratio(F.col("__alt.n"), F.col("cov")).alias("vaf"), "ref", F.col("__alt.l").alias("alt"))
    if known is None:
        return out.withColumn("exac", F.lit(""))
    return out.join(known.select("chr", "pos", "alt", F.col("af").cast("string").alias("exac")), ["chr", "pos", "alt"], "left").withColumn("exac", F.coalesce("exac", F.lit("")))


def variants(counts: DataFrame, scores: DataFrame, bases: DataFrame, *, coverage: int = 100, depth: int = 3, cutoff: float = 1e-4) -> DataFrame:
    """Variant records: chr, pos, id, ref, alt, qual, filter and the parts of INFO (ac, af, dp, kld, pval, hgvsg).

    Loci of ``coverage`` or more and a pval up to ``cutoff`` give a record for each base that isn't the reference's and
    was read ``depth`` times at least.
    """
    s = scores.select(chr_key(F.col("chr")).alias("__k"), "pos", "kld", "pval").where(F.col("pval") <= cutoff)
    dp = sum((F.col(c) for c in ("nA", "nC", "nG", "nT")), F.lit(0).cast("long"))
    met = counts.withColumn("__k", chr_key(F.col("chr"))).withColumn("dp", dp).where(F.col("dp") >= coverage).join(s, ["__k", "pos"]).join(bases.select("chr", "pos", F.upper("ref").alias("ref")), ["chr", "pos"])
    alts = F.array(*(F.struct(F.lit(x).alias("alt"), F.col(f"n{x}").alias("ac")) for x in "ACGT"))
    each = met.select("chr", "pos", "ref", "dp", "kld", "pval", F.inline(alts)).where((F.col("alt") != F.col("ref")) & (F.col("ac") >= depth))
    hgvsg = F.concat("chr", F.lit(":g."), F.col("pos").cast("string"), "ref", F.lit(">"), "alt")
    return each.select("chr", "pos", F.lit(".").alias("id"), "ref", "alt", phred(F.col("pval")).alias("qual"), F.lit("PASS").alias("filter"), "ac", ratio(F.col("ac"), F.col("dp")).alias("af"), "dp", "kld", "pval", hgvsg.alias("hgvsg"))


def vcf_lines(calls: DataFrame) -> DataFrame:
    """``calls`` of variants() with line, the text of their record, numbers as the C library writes them."""
    parts = {"AC": F.col("ac").cast("string"), "AF": formatted("%2.2f", F.col("af")), "DP": F.col("dp").cast("string"), "KLD": formatted("%2.2f", F.col("kld")), "PVAL": formatted("%2.2g", F.col("pval")), "HGVSg": F.col("hgvsg")}
    info = F.concat_ws(";", *(F.concat(F.lit(f"{k}="), v) for k, v in parts.items()))
    return calls.withColumn("line", F.concat_ws("\t", "chr", F.col("pos").cast("string"), "id", "ref", "alt", formatted("%.2f", F.col("qual")), "filter", info))
