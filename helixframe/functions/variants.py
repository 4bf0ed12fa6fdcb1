"""Variant notation: genomic descriptions, transcript coordinates, and how they follow from VCF alleles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from helixframe.functions.kmers import complemented

#: Genomic descriptions by kind: pattern after the accession, and which groups are first, last and alternative.
GENOMIC = {
    "sub": (r"([0-9]+)([ACGTacgt])>([ACGTacgt])", "1", "1", "2", "3"),
    "delins": (r"([0-9]+)(?:_([0-9]+))?delins([ACGTacgt]+)", "1", "2", "", "3"),
    "ins": (r"([0-9]+)_([0-9]+)ins([ACGTacgt]+)", "1", "2", "", "3"),
    "del": (r"([0-9]+)(?:_([0-9]+))?del([ACGTacgtNn]*)", "1", "2", "3", ""),
    "dup": (r"([0-9]+)(?:_([0-9]+))?dup([ACGTacgt]*)", "1", "2", "3", ""),
    "inv": (r"([0-9]+)_([0-9]+)inv([ACGTacgt]*)", "1", "2", "3", ""),
    "id": (r"([0-9]+)(?:_([0-9]+))?=", "1", "2", "", ""),
}


def parsed_genomic(text: Column) -> Column:
    """struct<kind, acc, version, first, last, ref, alt> of a description such as NC_1.2:g.10_11del; null if it is none."""
    out = F.lit(None)
    for kind, (pattern, first, last, ref, alt) in reversed(GENOMIC.items()):
        whole = f"^([^:]+):g[.]{pattern}$"
        group = lambda n, w=whole: F.regexp_extract(text, w, int(n) + 1) if n else F.lit("")
        acc = F.regexp_extract(text, whole, 1)
        a, b = group(first), group(last)
        found = F.struct(
            F.lit(kind).alias("kind"),
            F.regexp_replace(acc, r"\.[0-9]+$", "").alias("acc"),
            F.coalesce(F.regexp_extract(acc, r"\.([0-9]+)$", 1).try_cast("long"), F.lit(0).cast("long")).alias("version"),
            a.try_cast("long").alias("first"),
            F.when(b == "", a).otherwise(b).try_cast("long").alias("last"),
            group(ref).alias("ref"),
            group(alt).alias("alt"),
        )
        out = F.when(text.rlike(whole), found).otherwise(out)
    return out


def notation(acc: Column, system: str, kind: Column, first: Column, last: Column, ref: Column, alt: Column) -> Column:
    """The text of a description from those of its first and last positions; one position stands for a range of one."""
    two = F.concat(first, F.lit("_"), last)
    at = F.when(first == last, first).otherwise(two)
    what = (
        F.when(kind == "sub", F.concat(first, ref, F.lit(">"), alt)).when(kind == "ins", F.concat(two, F.lit("ins"), alt)).when(kind == "del", F.concat(at, F.lit("del")))
        .when(kind == "delins", F.concat(at, F.lit("delins"), alt)).when(kind == "dup", F.concat(at, F.lit("dup"))).when(kind == "inv", F.concat(at, F.lit("inv"))).when(kind == "id", F.concat(at, F.lit("=")))
    )
    return F.concat(acc, F.lit(f":{system}."), what)


def genomic(acc: Column, kind: Column, first: Column, last: Column, ref: Column, alt: Column) -> Column:
    """The text of a genomic description from numbers."""
    return notation(acc, "g", kind, first.cast("string"), last.cast("string"), ref, alt)


def coding(acc: Column, kind: Column, first: Column, last: Column, ref: Column, alt: Column) -> Column:
    """The text of a description on a transcript, from structs as transcript_locus() gives them."""
    place = lambda x: locus_text(x["zone"], x["pos"], x["rel"])
    return notation(acc, "c", kind, place(first), place(last), ref, alt)


def parsed_locus(text: Column) -> Column:
    """struct<chr, pos> of a text such as chr1:12345; null if it is none."""
    whole = "^([^:]+):([0-9]+)$"
    return F.when(text.rlike(whole), F.struct(F.regexp_extract(text, whole, 1).alias("chr"), F.regexp_extract(text, whole, 2).try_cast("long").alias("pos")))


def described(alleles: DataFrame, *, compat: bool = False) -> DataFrame:
    """``alleles`` (chr, pos, ref, alt and more) with a row per alternative and its kind, first, last, dref and dalt.

    Lengths tell the kinds apart; what several bases have in common at their start is taken off, and a remainder that is
    its own reverse complement's reference is an inversion; an alternative equal to the reference is "id". Ranges include
    their last base; with ``compat`` they end one later, and equal alleles are empty replacements, as in older output.
    """
    extra = 1 if compat else 0
    one = alleles.withColumn("alt", F.explode(F.split("alt", ",")))
    r, a = F.length("ref"), F.length("alt")
    same = F.transform(F.sequence(F.lit(1), F.least(r, a)), lambda i: F.substring(F.col("ref"), i, F.lit(1)) == F.substring(F.col("alt"), i, F.lit(1)))
    n = F.coalesce(F.nullif(F.array_position(same, False), F.lit(0)) - 1, F.least(r, a).cast("long"))
    one = one.withColumn("__n", F.when((r > 1) & (a > 1), n).when((r == 1) & (a == 1), F.lit(0).cast("long")).otherwise(F.lit(1).cast("long")))
    ref, alt = (F.expr(f"substring({c}, cast(__n as int) + 1)") for c in ("ref", "alt"))
    same = F.lit(False) if compat else F.col("ref") == F.col("alt")
    one = one.withColumns({"__same": same, "dref": F.when(same, F.col("ref")).otherwise(ref), "dalt": F.when(same, F.col("alt")).otherwise(alt)}).withColumn("__n", F.when(same, 0).otherwise(F.col("__n")))
    pos, m = F.col("pos"), F.length("dref")
    kind = (
        F.when(F.col("__same"), "id").when((r == 1) & (a == 1), "sub").when(r == 1, "ins").when(a == 1, "del")
        .when((m == F.length("dalt")) & (m > 0) & F.coalesce(complemented(F.col("dalt")) == F.upper("dref"), F.lit(False)) & ~F.col("dref").contains("N"), "inv").otherwise("delins")
    )
    one = one.withColumn("kind", kind)
    first = F.when(F.col("kind").isin("sub", "ins"), pos).otherwise(pos + F.col("__n"))
    last = F.when(F.col("kind") == "sub", pos).when(F.col("kind") == "ins", pos + 1).otherwise(pos + F.col("__n") + m - 1 + extra)
    return one.withColumns({"first": first, "last": last}).drop("__n", "__same")


def locus_text(zone: Column, pos: Column, rel: Column) -> Column:
    """A transcript position: * before positions after the coding part, offsets into introns signed."""
    offset = F.when(rel < 0, rel.cast("string")).when((rel > 0) | (zone == "INTRON"), F.concat(F.lit("+"), rel.cast("string"))).otherwise("")
    star = F.when(zone == "UTR3", "*").otherwise("")
    return F.concat(star, pos.cast("string"), F.when(zone == "CODING", "").otherwise(offset))


def transcript_locus(g: Column, tx: str = "tx", *, compat: bool = False) -> Column:
    """struct<zone, pos, rel> of a 1-based genomic position on a transcript.

    ``tx`` names a struct (strand, txStart, txEnd, cdsStart, cdsEnd, exons as array<struct<first, last>>, half-open and
    in genomic order). Positions in an exon count along the spliced transcript from the first coding base, those before
    it negative and those after the coding part from its end; others refer to the nearer end of the nearest exon. With
    ``compat``, coding positions of the forward strand come out two lower, as in older output.
    """
    c = lambda name: F.col(f"{tx}.{name}")
    g0, exons = g - 1, c("exons")
    forward = c("strand") == "+"
    zero = F.lit(0).cast("long")
    # Bases of exons before a genomic position: the spliced coordinate on the forward strand.
    spliced = lambda x: F.aggregate(exons, zero, lambda a, e: a + F.greatest(zero, F.least(e["last"], x) - F.least(e["first"], x)))
    start, end = spliced(c("cdsStart")), spliced(c("cdsEnd"))
    coding = end - start

    def place(x: Column) -> tuple[Column, Column]:
        """(zone, pos) of a base in an exon, or of the nearest bases outside of the transcript by their distance."""
        before_tx, after_tx = x < c("txStart"), x >= c("txEnd")
        along = F.when(before_tx, x - c("txStart")).when(after_tx, spliced(c("txEnd")) + x - c("txEnd")).otherwise(spliced(x))
        # Index of the base from the first coding one, in the direction of the transcript.
        i = F.when(forward, along - start).otherwise(end - 1 - along)
        zone = F.when(i < 0, "UTR5").when(i >= coding, "UTR3").otherwise("CODING")
        return zone, F.when(i < 0, i).when(i >= coding, i - coding + 1).otherwise(i + 1)

    inside = F.exists(exons, lambda e: (e["first"] <= g0) & (g0 < e["last"]))
    outside = (g0 < c("txStart")) | (g0 >= c("txEnd"))
    left = F.array_max(F.transform(F.filter(exons, lambda e: e["last"] <= g0), lambda e: e["last"] - 1))
    right = F.array_min(F.transform(F.filter(exons, lambda e: e["first"] > g0), lambda e: e["first"]))
    # Genomic neighbours of an intron base; the nearer counts, the right one if both are as near.
    to_left = F.coalesce(g0 - left < right - g0, left.isNotNull())
    near = F.when(to_left, left).otherwise(right)
    off = F.when(to_left, g0 - left).otherwise(g0 - right)
    off = F.when(forward, off).otherwise(-off)
    zone_in, pos_in = place(g0)
    _, pos_near = place(near)
    in_cds = (g0 >= c("cdsStart")) & (g0 < c("cdsEnd"))
    before_cds = F.when(forward, g0 < c("cdsStart")).otherwise(g0 >= c("cdsEnd"))
    zone_out = F.when(in_cds, "INTRON").when(before_cds, "UTR5").otherwise("UTR3")
    exact = inside | outside
    shift = F.when(F.lit(compat) & forward & exact & (zone_in == "CODING"), F.lit(2)).otherwise(0)
    return F.struct(F.when(exact, zone_in).otherwise(zone_out).alias("zone"), F.when(exact, pos_in - shift).otherwise(pos_near).alias("pos"), F.when(exact, F.lit(0).cast("long")).otherwise(off).alias("rel"))


#: A position of the general notation: number, offset or ?, * before it after the coding part.
_POSITION = r"(?:\*|-)?(?:[0-9]+|\?)(?:[+-](?:[0-9]+|\?))?"
_SPAN = rf"(?:\({_POSITION}_{_POSITION}\)|{_POSITION})"
_RANGE = rf"({_SPAN})(?:_({_SPAN}))?"
GRAMMAR = (("id", rf"{_RANGE}=()()"), ("sub", rf"{_RANGE}([ACGTUNacgtun])>([ACGTUNacgtun])"), ("delins", rf"{_RANGE}del([ACGTUNacgtun]*)ins([ACGTUNacgtun]+)"), ("del", rf"{_RANGE}del([ACGTUNacgtun]*|[0-9]+)()"), ("ins", rf"{_RANGE}()ins([ACGTUNacgtun]+|[0-9]+)"), ("dup", rf"{_RANGE}dup([ACGTUNacgtun]*)()"), ("inv", rf"{_RANGE}()inv()"), ("con", rf"{_RANGE}()con(.+)"))


def parsed(text: Column) -> Column:
    """struct<system, kind, acc, version, first, last, ref, alt> of a description in any coordinate system (g, c, n, m, r).

    Positions are kept as text, as they can be uncertain, in introns or outside of the coding part. The whole text must
    match; anything else is null.
    """
    out = F.lit(None)
    for kind, pattern in reversed(GRAMMAR):
        whole = rf"^([^:.]+)(?:\.([0-9]+))?:([gcnmr])\.{pattern}$"
        group = lambda n, w=whole: F.regexp_extract(text, w, n)
        found = F.struct(group(3).alias("system"), F.lit(kind).alias("kind"), group(1).alias("acc"), F.coalesce(group(2).try_cast("long"), F.lit(0).cast("long")).alias("version"), group(4).alias("first"), F.when(group(5) == "", group(4)).otherwise(group(5)).alias("last"), group(6).alias("ref"), group(7).alias("alt"))
        out = F.when(text.rlike(whole), found).otherwise(out)
    return out
