"""Alignment flags, CIGAR strings and the base events they stand for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: Bits of the flag column, from the lowest (fixed values).
FLAGS = ("paired", "proper_pair", "unmapped", "mate_unmapped", "reverse", "mate_reverse", "read_1", "read_2", "secondary", "qc_fail", "duplicate", "supplementary")


def flag(name: str, flags: Column) -> Column:
    return flags.bitwiseAND(F.lit(1 << FLAGS.index(name))) != 0


def cigar_ops(cigar: Column) -> Column:
    """array<struct<op, len>> in order; null for "*" or another malformed text."""
    ops = F.regexp_extract_all(cigar, F.lit("([0-9]+)([MIDNSHP=X])"), 2)
    lens = F.transform(F.regexp_extract_all(cigar, F.lit("([0-9]+)([MIDNSHP=X])"), 1), lambda n: n.cast("long"))
    found = F.zip_with(ops, lens, lambda o, n: F.struct(o.alias("op"), n.alias("len")))
    # A pattern for the whole would nest once for each operation, of which long reads have many thousands.
    return F.when((cigar != "") & (F.regexp_replace(cigar, "[0-9]+[MIDNSHP=X]", "") == ""), found)


def atoms(reads: DataFrame) -> DataFrame:
    """(chr, pos, atom) of every event of ``reads`` (chr, pos, cigar, seq).

    A matched base gives its letter. An insertion gives I and ^letters at the base before it, a deletion D and *length
    there, a clipped end < at the base before a first operation and > after a later one. Hard clips give nothing; other
    operations are an error. Each operation finds its place from those before it, then only matches are exploded by base.
    """
    o = F.col("__o")
    ops = reads.where("cigar <> '*'").withColumn("__ops", cigar_ops(F.col("cigar"))).select("chr", "pos", "seq", "__ops", F.posexplode("__ops").alias("__i", "__o"))

    def before(kinds: str) -> Column:
        counted = F.filter(F.slice("__ops", F.lit(1), F.col("__i")), lambda x: x["op"].isin(*kinds))
        return F.aggregate(counted, F.lit(0).cast("long"), lambda a, x: a + x["len"])

    placed = ops.select("chr", (F.col("pos") + before("MD")).alias("at"), (before("MIS") + 1).alias("from"), "seq", o["op"].alias("op"), o["len"].alias("len"), (F.col("__i") == 0).alias("first"))
    bad = F.when(~F.col("op").isin(*"MIDSH"), F.raise_error(F.concat(F.lit("alignment operation not supported: "), "op")))
    piece = lambda start, n: F.expr(f"substring(seq, cast({start} as int), cast({n} as int))")
    before_base = F.col("at") - 1
    one = lambda pos, atom: F.struct(pos.alias("pos"), atom.alias("atom"))
    events = (
        F.when(F.col("op") == "M", F.transform(F.sequence(F.lit(0).cast("long"), F.col("len") - 1), lambda i: one(F.col("at") + i, F.substring(F.substring(F.col("seq"), F.col("from").cast("int"), F.col("len").cast("int")), i.cast("int") + 1, F.lit(1)))))
        .when(F.col("op") == "I", F.array(one(before_base, F.lit("I")), one(before_base, F.concat(F.lit("^"), piece("from", "len")))))
        .when(F.col("op") == "D", F.array(one(before_base, F.lit("D")), one(before_base, F.concat(F.lit("*"), F.col("len").cast("string")))))
        .when(F.col("op") == "S", F.array(one(before_base, F.when(F.col("first"), "<").otherwise(">"))))
        .otherwise(bad.cast("array<struct<pos:bigint,atom:string>>"))
    )
    live = placed.where("op <> 'H'")
    return live.select("chr", F.explode(events).alias("e")).select("chr", "e.pos", "e.atom")
