import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from helixframe.functions import alignment, chrom, coding, kmers, registry, stats, text, variants
from helixframe.operators import features, hash_search

SEQ = "AGCCAGTTCCGGGTGTCGCCGCTGGATCGGACCTGGAACCTGGGCGAGACAGTGGAGCTG"


def found(df):
    return [tuple(r) for r in df.collect()]


def test_kmers(spark):
    got = found(kmers.kmers(spark.createDataFrame([(1, SEQ)], "id int, seq string"), 5, "id").orderBy("pos"))
    assert len(got) == 56 and got[0][2] == "AGCCA" and got[5][2] == "GTTCC" and got[55][2] == "AGCTG"
    with_n = SEQ[:30] + "N" + SEQ[31:]
    got = found(kmers.kmers(spark.createDataFrame([(1, with_n.lower())], "id int, seq string"), 5, "id").orderBy("pos"))
    assert len(got) == 51 and got[25][2] == "ATCGG"
    assert found(kmers.kmers(spark.createDataFrame([(1, "ACG"), (2, ""), (3, None), (4, "é" * 9)], "id int, seq string"), 5, "id")) == []


def test_strands_and_packing(spark):
    df = spark.createDataFrame([("AGCCA",)], "kmer string")
    assert sorted(found(kmers.both_strands(df.withColumn("pos", F.lit(0))).select("strand", "kmer"))) == [("+", "AGCCA"), ("-", "TGGCT")]
    row = df.select(kmers.packed(F.col("kmer")).alias("x"), kmers.canonical(F.col("kmer")).alias("c")).withColumn("back", kmers.unpacked(F.col("x"), 5)).first()
    assert (row.x, row.c, row.back) == (0b0010010100, "AGCCA", "AGCCA")
    pair = spark.createDataFrame([("ACGT", "TCGA")], "a string, b string").select(kmers.hamming(kmers.packed(F.col("a")), kmers.packed(F.col("b")))).first()
    assert pair[0] == 2
    assert spark.createDataFrame([("acgtn",), ("ACX",)], "s string").select(kmers.complemented(F.col("s"))).collect() == [("NACGT",), (None,)]


def murmur(x, seed):
    m, h = 0xFFFFFFFF, seed
    roll = lambda v, r: (v << r | v >> 32 - r) & m
    for k in (x >> 32 & m, x & m):
        h = (roll(h ^ roll(k * 0xCC9E2D51 & m, 15) * 0x1B873593 & m, 13) * 5 + 0xE6546B64) & m
    h ^= 8
    for s, f in ((16, 0x85EBCA6B), (13, 0xC2B2AE35)):
        h = (h ^ h >> s) * f & m
    return h ^ h >> 16


def test_hashes(spark):
    rng = random.Random(3)
    xs = [0, 1, 2**62 - 1, *(rng.getrandbits(62) for _ in range(300))]
    df = spark.createDataFrame([(x,) for x in xs], "x long")
    assert {r.x: r.h for r in kmers.with_hash32(df, "x", "h", 17).collect()} == {x: murmur(x, 17) for x in xs}
    few = kmers.with_hash32(df, "x", "h", 17).where("h % 4 = 0").count()
    assert few == sum(murmur(x, 17) % 4 == 0 for x in xs)
    m = (1 << 64) - 1

    def rotated(h):
        for c, a, b in kmers.ROUNDS:
            h = h * c & m
            h ^= (h << a | h >> 64 - a) & m
            h ^= (h >> b | h << 64 - b) & m
        return h

    got = {r.x: r.h & m for r in df.select("x", kmers.mixed64(F.lit(5).cast("long"), F.col("x")).alias("h")).collect()}
    assert got == {x: rotated(5 ^ x) for x in xs}
    text_hash = spark.createDataFrame([("abcdefghij",)], "t string").select(kmers.mixed64_text(F.lit(1).cast("long"), F.col("t"))).first()[0] & m
    assert text_hash == rotated(rotated(1 ^ int.from_bytes(b"abcdefgh", "big")) ^ int.from_bytes(b"ij", "big"))


def test_upper_gamma_against_closed_form():
    for k in (1, 2, 5, 12):
        for x in (0.01, 0.5, 3.0, 11.0, 40.0, 300.0):
            exact = math.exp(-x) * sum(x**i / math.factorial(i) for i in range(k))
            assert stats.upper_gamma(np.array([k]), np.array([x]))[0] == pytest.approx(exact, rel=1e-9)
    # Half-integer shape: the complementary error function.
    assert stats.upper_gamma(np.array([0.5]), np.array([2.0]))[0] == pytest.approx(math.erfc(math.sqrt(2.0)), rel=1e-12)
    assert stats.upper_gamma(np.array([0.0, 0.0, 3.0]), np.array([0.0, 1.0, -1.0])).tolist() == [1.0, 0.0, 1.0]
    assert math.isnan(stats.upper_gamma(np.array([np.nan]), np.array([1.0]))[0])
    assert stats.lgamma(np.array([0.1, 1.0, 7.5, 200.0])) == pytest.approx([math.lgamma(x) for x in (0.1, 1.0, 7.5, 200.0)], rel=1e-12, abs=1e-12)


def test_divergence_and_fit(spark):
    df = spark.createDataFrame([(10, 0, 5, 5), (0, 0, 5, 5), (3, 4, 0, 9), (6, 2, 30, 10)], "a int, b int, c int, d int")
    got = [r[0] for r in df.select(stats.kld([F.col("a"), F.col("b")], [F.col("c"), F.col("d")])).collect()]
    assert got[0] == pytest.approx(math.log(2)) and got[1] == 0 and got[2] == math.inf and got[3] == pytest.approx(0)
    x = 0.0240453
    sums = spark.createDataFrame([(n, n * x, n * math.log(x), n * x * math.log(x)) for n in (2, 100)], "n long, sx double, slx double, sxlx double")
    for k, theta in sums.select(*stats.gamma_parameters(*(F.col(c) for c in ("n", "sx", "slx", "sxlx")))).collect():
        assert math.isfinite(k) and math.isfinite(theta) and theta == 0.01
    assert spark.range(1).select(stats.phred(F.lit(0.0)), stats.phred(F.lit(0.001)), stats.human(F.lit(1234)), stats.human(F.lit(12)), stats.ratio(F.lit(0), F.lit(0))).first()[:4] == (math.inf, 30.0, "1.23K", "12.00")


def test_locus_order(spark):
    df = spark.createDataFrame([("234", 1), ("1000", 1), ("chr10", 1), ("2", 1), ("1", 5), ("chr1", 2), ("X", 1), ("chrM", 1)], "chr string, pos long")
    assert [r.chr for r in df.orderBy(*chrom.locus_order()).collect()] == ["1", "chr1", "2", "chr10", "X", "1000", "234", "chrM"]
    keys = {r[0]: r[1] for r in df.select("chr", chrom.chr_key(F.col("chr"))).collect()}
    assert keys["1"] == keys["chr1"] and keys["chrM"] == "raw:chrM"


def test_genome_axis(spark):
    g = chrom.genome_map(spark, '{"b": 10, "a": 5, "c": 7}')
    loci = spark.createDataFrame([("a", 0), ("b", 9), ("c", 6), ("zz", 1)], "chr string, pos long")
    linear = chrom.to_linear(loci, g, missing="drop")
    with pytest.raises(Exception, match="no such sequence: zz"):
        chrom.to_linear(loci, g).collect()
    assert {r.chr: r.linear for r in chrom.to_linear(loci, g, missing="null").collect()}["zz"] is None
    assert sorted(r.linear for r in linear.collect()) == [0, 14, 21]
    off = spark.createDataFrame([(22,), (-1,)], "linear long")
    assert sorted((r.chr, r.pos) for r in chrom.from_linear(linear.select("linear").unionByName(off), g).collect()) == [("a", 0), ("b", 9), ("c", 6)]
    assert sum(chrom.HG38.values()) > 3_080_000_000 and len(chrom.HG19) == 91 and sum(chrom.HG19.values()) == 3136851001


def test_cigar_and_flags(spark):
    df = spark.createDataFrame([("27M1I47M",), ("*",), ("3Q",)], "c string").select(alignment.cigar_ops(F.col("c")).alias("o"))
    assert [r.o and [(x.op, x.len) for x in r.o] for r in df.collect()] == [[("M", 27), ("I", 1), ("M", 47)], None, None]
    long = spark.createDataFrame([("1M1I" * 50_000,)], "c string").select(F.size(alignment.cigar_ops(F.col("c")))).first()
    assert long[0] == 100_000
    row = spark.createDataFrame([(163,)], "f int").select(*(alignment.flag(n, F.col("f")).alias(n) for n in alignment.FLAGS)).first()
    assert row.read_2 and row.paired and row.proper_pair and row.mate_reverse and not row.read_1 and not row.unmapped


def test_atoms(spark):
    reads = spark.createDataFrame([("1", 100, "2S3M1I2M2D2M", "TTACGAGTCA"), ("1", 5, "*", "AC"), ("2", 7, "2H2M1S", "ACG")], "chr string, pos long, cigar string, seq string")
    got = sorted(found(alignment.atoms(reads)))
    assert got == sorted([("1", 99, "<"), ("1", 100, "A"), ("1", 101, "C"), ("1", 102, "G"), ("1", 102, "I"), ("1", 102, "^A"), ("1", 103, "G"), ("1", 104, "T"), ("1", 104, "D"), ("1", 104, "*2"), ("1", 107, "C"), ("1", 108, "A"), ("2", 7, "A"), ("2", 8, "C"), ("2", 8, ">")])
    with pytest.raises(Exception, match="not supported"):
        alignment.atoms(spark.createDataFrame([("1", 1, "2N", "AC")], "chr string, pos long, cigar string, seq string")).collect()


def test_typed_columns(spark):
    df = spark.createDataFrame([("1", "7", "x;y", "a=b=c;d=1", "k=2.5")], "i string, u string, l string, kv string, p string")
    types = {"i": "int", "u": "uint", "l": "[str]", "kv": "[str=str]", "p": "str=flt"}
    row = text.typed(df, types).first()
    assert (row.i, row.u, row.l, [tuple(x) for x in row.kv], tuple(row.p)) == (1, 7, ["x", "y"], [("a", "b=c"), ("d", "1")], ("k", 2.5))
    assert tuple(text.untyped(text.typed(df, types), types).first()) == ("1", "7", "x;y", "a=b=c;d=1", "k=2.5")
    with pytest.raises(ValueError):
        text.column_type("nope")
    with pytest.raises(Exception, match="unsigned"):
        text.typed(spark.createDataFrame([("-1",)], "u string"), {"u": "uint"}).collect()


GENOMIC = [("chr1:g.12345A>C", "sub"), ("chr1:g.12345_12346insACGT", "ins"), ("chr1:g.12345del", "del"), ("chr1:g.12345_12350del", "del"), ("chr1:g.12345delinsAC", "delins"), ("chr1:g.1_4delinsAC", "delins"), ("chr1:g.5dup", "dup"), ("chr1:g.5_7inv", "inv")]


def test_genomic_round_trip(spark):
    df = spark.createDataFrame([(t,) for t, _ in GENOMIC] + [("chr1:g.x",), ("none",)], "t string").withColumn("v", variants.parsed_genomic(F.col("t")))
    v = F.col("v")
    rows = df.select("t", v["kind"].alias("kind"), variants.genomic(v["acc"], *(v[c] for c in ("kind", "first", "last", "ref", "alt"))).alias("back")).collect()
    assert [(r.t, r.kind) for r in rows[:-2]] == GENOMIC and all(r.back == r.t for r in rows[:-2]) and rows[-1].kind is None and rows[-2].kind is None


def test_general_notation(spark):
    cases = {
        "NC_000023.10:g.33038255C>A": ("g", "sub", "NC_000023", 10, "33038255", "33038255", "C", "A"),
        "NG_012232.1:g.19_21delTCA": ("g", "del", "NG_012232", 1, "19", "21", "TCA", ""),
        "NC_000023.10:g.33038255=": ("g", "id", "NC_000023", 10, "33038255", "33038255", "", ""),
        "NM_1.2:c.-5+3_*7-2del": ("c", "del", "NM_1", 2, "-5+3", "*7-2", "", ""),
        "NM_1:c.(4_?)_(9_11)insACG": ("c", "ins", "NM_1", 0, "(4_?)", "(9_11)", "", "ACG"),
        "NC_1.1:g.4A>C trailing": None,
    }
    df = spark.createDataFrame([(t,) for t in cases], "t string").select("t", variants.parsed(F.col("t")).alias("v"))
    assert {r.t: r.v and tuple(r.v) for r in df.collect()} == cases


def test_alleles_described(spark):
    df = spark.createDataFrame([("1", 10, "A", "G,AT"), ("1", 20, "GAT", "G"), ("1", 30, "ACGT", "ATT"), ("1", 40, "AGAA", "ATTC"), ("1", 50, "AC", "AC")], "chr string, pos long, ref string, alt string")
    got = [(r.kind, r.first, r["last"], r.dalt) for r in variants.described(df).collect()]
    assert got == [("sub", 10, 10, "G"), ("ins", 10, 11, "T"), ("del", 21, 22, ""), ("delins", 31, 33, "TT"), ("inv", 41, 43, "TTC"), ("id", 50, 51, "AC")]
    assert variants.described(df.where("pos = 50"), compat=True).first().kind == "delins"
    assert variants.described(df, compat=True).collect()[2]["last"] == 23


def test_transcript_text(spark):
    cases = [("UTR5", -5, 0, "-5"), ("UTR5", -5, -7, "-5-7"), ("UTR5", -6, 7, "-6+7"), ("UTR3", 5, 0, "*5"), ("UTR3", 6, -7, "*6-7"), ("INTRON", 5, 7, "5+7"), ("CODING", 8, 0, "8")]
    df = spark.createDataFrame(cases, "z string, p long, r long, t string")
    assert all(a == b for a, b in df.select(variants.locus_text(F.col("z"), F.col("p"), F.col("r")), "t").collect())


# Published transcripts and positions on them (fixed values).
KRAS = ("-", 25357722, 25403865, 25368374, 25398318, [(25357722, 25362845), (25368370, 25368494), (25378547, 25378707), (25380167, 25380346), (25398207, 25398329), (25403684, 25403865)])
PBX1 = ("+", 164528596, 164821067, 164529059, 164790820, [(164528596, 164529250), (164532474, 164532548), (164761730, 164761975), (164768935, 164769126), (164776778, 164776914), (164781226, 164781386), (164790773, 164790863), (164815820, 164821067)])
BRCA2 = ("+", 32889616, 32973809, 32890597, 32972907, [(32889616, 32889804), (32890558, 32890664), (32893213, 32893462), (32972298, 32973809)])
MSH2 = ("+", 47630205, 47710367, 47630330, 47710088, [(47630205, 47630541), (47635539, 47635694), (47637232, 47637511), (47639552, 47639699), (47641407, 47641557), (47643434, 47643568), (47656880, 47657080), (47672686, 47672796), (47690169, 47690293), (47693796, 47693947), (47698103, 47698201), (47702163, 47702409), (47703505, 47703710), (47705410, 47705658), (47707834, 47708010), (47709917, 47710367)])
PLACES = [
    (MSH2, 47630152, "UTR5", -179, 0), (MSH2, 47710431, "UTR3", 343, 0), (MSH2, 47630221, "UTR5", -110, 0), (MSH2, 47710151, "UTR3", 63, 0), (MSH2, 47635539, "INTRON", 212, -1), (MSH2, 47641407, "INTRON", 793, -1), (MSH2, 47641558, "INTRON", 942, 1),
    (BRCA2, 32889968, "UTR5", -40, 164), (PBX1, 164790997, "UTR3", 43, 134),
    (KRAS, 25403868, "UTR5", -195, 0), (KRAS, 25362777, "UTR3", 73, 0), (KRAS, 25368206, "UTR3", 4, 165), (KRAS, 25363051, "UTR3", 5, -206), (KRAS, 25398325, "UTR5", -7, 0), (KRAS, 25398405, "UTR5", -11, -76), (KRAS, 25403680, "UTR5", -12, 5), (KRAS, 25398309, "CODING", 10, 0), (KRAS, 25398207, "INTRON", 111, 1), (KRAS, 25380360, "INTRON", 112, -14),
]
TX = "struct<strand:string,txStart:bigint,txEnd:bigint,cdsStart:bigint,cdsEnd:bigint,exons:array<struct<first:bigint,last:bigint>>>"


def test_transcript_places(spark):
    df = spark.createDataFrame([(i, t, g) for i, (t, g, *_) in enumerate(PLACES)], f"i int, tx {TX}, g long")
    got = df.orderBy("i").select(variants.transcript_locus(F.col("g")).alias("l")).select("l.*").collect()
    assert [tuple(r) for r in got] == [x[2:] for x in PLACES]
    first = spark.createDataFrame([(MSH2, 47630331)], f"tx {TX}, g long")
    assert tuple(first.select(variants.transcript_locus(F.col("g")).alias("l")).select("l.*").first()) == ("CODING", 1, 0)
    assert first.select(variants.transcript_locus(F.col("g"), compat=True).alias("l")).first().l.pos == -1


def test_transcripts_near(spark):
    tx = spark.createDataFrame([("NM_1", "chr2", 1000, 2000), ("NM_2", "chr2", 2300, 2400), ("NM_3", "chr3", 1000, 2000)], "accession string, chr string, txStart long, txEnd long")
    loci = spark.createDataFrame([("chr2", 2100), ("chr2", 2249), ("chr2", 2250), ("chr2", 2650)], "chr string, pos0 long")
    got = sorted((r.pos0, r.accession) for r in features.transcripts_near(loci, tx).collect())
    assert got == [(2100, "NM_1"), (2100, "NM_2"), (2249, "NM_1"), (2249, "NM_2"), (2250, "NM_2")]


def test_byte_codes(spark):
    cases = {0: [0], 1: [2], 123: [246], 1234: [19, 164], 2**62 + 5: None}
    df = spark.createDataFrame([(x,) for x in cases], "x long").withColumn("c", coding.vbyte(F.col("x"))).withColumn("back", coding.from_vbyte(F.col("c")))
    rows = df.collect()
    assert all(r.back == r.x and (cases[r.x] is None or r.c == cases[r.x]) for r in rows)
    texts = spark.createDataFrame([("é" * 9,), ("",), (None,)], "t string").select("t", coding.gunzipped(coding.gzipped(F.col("t"))).alias("u"))
    assert all(r.t == r.u for r in texts.collect())


def test_more_statistics(spark):
    df = spark.createDataFrame([([0.5, 0.5], [0.25, 0.75]), ([1.0, 0.0], [1.0, 0.0])], "p array<double>, q array<double>")
    got = [r[0] for r in df.select(stats.relative_entropy(F.col("p"), F.col("q"))).collect()]
    assert got == pytest.approx([0.5 * math.log(2) + 0.5 * math.log(2 / 3), 0.0])
    with pytest.raises(Exception, match="no probability"):
        spark.createDataFrame([([1.0], [0.0])], "p array<double>, q array<double>").select(stats.relative_entropy(F.col("p"), F.col("q"))).collect()
    k, theta = spark.createDataFrame([(4, 20.0, 120.0)], "n long, sx double, sxx double").select(*stats.moments(F.col("n"), F.col("sx"), F.col("sxx"))).first()
    assert (k, theta) == pytest.approx((5.0, 1.0))


def test_coding_notation_and_loci(spark):
    df = spark.createDataFrame([(("UTR5", -6, 7), ("CODING", 2, 0)), (("UTR3", 3, 0), ("UTR3", 3, 0))], "a struct<zone:string,pos:bigint,rel:bigint>, b struct<zone:string,pos:bigint,rel:bigint>")
    texts = lambda kind: [r[0] for r in df.select(variants.coding(F.lit("NM_1.1"), F.lit(kind), F.col("a"), F.col("b"), F.lit("A"), F.lit("C"))).collect()]
    assert texts("del") == ["NM_1.1:c.-6+7_2del", "NM_1.1:c.*3del"] and texts("sub")[1] == "NM_1.1:c.*3A>C" and texts("delins")[0] == "NM_1.1:c.-6+7_2delinsC"
    at = spark.createDataFrame([("chr1:55",), ("x",)], "t string").select(variants.parsed_locus(F.col("t"))).collect()
    assert tuple(at[0][0]) == ("chr1", 55) and at[1][0] is None


def test_hash_search(spark):
    rows = hash_search.search(spark, 6, values=4096).collect()
    assert len(rows) == 6 and all(len(r.lefts) == 2 and 0 <= r.p_bits <= 1 and 0 <= r.p_bins <= 1 for r in rows) and rows == hash_search.search(spark, 6, values=4096).collect()
    assert hash_search.scores(np.zeros(1000, dtype=np.uint64))[1] < 1e-9


def test_numbers_as_the_c_library_writes_them(spark):
    df = spark.createDataFrame([(0.165,), (0.125,), (1.0,), (1e-5,), (0.0001,), (123.0,), (None,), (0.0,)], "x double")
    got = [tuple(r) for r in df.select(text.formatted("%.2f", F.col("x")), text.formatted("%2.2g", F.col("x"))).collect()]
    assert got == [("0.17", "0.17"), ("0.12", "0.12"), ("1.00", " 1"), ("0.00", "1e-05"), ("0.00", "0.0001"), ("123.00", "1.2e+02"), (None, None), ("0.00", " 0")]


def test_ropes(spark):
    df = spark.createDataFrame([("abcdef", 2, 4), ("", 0, 3), ("xyz", -1, 99), (None, 0, 1)], "s string, a int, b int")
    cut = text.split_at(F.col("s"), F.col("b"))
    got = [tuple(r) for r in df.select(text.sliced(F.col("s"), F.col("a"), F.col("b")), cut["left"], cut["right"], text.found_at(F.col("s"), F.lit("c")), text.joined(F.col("s"), F.lit("!"))).collect()]
    assert got == [("cd", "abcd", "ef", 2, "abcdef!"), ("", "", "", 0, "!"), ("xyz", "xyz", "", 3, "xyz!"), (None, None, None, None, None)]


def test_functions_by_name(spark):
    names = registry.register(spark, "t_")
    assert len(names) == len(registry.FUNCTIONS)
    row = spark.sql("select t_revcomp('acgn'), t_canonical_kmer('TTG'), t_kmer_pack('ACGT'), t_kmer_unpack(27, 4), t_kmer_distance(27, 24), t_chrom_rank('chrX'), t_chrom_rank('7'), t_chrom_rank('chrM'), t_phred(0.001D), t_flag_set(5, 4), t_info_value('a=1;b=2=3', 'b'), t_gc_fraction('')").first()
    assert tuple(row) == ("NCGT", "CAA", 27, "ACGT", 1, 23, 7, None, 30.0, True, "2=3", None)


def test_hash_scores_of_both_kinds():
    values = kmers.multiply_rotate(np.arange(20_000, dtype=np.uint64))
    (a, p, x), (b, q, y) = hash_search.scores(values), hash_search.scores(values, compat=True)
    assert a == pytest.approx(2 * b) and x == y and 0 < p < 1 and q > 0.99


def test_text_hash_of_all_lengths(spark):
    texts = ["", "a", "12345678", "123456789", "x" * 40, "\u00e9\u00e9"]
    want = []
    for t in texts:
        h, raw = np.array([17], dtype=np.uint64), t.encode()
        for i in range(0, len(raw), 8):
            h = kmers.multiply_rotate(h ^ np.uint64(int.from_bytes(raw[i : i + 8], "big")))
        want.append(int(h.view(np.int64)[0]))
    assert [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(kmers.mixed64_text(F.lit(17).cast("long"), F.col("t"))).collect()] == want


def test_packed_kmers_against_cut_ones(spark, monkeypatch):
    monkeypatch.setattr(kmers, "AT_ONCE", 64)  # longer ones are cut with overlaps
    rng = random.Random(12)
    seqs = ["", "ACG", None, "acgtNNacgta" * 3, *("".join(rng.choice("ACGTacgtN") for _ in range(rng.randrange(300))) for _ in range(12)), "AT" * 200]
    df = spark.createDataFrame(list(enumerate(seqs)), "id long, seq string")
    for k in (1, 4, 7, 31):
        cut = kmers.both_strands(kmers.kmers(df, k, "id")).select("id", "strand", kmers.packed(F.col("kmer")).alias("x")).collect()
        both = {}
        for r in kmers.packed_kmers(df, k, "id", strands="both").collect():
            both[r.id, r.strand, r.x] = both.get((r.id, r.strand, r.x), 0) + r.n
        assert both == Counter((r.id, r.strand, r.x) for r in cut)
        one = {}
        for r in kmers.packed_kmers(df, k).collect():
            one[r.x, r.palindrome] = one.get((r.x, r.palindrome), 0) + r.n
        text_of = lambda x: "".join("ACGT"[x >> 2 * i & 3] for i in range(k - 1, -1, -1))  # noqa: B023, E731
        rc = lambda t: t[::-1].translate(str.maketrans("ACGT", "TGCA"))
        want = Counter(min(text_of(r.x), rc(text_of(r.x))) for r in cut if r.strand == "+")
        assert {(text_of(x), p): n for (x, p), n in one.items()} == {(t, t == rc(t)): n for t, n in want.items()}
    with pytest.raises(ValueError):
        kmers.packed_kmers(df, 32)


def test_hash_of_arrays_is_the_hash_of_columns(spark):
    x = [0, 1, (1 << 62) - 1, 123456789012345, 0xFFFFFFFF, 1 << 32]
    got = kmers.with_hash32(spark.createDataFrame([(v,) for v in x], "x long"), "x", "h", 17).collect()
    assert {r.x: r.h for r in got} == dict(zip(x, kmers.hash32(np.array(x, dtype=np.uint64), 17).tolist(), strict=True))
