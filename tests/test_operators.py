import random

import pytest
from pyspark.sql import functions as F

from helixframe.operators import counts, features, intervals, reads, tables

CH = "chr string, start long, end long, name string"


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def random_intervals(seed, n=120, span=2000):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        a = rng.randrange(span)
        out.append((rng.choice(("a", "b")), a, a + rng.choice((0, 1, 5, 60, 900)), f"i{i}"))
    return out


def test_point_and_interval_joins(spark):
    iv = random_intervals(1)
    pts = [(c, p) for c in ("a", "b", "z") for p in range(0, 2900, 37)]
    i, p = spark.createDataFrame(iv, CH), spark.createDataFrame(pts, "chr string, pos long")
    brute = sorted((c, x, s, e, n) for c, x in pts for c2, s, e, n in iv if c == c2 and s <= x < e)
    for width in (16, 300, 1 << 14):
        assert rows(intervals.points_in(p, i, width=width)) == brute
        assert rows(intervals.points_in(p, i, how="left_semi", width=width)) == sorted({(c, x) for c, x, *_ in brute})
    other = random_intervals(2)
    b = spark.createDataFrame(other, "chr string, s2 long, e2 long, other string")
    for pad in (0, 25):
        brute = sorted((c, s, e, n, s2, e2, m) for c, s, e, n in iv for c2, s2, e2, m in other if c == c2 and s < e and s2 - pad < e2 + pad and s < e2 + pad and s2 - pad < e)
        assert rows(intervals.overlaps(i, b, a_range=("start", "end"), b_range=("s2", "e2"), pad=pad, width=50)) == brute
    assert rows(intervals.in_regions(p, i.limit(0))) == sorted(pts)


def test_segments_and_depths(spark):
    one = spark.createDataFrame([("x", 5, 10, "0"), ("x", 2, 6, "1")], CH)
    assert rows(intervals.segments(one, "name")) == [("x", 2, 5, ["1"]), ("x", 5, 6, ["0", "1"]), ("x", 6, 10, ["0"])]
    iv = random_intervals(3)
    df = spark.createDataFrame(iv, CH)
    depth = {}
    for c, s, e, _ in iv:
        for x in range(s, e):
            depth[c, x] = depth.get((c, x), 0) + 1
    for stretch in (64, 1 << 22):
        got = {(r.chr, x): r.depth for r in intervals.depths(df, stretch=stretch).collect() for x in range(r.start, r.end)}
        assert got == depth
    hist = {}
    for d in depth.values():
        hist[d] = hist.get(d, 0) + 1
    assert dict(rows(intervals.depth_histogram(df))) == hist
    assert rows(intervals.runs(spark.createDataFrame([("g", x) for x in (1, 2, 3, 7, 8, 12, 12)], "g string, n long"), "n", "g")) == [("g", 1, 3), ("g", 7, 8), ("g", 12, 12)]


READS = "name string, flags int, chr string, pos long, cigar string, seq string, tlen int"


def test_count_bases(spark):
    df = spark.createDataFrame([("r1", 0, "1", 10, "3M1I1M", "ACGTC", 5), ("r2", 16, "1", 10, "3M", "ACT", 5), ("r3", 4, "1", 10, "3M", "ACT", 5), ("r4", 0, "1", 11, "1M2D1M", "CA", 5)], READS)
    got = {r.pos: r for r in counts.count_bases(df).collect()}
    assert got[10].nA == 2 and got[11].nC == 3 and (got[12].nG, got[12].nT, got[12].nI) == (1, 1, 1) and got[12].indels == "^T=1"
    assert got[11].nD == 1 and got[11].indels == "*2=1" and got[14].nA == 1 and got[13].nC == 1
    region = spark.createDataFrame([("1", 11, 12)], "chr string, start long, end long")
    assert [r.pos for r in counts.count_bases(df, region).collect()] == [11]
    assert counts.count_bases(df, region.limit(0)).count() == 5


def test_merge_and_group(spark):
    ddl = "chr string, pos long, nA long, nC long, nG long, nT long, nN long, nX0 long, nX1 long, nI long, nD long, indels string"
    a = spark.createDataFrame([("1", 5, 1, 2, 0, 0, 0, 0, 0, 1, 0, "^A=1"), ("chr1", 5, 3, 0, 0, 0, 0, 0, 0, 1, 2, "*1=2;^A=1"), ("M", 1, 1, 0, 0, 0, 0, 0, 0, 0, 0, ""), ("chrM", 1, 1, 0, 0, 0, 0, 0, 0, 0, 0, "")], ddl)
    got = {(r.chr, r.pos): r for r in counts.merge_counts(a).collect()}
    assert len(got) == 3 and got["1", 5].nA == 4 and got["1", 5].indels == "*1=2;^A=2" and got["M", 1].indels == ""
    genes = spark.createDataFrame([("1", 0, 10, "g"), ("1", 3, 6, "g"), ("1", 5, 6, "h")], "chr string, start long, end long, gene string")
    assert rows(counts.group_counts(a.where("chr = '1'"), genes)) == [("g", 1, 4), ("h", 1, 4)]


def test_scores_to_calls(spark):
    ddl = "sample string, chr string, pos long, nA long, nC long, nG long, nT long, nN long, nX0 long, nX1 long, nI long, nD long, indels string"
    table = [(f"s{i}", "chr1" if i % 2 else "1", p, 200 + i, 3 * i, 0, 0, 0, 0, 0, 0, 0, "") for i in range(6) for p in (1, 2)]
    df = spark.createDataFrame(table, ddl)
    whole = counts.merge_counts(df)
    scores = counts.divergences(df, whole)
    assert scores.count() == 12 and scores.where("kld < -1e-12").isEmpty()
    assert counts.divergences(df, whole.where("pos = 1")).where("pos = 2 and kld <> 0").isEmpty()
    gamma = counts.gamma_fit(scores)
    parts = counts.gamma_fit(scores.where("sample < 's3'")).unionByName(counts.gamma_fit(scores.where("sample >= 's3'")))
    whole_fit, again = ({r.pos: r for r in x.collect()} for x in (gamma, counts.merge_gamma(parts)))
    assert all(whole_fit[p].n == again[p].n == 6 and whole_fit[p].k == pytest.approx(again[p].k) for p in (1, 2))
    tails = counts.tails(scores, gamma)
    assert tails.where("pval between 0 and 1").count() == 12
    with pytest.raises(Exception, match="no gamma parameters"):
        counts.tails(scores, gamma.where("pos = 1")).collect()
    bases = spark.createDataFrame([("chr1", 1, "a"), ("chr1", 2, "C"), ("1", 1, "A"), ("1", 2, "C")], "chr string, pos long, ref string")
    one = df.where("sample = 's3'").drop("sample")
    low = one.select("chr", "pos", F.lit(0.4).alias("kld"), F.lit(1e-6).alias("pval"))
    noted = {r.pos: r for r in counts.annotated(one, low, bases).collect()}
    assert (noted[1].ref, noted[1].alt, noted[1].cov) == ("A", "C", 212) and (noted[2].ref, noted[2].alt) == ("C", "A") and noted[1].vaf == pytest.approx(9 / 212)
    with pytest.raises(Exception, match="same loci"):
        counts.annotated(one, low.where("pos = 1"), bases).collect()
    calls = counts.vcf_lines(counts.variants(one, low, bases)).orderBy("pos").collect()
    assert [(r.pos, r.ref, r.alt, r.ac) for r in calls] == [(1, "A", "C", 9), (2, "C", "A", 203)]
    assert calls[0].line.startswith("chr1\t1\t.\tA\tC\t60.00\tPASS\tAC=9;AF=0.04;DP=212;") and calls[0].line.endswith("HGVSg=chr1:g.1A>C")


def test_features(spark):
    f = spark.createDataFrame([("g", None, "gene", "1", 0, 100), ("t1", "g", "transcript", "1", 0, 100), ("t2", "g", "mRNA", "1", 0, 100), ("e", "t1", "exon", "1", 10, 20), ("e", "t2", "exon", "1", 10, 20), ("e2", "t2", "exon", "1", 50, 60), ("c", "t2", "CDS", "1", 50, 60)], "id string, parent string, type string, chr string, start long, end long")
    r = spark.createDataFrame([("a", 0, "1", 5, "1M", "A", 6), ("b", 0, "1", 5, "1M", "A", 5), ("c", 4, "1", 5, "1M", "A", 9), ("d", 0, "1", 12, "1M", "A", 4097), ("e", 0, "1", 12, "1M", "A", 0)], READS)
    assert rows(features.exon_reads(r, f)) == [("e", "e/t1/g", 2), ("e", "e/t2/g", 2), ("e2", "e2/t2/g", 0)]
    with pytest.raises(ValueError):
        features.parent_paths(spark.createDataFrame([("a", "b"), ("b", "a")], "id string, parent string"))
    s = spark.createDataFrame([("x", "ACGTACGTAC")], "acc string, seq string")
    want = spark.createDataFrame([("x", 0, 4), ("x", 3, 9), ("x", 8, 20), ("y", 0, 2)], "acc string, begin long, end long")
    assert rows(features.slices(want, features.pieces(s, 4), 4)) == [("x", 0, 4, "ACGT"), ("x", 3, 9, "TACGTA"), ("x", 8, 20, "AC"), ("y", 0, 2, "")]


def test_read_operators(spark):
    rng = random.Random(5)
    seqs = ["".join(rng.choice("ACGT") for _ in range(80)) for _ in range(4)]
    seqs.append(seqs[0][10:60] + "ACACACACACAC")
    df = spark.createDataFrame(list(enumerate(seqs)), "seq_id long, seq string")
    k = 8
    sets = [{s[i : i + k] for i in range(len(s) - k + 1)} for s in seqs]
    label = {x: (next(i for i, y in enumerate(sets) if x in y) + 1 if sum(x in y for y in sets) == 1 else 0) for y in sets for x in y}
    assert dict(rows(reads.labels(df, k))) == label
    greedy = {}
    for s in seqs:
        last = {}
        for i in range(len(s) - k + 1):
            x = s[i : i + k]
            if i - last.get(x, -k) >= k:
                last[x] = i
                greedy[x] = greedy.get(x, 0) + 1
    assert dict(rows(reads.repeats(df, k))) == {x: n for x, n in greedy.items() if n > 1}
    rc = lambda s: s[::-1].translate(str.maketrans("ACGT", "TGCA"))
    pairs = spark.createDataFrame([(1, seqs[0][5:45], rc(seqs[1][3:40])), (2, seqs[2][:30], "NNNN"), (3, "", "")], "pair_id long, seq1 string, seq2 string")
    labelled = reads.labels(df, k)
    got = {r.pair_id: r for r in reads.pair_labels(pairs, labelled, k).collect()}
    assert 2 in got[1].lhs and 1 in got[1].lhs and got[2].lhs == [3] and got[3].lhs == got[3].rhs == []
    hit = reads.pulldown(pairs, df.select("seq"), k, 1, 1).first()
    assert (hit.pairs, hit.lhsFwd, hit.rhsRev) == (3, 2, 1)
    alleles = spark.createDataFrame([("l1", "a", seqs[0]), ("l1", "b", seqs[1]), ("l2", "c", seqs[3])], "locus string, allele string, seq string")
    n = {(r.locus, r.allele): r.n for r in reads.allele_counts(pairs, alleles, k).collect()}
    assert n["l1", "a"] >= 33 and n["l1", "b"] >= 30
    assert reads.allele_json(spark.createDataFrame([("l", "a", 2), ("l", "b", 1), ("m", "c", 4)], "locus string, allele string, n long")).first().json == '{"l":{"a":2,"b":1},"m":{"c":4}}'
    read = spark.createDataFrame([(9, seqs[3][20:70])], "read_id long, seq string")
    best = reads.placements(read, df, 25).orderBy(F.desc("hits")).first()
    assert (best.seq_id, best.shift, best.hits) == (3, 20, 26)
    sketch = reads.bottom_k(df, k, 10)
    assert sketch.count() == 10 and [r.hash for r in sketch.collect()] == sorted(r.hash for r in sketch.collect())
    assert reads.bottom_k_by(df, "seq_id", k, 5).count() == 25
    e = dict(rows(reads.entropy(spark.createDataFrame([(1, "AACC"), (2, "AAAA"), (3, ""), (4, "ACGT")], "seq_id long, seq string"))))
    assert e == pytest.approx({1: 1.0, 2: 0.0, 3: 0.0, 4: 2.0})


def test_tables(spark):
    a = spark.createDataFrame([(0, "x"), (1, "y")], "idx long, l string")
    b = spark.createDataFrame([(0, "p"), (1, "q"), (2, "r")], "idx long, r string")
    assert rows(tables.zipped(a, b.where("idx < 2"))) == [(0, "x", "p"), (1, "y", "q")]
    with pytest.raises(Exception, match="unequal"):
        tables.zipped(a, b).collect()
    c = spark.createDataFrame([(1, 5), (2, 6)], "k long, v long")
    d = spark.createDataFrame([(2, 10), (3, 1)], "k long, v long")
    assert rows(tables.combined(c, d, ["k"], lambda _, x, y: x + y)) == [(1, 5), (2, 16), (3, 1)]
    o = spark.createDataFrame([("g", 0, 1), ("g", 1, 3), ("g", 2, 3), ("g", 3, 9)], "g string, i long, k long")
    assert rows(tables.out_of_order(o, ["g"], "i", ["k"])) == [("g", 2, 3)]
    with pytest.raises(Exception, match="out of order"):
        tables.in_order(o, ["g"], "i", ["k"]).collect()
    assert tables.in_order(o.where("i <> 2"), ["g"], "i", ["k"]).count() == 3
    assert sorted(r.part for r in tables.dealt(b, 2).collect()) == [0, 0, 1]
    assert tables.columns_copied(b, 1, 2).columns == ["r"] and tables.columns_copied(b, 1, 2, at=1, onto=a, on="idx").columns == ["idx", "r", "l"]
    v = spark.createDataFrame([(x,) for x in (5, 5, 9, 2)], "value long")
    assert rows(tables.ranks(v, spark.createDataFrame([(x,) for x in (0, 5, 6, 100)], "query long"))) == [(0, 0), (5, 1), (6, 2), (100, 3)]
    assert rows(tables.selected(v, spark.createDataFrame([(0,), (2,)], "place long"))) == [(0, 2), (2, 9)]


def test_bases_of_a_stored_genome(spark):
    stored = features.pieces(spark.createDataFrame([("chr1", "acgtACGTNN"), ("chr2", "TT")], "acc string, seq string"), 4)
    loci = spark.createDataFrame([("chr1", p) for p in range(0, 13)] + [("chr2", 2), ("chr3", 1), ("chr1", 5)], "chr string, pos long")
    got = {(r.chr, r.pos): r.ref for r in features.bases_at(loci, stored, 4).collect()}
    assert got == {**{("chr1", i + 1): b for i, b in enumerate("ACGTACGTNN")}, ("chr2", 2): "T"}


def test_intervals_saved_and_loaded(spark, tmp_path):
    rows = [("chr2", 5, 9, "b"), ("chr1", 7, 8, "a"), ("chr1", 1, 3, None)]
    df = spark.createDataFrame(rows, "chr string, start long, end long, gene string")
    intervals.save(df, f"file://{tmp_path}/set")
    assert sorted(map(str, intervals.load(spark, f"file://{tmp_path}/set").collect())) == sorted(map(str, df.collect()))


def test_all_kinds_on_transcripts(spark):
    exons = [(1000, 1030), (1045, 1060), (1075, 1090)]
    tx = [(f"NM_{s}", "chr1", s, 1000, 1090, 1015, 1070, exons) for s in "+-"]
    transcripts = spark.createDataFrame(tx, "accession string, chr string, strand string, txStart long, txEnd long, cdsStart long, cdsEnd long, exons array<struct<first:long,last:long>>")
    rows = [("sub", 1020, 1020, "A", "C"), ("del", 1020, 1022, "ACG", ""), ("ins", 1020, 1021, "", "GAT"), ("delins", 1029, 1031, "ACG", "TT"), ("dup", 1050, 1050, "T", ""), ("inv", 1017, 1018, "AC", "GT"), ("id", 1020, 1020, "A", "A")]
    df = spark.createDataFrame([("chr1", *r) for r in rows], "chr string, kind string, first long, last long, dref string, dalt string")
    got = {(r.kind, r.accession): r.hgvsc for r in features.described_on_transcripts(df, transcripts).collect()}
    one = {(r.pos, r.accession): (r.zone, r.place, r.rel) for r in features.on_transcripts(spark.createDataFrame([("chr1", p, "A", "C") for p in range(1010, 1055)], "chr string, pos long, ref string, alt string"), transcripts).collect()}

    def place(p, acc):
        zone, at, rel = one[p, acc]
        return ("*" if zone == "UTR3" else "") + str(at) + ("" if zone == "CODING" else f"{rel:+d}" if rel or zone == "INTRON" else "")

    turned = str.maketrans("ACGT", "TGCA")
    for kind, a, z, ref, alt in rows:
        for acc in ("NM_+", "NM_-"):
            low, high = (place(z, acc), place(a, acc)) if acc == "NM_-" else (place(a, acc), place(z, acc))
            r, t = (x[::-1].translate(turned) if acc == "NM_-" else x for x in (ref, alt))
            at = low if a == z else f"{low}_{high}"
            want = {"sub": f"{at}{r}>{t}", "del": f"{at}del", "ins": f"{at}ins{t}", "delins": f"{at}delins{t}", "dup": f"{at}dup", "inv": f"{at}inv", "id": f"{at}="}[kind]
            assert got[kind, acc] == f"{acc}:c.{want}"
