"""Decontamination, near duplicates, repeats, neighbours, archives and the pipeline: against brute force, with odd cases."""

import base64
import gzip
import hashlib
import io
import itertools
import os
import random
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from helixframe.llm import components as cc, decontamination as dc, language, near_dedup as nd, neighbours as nb, queries, substring_dedup as sd, warc

DDL = "doc_id long, text string"
CLASH = ("key", "z", "keys", "cid", "u", "v", "home", "fp", "n", "windows", "component_id", "kept", "item_id", "s", "h", "b", "__row", "vec_id", "list", "q", "file", "url", "text_key", "matches", "window")


def clashing(df):
    for c in CLASH:
        if c not in df.columns:
            df = df.withColumn(c, F.lit("clash"))
    return df


def words(rng, n, vocabulary=4000):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def corpus(seed=1):
    """Texts with exact copies, near copies of several degrees, shared passages, repeats inside, and odd rows."""
    rng = random.Random(seed)
    docs, passage = [], words(rng, 60)
    for _ in range(25):
        base = words(rng, rng.choice((3, 8, 40, 150)))
        docs.append(base)
        for _ in range(rng.randrange(6)):
            copy = list(base)
            for _ in range(rng.choice((0, 1, 2, 8))):
                copy[rng.randrange(len(copy))] = f"x{rng.randrange(10**6)}"
            docs.append(copy if rng.random() < 0.8 else [*words(rng, 5), *copy])
    for _ in range(30):
        docs.append([*words(rng, rng.randrange(30)), *passage[rng.randrange(30) : rng.randrange(30, 61)], *words(rng, rng.randrange(40))])
    docs += [["the"] * 90, ["the"] * 36, ["a", "b"] * 40, words(rng, 20_000)]
    out = [(i, " \n".join(d) if i % 3 else " ".join(d).upper()) for i, d in enumerate(docs)]
    rng.shuffle(out)
    return [*out, (9000, None), (9001, ""), (9002, " \t\n"), (9003, "One two"), (9004, "one TWO"), (9005, "É é"), (9006, "é é"), out[0], (None, out[1][1]), (None, "only here " * 3), (out[3][0], "same id " + "other text " * 4)]


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w)} - {()} if len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def brute_components(rows):
    sets = [shingles(t) for _, t in rows]
    lead = list(range(len(rows)))

    def find(i):
        while lead[i] != i:
            i = lead[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
            lead[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return Counter((d, len(s), d if not s else least.get(find(i))) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True)))


@pytest.mark.parametrize("rounds", [0, 1, 2])
def test_near_duplicates(spark, monkeypatch, rounds):
    """Leads save work only: with all links found by shingles, or by leads first, the components are those of all pairs."""
    monkeypatch.setattr(nd, "ROUNDS", rounds)
    rows = corpus()
    out = nd.near_duplicates(clashing(spark.createDataFrame(rows, DDL))).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in out) == brute_components(rows)
    assert all(r.kept == (r.doc_id == r.component_id) for r in out)
    kept = nd.without_near_duplicates(clashing(spark.createDataFrame(rows, DDL)))
    comps = {(r.component_id, r.n_shingles > 0, r.text_key if not r.n_shingles else None) for r in out}
    assert kept.count() == len({c for c in comps}) and set(CLASH) - {"text"} <= set(kept.columns)


def group_of_copies(n, seed=3):
    """Copies of one text with edits, of which a third is not similar enough to any other; another text half of which is the same."""
    rng = random.Random(seed)
    base, out = words(rng, 150), []
    for i in range(n):
        copy = list(base)
        for _ in range(rng.randrange(12)):
            copy[rng.randrange(150)] = f"x{rng.randrange(10**7)}"
        out.append((i, " ".join(copy)))
    return [*out, (n, " ".join(base[:75] + words(rng, 75)))]


def test_work_on_a_group_of_near_copies_grows_with_its_size(spark, monkeypatch):
    made = []

    def counted(df, name, real=nd.written):
        out = real(df, name)
        made.append((name, out.count()))
        return out

    monkeypatch.setattr(nd, "written", counted)
    sums = []
    for n in (250, 500, 1000):
        made.clear()
        rows = group_of_copies(n)
        out = nd.near_duplicates(spark.createDataFrame(rows, DDL)).collect()
        sums.append(sum(k for _, k in made))
        if n == 250:
            assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in out) == brute_components(rows)
            assert 30 < len({r.component_id for r in out}) < 150
    assert sums[1] <= 2.2 * sums[0] and sums[2] <= 2.2 * sums[1]


def test_near_duplicates_of_nothing(spark):
    assert nd.near_duplicates(spark.createDataFrame([], DDL)).count() == 0
    assert [tuple(r)[:4] for r in nd.near_duplicates(spark.createDataFrame([(3, None)], DDL)).collect()] == [(3, 0, 3, True)]


def test_signatures_estimate_similarity():
    rng = random.Random(8)
    a = words(rng, 4000, 10**6)
    b = list(a)
    for i in rng.sample(range(len(b)), 120):
        b[i] = f"y{i}"
    x, y = (nd.shingle_set(" ".join(t)) for t in (a, b))
    true = len(np.intersect1d(x, y)) / len(np.union1d(x, y))
    assert abs((nd.signature(x) == nd.signature(y)).mean() - true) < 0.2


@pytest.mark.parametrize("few", [0, 10**6])
def test_components(spark, monkeypatch, few):
    monkeypatch.setattr(cc, "FEW", few)
    rng = random.Random(9)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(400 + i, 401 + i) for i in range(60)] + [(7, 7), (None, 3)]
    got = {r.node: r.component for r in cc.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    want = {}
    for u, v in edges:
        if u is not None and u != v:
            a, b = want.setdefault(u, {u}), want.setdefault(v, {v})
            if a is not b:
                a |= b
                for x in b:
                    want[x] = a
    assert got == {x: min(s) for x, s in want.items()}
    assert cc.components(spark.createDataFrame([], "u long, v long")).count() == 0


def brute_repeats(rows):
    seen, out = Counter(), []
    split = [(d, (t or "").encode().split()) for d, t in rows]
    for _, w in split:
        seen.update(tuple(w[i : i + 35]) for i in range(len(w) - 34))
    for d, w in split:
        gone = set()
        for i in range(len(w) - 34):
            if seen[tuple(w[i : i + 35])] > 1:
                gone.update(range(i, i + 35))
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return Counter(out)


@pytest.mark.parametrize("heavy", [1500, 2])
def test_repeats(spark, monkeypatch, heavy):
    monkeypatch.setattr(sd, "HEAVY", heavy)
    rows = corpus(2)
    df = clashing(spark.createDataFrame(rows, DDL))
    out = sd.remove_repeats(df, sd.indexed(df, batches=3)).collect()
    assert Counter(tuple(r)[:4] for r in out) == brute_repeats(rows) and all(hashlib.sha256(r.kept_text.encode()).hexdigest() == r.kept_sha256 for r in out)


def test_repeats_batch_by_batch(spark):
    """Each batch is judged against all before it, without these being passed again."""
    rows = corpus(4)
    exact = " ".join(f"once{i}" for i in range(35))
    # The passage stands once in the first batch and once in each later one; one text comes in all.
    batches = [[*rows[i::3], (7000 + i, f"a{i} {exact} z{i}"), (7100 + i, exact + " copy")] for i in range(3)]
    index, so_far = sd.Index(spark), []
    for batch in batches:
        so_far += batch
        df = clashing(spark.createDataFrame(batch, DDL))
        index.add(df)
        got = Counter(tuple(r)[:4] for r in sd.remove_repeats(df, index).collect())
        want, ids = brute_repeats(so_far), Counter(d for d, _ in batch)
        split = {(d, len((t or "").split())) for d, t in batch}
        assert sum(got.values()) == len(batch) and set(got) == {r for r in want if r[:2] in split} and Counter({d: sum(n for r, n in got.items() if r[0] == d) for d in ids}) == ids
    last = {r.doc_id: r.n_removed for r in sd.remove_repeats(spark.createDataFrame([(8000, exact)], DDL), _with(index, spark, [(8000, exact)])).collect()}
    assert last == {8000: 35}


def _with(index, spark, rows):
    index.add(spark.createDataFrame(rows, DDL))
    return index


def test_repeats_of_nothing_and_one(spark):
    none = spark.createDataFrame([], DDL)
    assert sd.remove_repeats(none, sd.indexed(none)).count() == 0
    exact = " ".join(f"w{i}" for i in range(35))
    one = spark.createDataFrame([(1, exact), (2, "x " + exact + " y"), (3, exact[:-1])], DDL)
    assert {r.doc_id: r.n_removed for r in sd.remove_repeats(one, sd.indexed(one)).collect()} == {1: 35, 2: 35, 3: 0}


def test_index_of_runs(spark):
    rows = corpus(3)
    df = spark.createDataFrame(rows, DDL)
    index = sd.Index(spark)
    for i in range(7):  # more runs than FANOUT
        index.add(df.where(F.pmod(F.hash("text"), F.lit(7)) == i))
    assert len(index.runs) <= sd.FANOUT + 1
    counts = {r.fp: r.n for r in index.counts().collect()}
    index.compact()
    hasher, want = sd.Hasher(), Counter()
    for _, t in rows:
        found = hasher.selected((t or "").encode().split())
        want.update([] if found is None else found[1][found[2]].view(np.int64).tolist())
    assert len(index.runs) == len(index.texts) == 1 and {r.fp: r.n for r in index.counts().collect()} == counts == dict(want)
    for part in index.runs[0].inputFiles():
        fps = [r.fp for r in spark.read.parquet(part).collect()]
        assert fps == sorted(fps)


def test_history_is_not_shuffled(spark):
    """A batch is dealt to the buckets of the runs; these are scanned, and joined by merging, as they are."""
    index = sd.indexed(spark.createDataFrame(corpus(5), DDL), batches=3)
    batch, name = spark.range(50).select((F.col("id") * 7).alias("fp")), "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(name)
    spark.conf.set(name, "-1")
    for df in (index.places(batch), index.repeated(batch.distinct())):
        lines = df._jdf.queryExecution().executedPlan().toString().split("\n")
        depth = [len(x) - len(x.lstrip(" :+-")) for x in lines]
        scans = [i for i, x in enumerate(lines) if "FileScan" in x]
        assert len(scans) == 3
        for i in scans:
            above, least = [], depth[i]
            for j in range(i - 1, -1, -1):
                if depth[j] < least:
                    above.append(lines[j])
                    least = depth[j]
            join = next(k for k, x in enumerate(above) if "SortMergeJoin" in x)
            assert not any("Exchange" in x for x in above[:join])
    spark.conf.set(name, before)


@pytest.mark.parametrize("crowded", [0, 3])
def test_repeats_with_crowded_fingerprints(spark, monkeypatch, crowded):
    monkeypatch.setattr(sd, "CROWDED", crowded)
    rows = corpus(6)
    df = spark.createDataFrame(rows, DDL)
    index = sd.indexed(df, batches=2)
    assert index.crowded
    index.compact()
    assert Counter(tuple(r)[:4] for r in sd.remove_repeats(df, index).collect()) == brute_repeats(rows)


def test_masks_leave_no_overlap_without_a_hit():
    places = [[i for i, c in enumerate(m) if c == "1"] for m in dc.MASKS]
    for length in range(dc.SHORTEST, dc.WINDOW + 1):
        for bad in itertools.combinations(range(length), length * dc.TOLERANCE // 100):
            assert any(not any(o + p in bad for p in m) for m in places for o in range(length - m[-1]))


def test_overlaps(spark, monkeypatch):
    rng = random.Random(11)
    items = [(i, " ".join(words(rng, n))) for i, n in enumerate((5, 6, 7, 9, 12, 13, 14, 30, 60, 4, 0))] + [(90, None), (None, "null id item of six"), (91, "the " * 20), (0, "same id again here now")]
    docs = []
    for i in range(220):
        item = rng.choice(items)[1] or ""
        piece = item.split()
        a = rng.randrange(max(1, len(piece) // 3 + 1))
        piece = piece[a : a + rng.choice((4, 8, 13, 20, 60))]
        for _ in range(rng.randrange(5)):
            if piece:
                piece[rng.randrange(len(piece))] = f"q{i}"
        text = [*words(rng, rng.randrange(40)), *piece, *words(rng, rng.randrange(40))]
        docs.append((i, rng.choice((" ", ", ", "! ")).join(text).title()))
    docs += [(300, None), (301, ""), (302, "THE " * 3000), (None, items[8][1]), (303, items[7][1]), (303, items[7][1])]
    d, b = spark.createDataFrame(docs, DDL), spark.createDataFrame(items, "item_id long, text string")
    duck = duckdb.connect()
    duck.register("documents", d.toPandas().astype({"doc_id": "Int64"}))
    duck.register("benchmark", b.toPandas().astype({"item_id": "Int64"}))
    # The plain SQL keys rows by their ids, so rows that share one are left out of this comparison.
    sql = {tuple(None if x is None or x != x else int(x) for x in r) for r in duck.execute(dc.ORACLE).fetchall()}
    alone = lambda r: r[0] is not None and r[1] not in (0, None) and r[0] != 303
    for limit in (dc.BROADCAST_BYTES, 0):
        monkeypatch.setattr(dc, "BROADCAST_BYTES", limit)
        got = [tuple(r) for r in dc.overlaps(clashing(d), clashing(b)).collect()]
        assert len(set(got)) == len(got) and {r for r in got if alone(r)} == {r for r in sql if alone(r)} and len(sql) > 30
        assert (303, 7, 13, 13) in got and (None, 8, 13, 13) in got and not any(r[0] in (300, 301) for r in got)
    clean = dc.without_overlaps(clashing(d), b)
    gone = {r[0] for r in got}
    assert sorted(r.doc_id for r in clean.collect()) == sorted(x for x, _ in docs if x not in gone)
    assert dc.overlaps(d.limit(0), b).count() == dc.overlaps(d, b.limit(0)).count() == 0 and dc.without_overlaps(d, b.limit(0)).count() == len(docs)


def vectors(n=700, d=16, seed=5):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(12, d))
    x = (centers[rng.integers(0, 12, n)] + 0.4 * rng.normal(size=(n, d))).astype(np.float32)
    x[100:220] = x[100]  # a vector that many rows share
    return x


def test_neighbours(spark):
    x = vectors()
    x[3] *= 5
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    odd = [(1000, None), (1001, []), (1002, [0.0] * 16), (1003, [float("nan")] * 16), (1004, [1.0] * 8), (None, rows[0][1]), (1005, [*rows[0][1][:15], None]), rows[7], (1020, [float("inf")] * 16)]
    df = clashing(spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>"))
    out = nb.nearest(df, df.where("vec_id % 20 = 0"), k=10).collect()
    found = {}
    for r in out:
        found.setdefault(r.query_id, []).append(r)
    assert set(found) == {*range(0, 700, 20)}
    hit = 0
    for q, got in found.items():
        got.sort(key=lambda r: r["rank"])
        score = x.astype(float) @ x[q].astype(float)
        assert [r["rank"] for r in got] == list(range(1, 11)) and all(r.vec_id != q and r.score == pytest.approx(score[r.vec_id], rel=1e-12) for r in got)
        assert [(-r.score, r.vec_id) for r in got] == sorted((-r.score, r.vec_id) for r in got)
        order = sorted((i for i in range(700) if i != q), key=lambda i: (-round(score[i], 9), i))[:10]
        hit += len({r.vec_id for r in got} & set(order))
    assert hit / (10 * len(found)) >= 0.9
    shared = sorted(found[100], key=lambda r: r["rank"])
    if shared[0].score == shared[9].score:
        assert [r.vec_id for r in shared] == list(range(101, 111))


def test_neighbours_of_several_vectors_and_lengths(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (1, [0.9, 0.1]), (2, [0.2, 0.0]), (20, [1.0, 1.0, 1.0]), (3, [2.0, 0.0, 0.0]), (4, [0.0, 0.5, 0.0]), (0, [1.0, 0.0]), (5, [0.9, 0.1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(tuple(r) for r in nb.nearest(df, df.where("vec_id % 20 = 0")).collect())
    assert got == [(0, 1, 1, 0.9), (0, 2, 5, 0.9), (0, 3, 2, 0.2), (20, 1, 3, 2.0), (20, 2, 4, 0.5)]


def test_ratio_leaves_out_far_lists(spark, monkeypatch):
    """Vectors in clusters: a query is compared with few of them, and finds nearly all neighbours."""
    rng = np.random.default_rng(9)
    centers = rng.normal(size=(60, 24))
    x = centers[rng.integers(0, 60, 6000)] + 0.3 * rng.normal(size=(6000, 24))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(4)
    tables = {}

    def kept(frame, name, real=nb.written):
        tables[name] = real(frame, name)
        return tables[name]

    monkeypatch.setattr(nb, "written", kept)
    found = {}
    for r in nb.nearest(df, df.where("vec_id % 20 = 0")).collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    score = x[::20] @ x.T
    score[np.arange(300), np.arange(0, 6000, 20)] = -np.inf
    best = np.argsort(-score, axis=1)[:, :20]
    assert np.mean([len(found[20 * i] & set(b.tolist())) for i, b in enumerate(best)]) >= 18
    lists = {}
    for r in tables["posted"].select("vec_id", "lists").collect():
        for j in r.lists:
            lists.setdefault(j, set()).add(r.vec_id)
    asked = {}
    for r in tables["probes"].select("query_id", "lists").collect():
        asked.setdefault(r.query_id, set()).update(*(lists.get(j, ()) for j in r.lists))
    assert set().union(*lists.values()) == set(range(6000)) and np.mean([len(a) for a in asked.values()]) < 0.2 * 6000


def test_few_neighbours(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [0.0, -1.0])], "vec_id long, embedding array<float>")
    got = sorted(tuple(r) for r in nb.nearest(df, df.where("vec_id = 0")).collect())
    assert [(r[1], r[2]) for r in got] == [(1, 1), (2, 2)]
    assert nb.nearest(df.limit(0), df).count() == 0 and nb.nearest(df, df.limit(0)).count() == 0 and nb.nearest(df.limit(1), df.limit(1)).count() == 0


def test_graph_search_finds_near_centroids():
    x = vectors(3000, 24).astype(float)
    lists = nb.fitted(x, 200)
    lists.ratio = 1.3
    ids, far = lists.near(x[:200], 4)
    row, at, _ = lists.within(x[:200], 8)
    all_far = np.sqrt(((x[:200, None, :] - lists.centroids[None]) ** 2).sum(axis=2))
    want = all_far <= 1.3 * np.sort(all_far, axis=1)[:, 1:2]
    got = np.zeros_like(want)
    got[row, at] = True
    assert len(set(zip(row.tolist(), at.tolist(), strict=True))) == len(row) and (want & got).sum() >= 0.98 * want.sum() and (got.sum(axis=1) >= 8).all()
    exact = ((x[:200, None, :] - lists.centroids[None]) ** 2).sum(axis=2)
    assert (ids[:, 0] == exact.argmin(axis=1)).mean() > 0.95 and (np.diff(far, axis=1) >= 0).all()


def test_archives(spark, tmp_path):
    long = "long " * 300_000
    rows = [(1, "http://a/", "<p>x"), (2, "http://b/", "<p>x"), (3, None, None), (4, "", ""), (5, "http://é/\r\nX: y", "é\r\n\r\nWARC/1.1"), (6, "u", long), (7, "u", long), (7, "u", "<p>x"), (None, "n", "<p>x"), (8, "h", "only")]
    df = clashing(spark.createDataFrame(rows, "page_id long, url string, html string")).repartition(3)
    out = warc.archived(df, f"file://{tmp_path}/w").collect()
    sha = lambda t: base64.b32encode(hashlib.sha1((t or "").encode()).digest()).decode()
    want = []
    for digest, group in itertools.groupby(sorted(rows, key=lambda r: (sha(r[2]), r[0] is not None, r[0] or 0)), key=lambda r: sha(r[2])):
        group = list(group)
        top = group[-1][0]
        want += [(p, len((h or "").encode()), digest, "response" if i == len(group) - 1 else "revisit", None if i == len(group) - 1 else top) for i, (p, _, h) in enumerate(group)]
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in out) == Counter(want)
    assert all((r.payload is None) == (r.record_type == "revisit") for r in out) and {r.url for r in out if r.page_id == 5} == {"http://é/X: y"}
    files = [f for f in os.listdir(tmp_path / "w" / "warc") if f.endswith(".gz")]
    for f in files:  # every record is a member of its own, at the offset that the sidecar gives
        raw = (tmp_path / "w" / "warc" / f).read_bytes()
        lines = spark.read.json(f"{tmp_path}/w/warc/{f}.idx").orderBy("offset").collect()
        assert sum(x.length for x in lines) == len(raw) and all(zlib.decompress(raw[x.offset : x.offset + x.length], 31).startswith(b"WARC/1.1") for x in lines)
        assert len(list(warc.records(iter([gzip.decompress(raw)])))) == len(lines)
    assert warc.archived(df.limit(0), f"file://{tmp_path}/none").count() == 0
    big = warc.archived(df, f"file://{tmp_path}/kept", least_bytes=100).where("record_type = 'revisit'")
    assert [(r.page_id, r.refers_to) for r in big.collect()] == [(6, 7)]


def test_normaliser_alone():
    made = [warc.response(i, "u", b"x" * i) for i in (0, 5, 3_000_000)]
    whole = gzip.compress(b"".join(map(warc.encoded, made)))
    for raw in (whole, b"".join(gzip.compress(warc.encoded(r)) for r in made)):
        out = io.BytesIO()
        rows = list(warc.normalise(io.BytesIO(raw), out))
        assert [r for _, _, r in rows] == made
        assert [next(warc.records(iter([zlib.decompress(out.getvalue()[a : a + n], 31)]))) for a, n, _ in rows] == made
    with pytest.raises(ValueError):
        list(warc.normalise(io.BytesIO(gzip.compress(warc.encoded(made[1])[:-3])), io.BytesIO()))


def test_pipeline(spark, tmp_path):
    """The stages on a corpus whose fate is known, document by document."""
    rng = random.Random(13)
    item = " ".join(words(rng, 30))
    docs = [(i, " ".join(words(rng, 60)), "en", "s", 0) for i in range(30)]
    docs += [(100, docs[0][1], "en", "s", 0), (101, docs[1][1] + " more", "en", "s", 0), (102, "123 %% 4", "en", "s", 0), (103, None, None, None, None), (104, "a " + item + " b", "en", "s", 0), (105, " ".join(words(rng, 30)) + " me@x.org", "en", "s", 0), docs[2]]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    left, columns = [], now.columns
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        out = stage(spark, now, str(tmp_path))
        assert out.columns == columns, name
        out.write.parquet(f"{tmp_path}/{i}")
        now = spark.read.parquet(f"{tmp_path}/{i}")
        left.append(sorted(r.doc_id for r in now.collect()))
    assert left[0] == sorted(d[0] for d in docs if d[0] not in (102, 103))
    assert left[1] == sorted({d[0] for d in docs} - {100, 101, 102, 103})
    assert left[2] == left[3] == sorted(set(left[1]) - {104})
    assert "me@x.org" not in now.where("doc_id = 105").first().text and now.where("doc_id = 0").first().text == docs[0][1]
    ids = corpus_pipeline.run(spark, str(tmp_path)).groupBy("doc_id").agg(F.sum("length").alias("n"), F.first("doc_tokens").alias("t")).collect()
    assert sorted(r.doc_id for r in ids) == left[3] and all(r.n == r.t for r in ids)


def test_stages_with_odd_rows_and_names(spark, tmp_path):
    """Nulls in all columns, empty and long texts, repeated rows, columns with names of results, an empty benchmark, no rows."""
    rows = [(1, "plain words of a text that is here", "en", 9), (1, "plain words of a text that is here", "en", 9), (None, "other words without an id", None, None), (3, None, None, None), (4, "", "en", 0), (5, "12 + 30", None, 1), (6, "long words " * 50_000, "en", 5), (7, "mail me@x.org now please", "en", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, n_chars long")
    for c in ("lang_pred", "score", "n_words", "spans", "row", "n_entities", "n_entities_", "key", "keeper", "matches", "kind", "start", "ids"):
        docs = docs.withColumn(c, F.lit("clash"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    left = {"language": [None, 1, 1, 6, 7], "near_duplicates": [None, 1, 3, 4, 5, 6, 7], "decontamination": [r[0] for r in rows], "personal_data": [r[0] for r in rows]}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        got = out.collect()
        assert out.columns == docs.columns and sorted((r.doc_id for r in got), key=str) == sorted(left[name], key=str), name
        assert all(r[c] == "clash" for r in got for c in docs.columns[4:])
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
    assert {r.n_chars == len(r.text or "") for r in got if r.doc_id == 7} == {True} and not any("me@x.org" in (r.text or "") for r in got)
    packed = corpus_pipeline.sequences(spark, docs, str(tmp_path))
    assert packed.select("doc_id", "start").count() > len(rows) and corpus_pipeline.sequences(spark, docs.limit(0), str(tmp_path)).count() == 0


def test_language_stage_with_names_of_results(spark, tmp_path):
    docs = spark.createDataFrame([(i, "some plain words here", "en") for i in range(9)] + [(9, "12 %", "en")], "doc_id long, text string, lang string")
    for c in ("lang_pred", "score", "n_words", "spans", "row", "__text"):
        docs = docs.withColumn(c, F.lit("clash"))
    out = corpus_pipeline.known_language(spark, docs, str(tmp_path))
    assert out.columns == docs.columns and sorted(r.doc_id for r in out.where("score = 'clash' and lang_pred = 'clash'").collect()) == list(range(9))


SF = "/root/testdata/sf0.001"
#: Rows that each query gives for a table of so many.
ROWS = {"op1_html": "pages", "op4_minhash": "documents", "op5_pii": "documents", "op7_warc": "pages", "op8_token_counts": "documents", "op9_language": "documents", "op10_substring": "documents"}


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are absent")
@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_registered_query(spark, name):
    """A row to each row of the table, and the SQL's rows where there is one; the whole of documents, or neighbours, else."""
    df = queries.queries()[name](spark, SF)
    got = df.collect()
    if name in ROWS:
        assert len(got) == spark.read.parquet(f"{SF}/{ROWS[name]}.parquet").count() > 0
    if name in queries.oracle_sql():
        duck = duckdb.connect()
        for t in ("documents", "benchmark", "pages"):
            duck.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
        found = duck.execute(queries.oracle_sql()[name])
        columns = [c[0] for c in found.description]
        assert sorted(columns) == sorted(df.columns) and Counter(tuple(r[c] for c in columns) for r in got) == Counter(found.fetchall())
    if name == "op2_packing":
        ids, docs = Counter(), Counter(r.doc_id for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id").collect())
        for r in got:
            ids[r.doc_id, r.doc_tokens] += r.length
        assert all(n == tokens * docs[d] for (d, tokens), n in ids.items()) and {d for d, _ in ids} == set(docs)
    if name == "op6_neighbours":
        n = spark.read.parquet(f"{SF}/embeddings.parquet").count()
        asked = spark.read.parquet(f"{SF}/embeddings.parquet").where("vec_id % 20 = 0").count()
        assert len(got) == asked * min(20, n - 1) > 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are absent")
def test_the_registered_pipeline(spark):
    """Every document that all filters keep is packed whole: by each stage's operator, applied by hand."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = language.fit(docs.where(~language.held_out(F.col("doc_id"))))
    known = {r.doc_id for r in language.identify(docs, model).collect() if r.lang_pred != "und"}
    left = docs.where(F.col("doc_id").isin(*known))
    kept = {r.doc_id for r in nd.near_duplicates(left).where("keeper").collect()}
    found = {r.doc_id for r in dc.overlaps(left, spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
    ids = Counter()
    for r in corpus_pipeline.run(spark, SF).collect():
        ids[r.doc_id, r.doc_tokens] += r.length
    assert {d for d, _ in ids} == kept - found and all(n == tokens for (_, tokens), n in ids.items())
