"""Approximate nearest neighbours by inner product, over balanced posting lists.

Vectors get one more coordinate that gives all the same length, so that the largest inner product is the least distance.
Centroids come from a bounded sample, split until no cluster is larger than its share; they are few enough for every
worker to keep them with a graph of their neighbourhoods, which is searched best-first. A vector near a border is
posted in several lists; a query reads the lists whose centroids are not much farther than its nearest ones: by a ratio
of distances that is measured on the sample, so that neighbours in it would be found.

Lists are short, so neighbouring ones share a cell, where a vector travels to once, however many of the lists want it.
The nearest lists are read first; what they hold bounds what of the others need be passed on.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from helixframe.llm._common import bounded_batches, written

#: Vectors to a list, as long as that makes no more lists than the second number or twice the root of all vectors. The
#: third bounds the lists at any size, as driver and workers hold their centroids (34 MB at 64 dimensions).
PER_LIST, LISTS, MOST_LISTS = 8, 4096, 1 << 16
#: Vectors that the centroids are fitted on: about so many, or four to a list.
SAMPLE = 20_000
#: Lists that a border vector is posted in, and how much farther than the nearest their centroids may be.
REPLICAS, BORDER = 4, 1.05
#: Lists that are always read, and the share of neighbours in the sample that the ratio for others has to find.
PROBES, FOUND = 8, 0.94
#: Vectors of the sample that the ratio is measured for.
MEASURED = 256
#: Neighbours of a centroid in the graph, and how many centroids a search keeps in view at least.
DEGREE, BEAM = 24, 24
#: Lists of a cell; vectors and queries that meet in one task, and queries that are compared at a time.
CELL_LISTS, CELL_VECTORS, CELL_QUERIES, AT_ONCE = 64, 8192, 8192, 256


@dataclass
class Lists:
    centroids: np.ndarray
    graph: np.ndarray  # neighbours of each centroid
    entry: np.ndarray  # where searches begin
    ratio: float = 1.0  # how much farther than its second nearest a query's lists may be

    def near(self, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, distances) of about the ``k`` nearest centroids of each row of ``x``, nearest first, by best-first search."""
        n, rows = len(self.centroids), np.arange(len(x))[:, None]
        beam = min(max(BEAM, k + k // 4), n)

        def distance(ids: np.ndarray) -> np.ndarray:
            return np.sqrt(np.maximum(((self.centroids[ids] - x[:, None, :]) ** 2).sum(axis=2), 0))

        ids = np.broadcast_to(self.entry, (len(x), len(self.entry)))
        far = distance(ids)
        seen = np.zeros((len(x), n + 1), dtype=bool)
        seen[:, self.entry] = True
        done = np.zeros(ids.shape, dtype=bool)
        while True:
            open_far = np.where(done, np.inf, far)
            best = open_far.argmin(axis=1)[:, None]
            if not np.isfinite(open_far[rows, best]).any():
                break
            live = np.isfinite(open_far[rows, best])
            done[rows, best] = True
            new = np.where(live, self.graph[ids[rows, best][:, 0]], n)
            fresh = ~seen[rows, new] & (new < n)
            seen[rows, new] = True
            new_far = np.where(fresh, distance(np.minimum(new, n - 1)), np.inf)
            ids, far = np.concatenate((ids, new), axis=1), np.concatenate((far, new_far), axis=1)
            done = np.concatenate((done, ~fresh), axis=1)
            keep = np.argsort(far, axis=1, kind="stable")[:, :beam]
            ids, far, done = ids[rows, keep], far[rows, keep], done[rows, keep]
        return ids[:, :k], far[:, :k]

    def within(self, x: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, list, rank) of the lists of each row of ``x``: the ``least`` nearest, ranked, and all that the ratio allows.

        From those that are near enough the graph is followed on, as long as it leads to others that are.
        """
        ids, far = self.near(x, least)
        n, reach = len(self.centroids), self.ratio * far[:, min(1, far.shape[1] - 1)]
        seen = np.zeros((len(x), n + 1), dtype=bool)
        np.put_along_axis(seen, ids, True, axis=1)
        out = [(np.repeat(np.arange(len(x)), ids.shape[1]), ids.ravel(), np.tile(np.arange(ids.shape[1]), len(x)))]
        row, node = out[0][:2]
        while len(row):
            row, node = np.repeat(row, self.graph.shape[1]), self.graph[node].ravel()
            new = np.unique((row * (n + 1) + node)[(node < n) & ~seen[row, node]])
            row, node = np.divmod(new, n + 1)
            seen[row, node] = True
            far = np.concatenate([np.zeros(0), *(np.sqrt(((self.centroids[node[i : i + 20_000]] - x[row[i : i + 20_000]]) ** 2).sum(axis=1)) for i in range(0, len(row), 20_000))])
            near = far <= reach[row]
            row, node = row[near], node[near]
            out.append((row, node, np.full(len(row), least)))
        return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def _split(x: np.ndarray, members: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Two halves of equal size: by the difference of the distances to two means, over some rounds."""
    a, b = x[rng.choice(members, 2, replace=False)]
    half = len(members) // 2
    for _ in range(8):
        side = ((x[members] - a) ** 2).sum(axis=1) - ((x[members] - b) ** 2).sum(axis=1)
        order = members[np.argsort(side, kind="stable")]
        a, b = x[order[:half]].mean(axis=0), x[order[half:]].mean(axis=0)
    return order[:half], order[half:]


def fitted(sample: np.ndarray, lists: int) -> Lists:
    """Centroids of balanced clusters of ``sample`` and their graph; copies of a vector count once."""
    x, rng = np.unique(sample, axis=0), np.random.default_rng(7)
    groups, most = [np.arange(len(x))], max(1, -(-len(x) // lists))
    whole = []
    while groups:
        g = groups.pop()
        if len(g) <= max(most, 1):
            whole.append(g)
        else:
            groups.extend(_split(x, g, rng))
    c = np.stack([x[g].mean(axis=0) for g in whole])
    square, degree = (c**2).sum(axis=1), min(DEGREE, max(1, len(c) - 1))
    graph = np.zeros((len(c), degree), dtype=np.int64)
    for i in range(0, len(c), 1024):
        far = square - 2 * c[i : i + 1024] @ c.T
        far[np.arange(len(far)), np.arange(i, i + len(far))] = np.inf
        near = np.argpartition(far, degree - 1, axis=1)[:, :degree]
        graph[i : i + 1024] = np.take_along_axis(near, np.argsort(np.take_along_axis(far, near, axis=1), axis=1, kind="stable"), axis=1)
    # A ring through all centroids keeps the graph in one piece; where it repeats a neighbour it leads nowhere.
    ring = np.roll(np.arange(len(c)), -1)[:, None]
    ring = np.where((graph == ring).any(axis=1, keepdims=True), len(c), ring)
    some = rng.choice(len(c), min(len(c), 16), replace=False)
    return Lists(c, np.concatenate((graph, ring), axis=1), some)


def _posted(index: Lists, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(lists, whether it is posted there) of each row of ``x``."""
    ids, far = index.near(x, REPLICAS)
    return ids, far <= BORDER * far[:, :1]


def measured(index: Lists, sample: np.ndarray, lifted: np.ndarray, asked: np.ndarray, k: int, share: float) -> float:
    """The least ratio that finds FOUND of the ``k`` nearest of all vectors, of which the sample is this ``share``.

    ``sample`` holds distinct vectors, ``lifted`` the same as they are indexed, ``asked`` as they are asked for. Of a
    tenth of all, a tenth of the k nearest are about the nearest. A vector of the sample has drawn a centroid to itself;
    for those that stand for vectors beyond the sample it doesn't count.
    """
    k = min(-int(-k * share // 1), len(sample) - 1)
    if k < 1:
        return 1.0
    rng = np.random.default_rng(11)
    q = rng.permutation(len(sample))[:MEASURED]
    score = sample[q] @ sample.T
    score[np.arange(len(q)), q] = -np.inf
    best = np.argpartition(-score, k - 1, axis=1)[:, :k]
    far = np.sqrt(np.maximum((asked[q] ** 2).sum(axis=1)[:, None] - 2 * asked[q] @ index.centroids.T + (index.centroids**2).sum(axis=1), 0))
    nearest = np.sort(far, axis=1)[:, 1:3] if far.shape[1] > 2 else far[:, :1]
    second = np.where(rng.random(len(q)) < share, nearest[:, 0], nearest[:, -1])
    lists, there = _posted(index, lifted[best.ravel()])
    need = np.where(there, far[np.repeat(np.arange(len(q)), k)[:, None], lists], np.inf).min(axis=1) / np.maximum(np.repeat(second, k), 1e-300)
    return float(max(np.quantile(need, FOUND, method="higher"), 1.0))


def _stacked(column: pa.Array) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return values.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def _usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, v) of the vectors that take part."""
    v = F.col("embedding").cast("array<double>")
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.select("vec_id", v.alias("v")).where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.exists("v", lambda x: x != 0))


FOUND_SCHEMA = "query_id long, vec_id long, score double"


def _cell(posts: pa.Table, probes: pa.Table, k: int) -> pa.Table:
    """The best of posts (vec_id, v, lists) for each of probes (query_id, q, lists, least) in the lists that both have."""
    out: list[list] = [[], [], []]
    if posts.num_rows and probes.num_rows:
        posts = posts.sort_by("vec_id")
        ids, p = posts["vec_id"].to_numpy(), _stacked(posts["v"].combine_chunks())
        asked, q = probes["query_id"].to_numpy(), _stacked(probes["q"].combine_chunks())
        bound = probes["least"].to_numpy(zero_copy_only=False).astype(float)
        bound[np.isnan(bound)] = -np.inf
        members, wanted = _by_list(posts["lists"]), _by_list(probes["lists"])
        # Rounding differs with the place in a matrix; what is that near to the bound is counted anew.
        slack = 1e-9 * np.abs(p).max() * np.abs(q).max() * p.shape[1]
        for start in range(0, len(q), AT_ONCE):
            block = q[start : start + AT_ONCE]
            score = np.full((len(block), len(p)), -np.inf)
            for name, rows in members.items():
                by = wanted.get(name, wanted.get(-1))
                by = by[np.searchsorted(by, start) : np.searchsorted(by, start + AT_ONCE)] - start if by is not None else ()
                if len(by):
                    score[np.ix_(by, rows)] = block[by] @ p[rows].T
            for i, row in enumerate(score):
                row[ids == asked[start + i]] = -np.inf
                kth = np.partition(row, -k)[-k] if len(row) > k else -np.inf
                at = np.flatnonzero((row >= max(kth, bound[start + i]) - slack) & (row > -np.inf))
                # A sum in one order for all, so that equal vectors have equal scores.
                exact = np.einsum("pd,d->p", p[at], block[i], optimize=False)
                best = np.argsort(-exact, kind="stable")[:k]
                out[0].extend([int(asked[start + i])] * len(best))
                out[1].extend(ids[at[best]].tolist())
                out[2].extend(exact[best].tolist())
    return pa.table({"query_id": pa.array(out[0], pa.int64()), "vec_id": pa.array(out[1], pa.int64()), "score": pa.array(out[2], pa.float64())})


def _by_list(column: pa.ChunkedArray) -> dict[int, np.ndarray]:
    """The rows that hold each list, in order."""
    lists = column.combine_chunks()
    row = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
    values = lists.flatten().to_numpy()
    order = np.argsort(values, kind="stable")
    cuts = np.flatnonzero(np.diff(values[order])) + 1
    return {int(values[part[0]]): row[part] for part in np.split(order, cuts) if len(part)}


def _compared(posted: DataFrame, probes: DataFrame, k: int) -> DataFrame:
    """(query_id, vec_id, score): the best of each cell of posted (vec_id, v, cell, lists) and probes (query_id, q, cell, lists, least)."""
    # As many rows as cells.
    blocks = posted.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / CELL_VECTORS).cast("int").alias("chunks"))
    blocks = F.broadcast(blocks.join(probes.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / CELL_QUERIES).cast("int").alias("parts")), "cell"))
    posted = posted.join(blocks, "cell").withColumn("chunk", F.pmod(F.xxhash64("vec_id", "v"), "chunks").cast("int")).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    probes = probes.join(blocks, "cell").withColumn("part", F.pmod(F.xxhash64("query_id"), "parts").cast("int")).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    cells = posted.select("cell", "chunk", "part", "vec_id", "v", "lists").groupBy("cell", "chunk", "part").cogroup(probes.select("cell", "chunk", "part", "query_id", "q", "lists", "least").groupBy("cell", "chunk", "part"))
    return cells.applyInArrow(lambda a, b: _cell(a, b, k), FOUND_SCHEMA)


def _celled(b: pa.RecordBatch, row: np.ndarray, lists: np.ndarray, step: np.ndarray, names: list[str]) -> pa.RecordBatch:
    """``b``'s rows once for each cell and step that they have lists in, with these lists."""
    cell = lists // CELL_LISTS
    order = np.lexsort((lists, cell, step, row))
    row, lists, cell, step = row[order], lists[order], cell[order], step[order]
    first = np.flatnonzero(np.concatenate(([True], (np.diff(row) != 0) | (np.diff(cell) != 0) | (np.diff(step) != 0))))
    held = pa.ListArray.from_arrays(pa.array(np.append(first, len(row)).astype(np.int32)), pa.array(lists.astype(np.int32)))
    at = pa.array(row[first])
    return pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.array(cell[first].astype(np.int32)), held, pa.array(step[first].astype(np.int32))], names=names)


def _short(pairs: DataFrame, k: int) -> DataFrame:
    """(query_id, vec_id, score) of different neighbours only, and the score that the k-th of a query has, if there is one."""
    one = pairs.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return one.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def nearest(vectors: DataFrame, queries: DataFrame, *, k: int = 20, sample: int = SAMPLE, most_lists: int = MOST_LISTS) -> DataFrame:
    """The ``k`` rows of ``vectors`` (vec_id, embedding) with the largest inner product to each of ``queries`` (the same columns).

    Gives query_id, rank from 1, vec_id, score (the inner product in double precision), ties to the smaller vec_id; the
    query's own vec_id is left out. A query finds fewer than k only if the lists that it reads hold fewer; then all
    others are searched for it.

    Null ids, and vectors that are null, empty, zero or hold a null, NaN or infinity, take no part. Vectors are compared
    with those of their own length; all but the commonest length are searched exactly. Rows with one vec_id all count,
    as one vec_id with several vectors: the best of its scores is given. Without queries or vectors there are no rows.
    Other columns are ignored. The index is fitted on about ``sample`` vectors, or four to a list, chosen by a hash of
    the id, and holds every vector.
    """
    spark = vectors.sparkSession
    bounded_batches(spark, 2048)
    rows, asked = _usable(vectors), _usable(queries)
    sizes = rows.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n"), F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)).alias("top")).orderBy(F.desc("n"), "d").limit(1).collect()
    schema = "query_id long, rank int, vec_id long, score double"
    if not sizes:
        return spark.createDataFrame([], schema)
    d, n, top = sizes[0]

    def lifted(x: np.ndarray) -> np.ndarray:
        return np.concatenate((x, np.sqrt(np.maximum(top - (x**2).sum(axis=1, keepdims=True), 0))), axis=1)

    def turned(q: np.ndarray) -> np.ndarray:
        # The length of a query doesn't change its order of neighbours.
        return np.concatenate((q * np.sqrt(top / (q**2).sum(axis=1, keepdims=True)), np.zeros((len(q), 1))), axis=1)

    lists = max(1, min(n // PER_LIST, max(LISTS, int(2 * n**0.5)), most_lists))
    same = rows.where(F.size("v") == d)
    share = int(min(1.0, max(sample, 4 * lists) / n) * 1_000_000)
    drawn = same.where(F.pmod(F.xxhash64("vec_id", F.lit("sample")), F.lit(1_000_000)) < max(share, 1)).select("v").toArrow()
    if not drawn.num_rows:
        drawn = same.select("v").limit(sample).toArrow()
    x = np.unique(_stacked(drawn["v"].combine_chunks()), axis=0)
    found = fitted(lifted(x), min(lists, max(1, len(x) // 2)))
    found.ratio = measured(found, x, lifted(x), turned(x), k, min(drawn.num_rows / n, 1.0))
    sent = spark.sparkContext.broadcast(found)

    def mapped(choose, names: list[str]):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if not b.num_rows:
                    continue
                common = np.diff(b.column(1).offsets.to_numpy()) == d
                if not common.all():
                    # A cell for each other length, with one list.
                    rest = b.filter(pa.array(~common))
                    size = np.diff(rest.column(1).offsets.to_numpy())
                    one = pa.ListArray.from_arrays(pa.array(np.arange(len(size) + 1, dtype=np.int32)), pa.array(np.zeros(len(size), dtype=np.int32)))
                    yield pa.RecordBatch.from_arrays([*rest.columns, pa.array((-size).astype(np.int32)), one, pa.array(np.zeros(len(size), dtype=np.int32))], names=names)
                    b = b.filter(pa.array(common))
                if b.num_rows:
                    yield _celled(b, *choose(_stacked(b.column(1))), names)

        return run

    def post(v: np.ndarray) -> tuple:
        ids, there = _posted(sent.value, lifted(v))
        at, which = np.nonzero(there)
        return at, ids[at, which], np.zeros(len(at), dtype=np.int64)

    def probe(q: np.ndarray) -> tuple:
        row, ids, rank = sent.value.within(turned(q), PROBES)
        return row, ids, (rank >= PROBES).astype(np.int64)

    # Posting and probing are done once: the sizes and the cells are both taken from what was written.
    posted = written(rows.mapInArrow(mapped(post, ["vec_id", "v", "cell", "lists", "step"]), "vec_id long, v array<double>, cell int, lists array<int>, step int"), "posted").drop("step")
    probes = written(asked.mapInArrow(mapped(probe, ["query_id", "q", "cell", "lists", "step"]), "query_id long, q array<double>, cell int, lists array<int>, step int"), "probes")
    none = F.lit(None).cast("double")
    near = written(_short(_compared(posted, probes.where("step = 0").withColumn("least", none), k), k), "near")
    least = near.where(F.col("rank") == k).select("query_id", F.col("score").alias("least"))
    far = _compared(posted, probes.where("step = 1").join(least, "query_id", "left"), k)
    pairs = written(near.select("query_id", "vec_id", "score").unionByName(far), "pairs")
    # Those that found too few read all lists of all cells.
    enough = pairs.groupBy("query_id").agg(F.countDistinct("vec_id").alias("n")).where(F.col("n") >= min(k, n - 1))
    short = asked.where(F.size("v") == d).join(enough, asked["vec_id"] == enough["query_id"], "left_anti").select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"))
    if n > 1 and not short.isEmpty():
        cells = (len(found.centroids) - 1) // CELL_LISTS
        every = short.withColumn("cell", F.explode(F.sequence(F.lit(0), F.lit(cells)))).withColumn("lists", F.array(F.lit(-1))).withColumn("least", none)
        pairs = pairs.unionByName(_compared(posted, every, k))
    return _short(pairs, k).select("query_id", "rank", "vec_id", "score")
