"""Removal of word windows that occur more than once, with a log-structured index of fingerprints.

Hashing every window of a corpus into an index would take as much room as the corpus. Of the short grams inside each
window one is selected, the least by hash; equal windows select equal grams, so a window can only occur twice if its
selected gram does. The index holds where the selected grams stand: each batch of documents adds a sorted, immutable run
of (fingerprint, text, position), and its distinct texts; runs are merged when there are too many. Runs are bucketed by
fingerprint, and texts by their key, so that what was added before is read in place, never shuffled: a batch's
fingerprints are dealt to the same buckets and merge-joined with every run. Windows around those that occur more than
once, in the batch and in what came before, are then verified by their own 64-bit hashes (among windows of one
fingerprint only), and words under a verified window go.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from helixframe.llm._common import bounded_batches, dropped, scratch_path, written
from helixframe.llm.near_dedup import mixed, word_hashes

WINDOW, GRAM = 35, 8
#: Fingerprints with more occurrences than this are verified by aggregates and joins, not within one task.
HEAVY = 1500
#: Runs of the index beyond which they are merged.
FANOUT = 4
#: Parts that equal heavy runs are dealt to where they meet their masks.
SALT = 32
#: Fingerprints that stand in more texts of a batch than this are kept beside the buckets, which they would make uneven.
CROWDED = 200_000

_BASE = 0x9E3779B97F4A7C15
_BITS = np.arange(WINDOW - GRAM + 1)
_INVERSE = pow(_BASE, -1, 1 << 64)


class Hasher:
    """Hashes of the grams and windows of a text, by prefix sums over powers of an odd base."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def _powers(self, n: int) -> None:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up))
            up, down = (np.full(size, b, dtype=np.uint64) for b in (_BASE, _INVERSE))
            up[0] = down[0] = 1
            self.up, self.down = np.multiply.accumulate(up), np.multiply.accumulate(down)

    def runs_of(self, sums: np.ndarray, length: int) -> np.ndarray:
        return mixed((sums[length:] - sums[:-length]) * self.down[: len(sums) - length])

    def sums(self, words: list[bytes]) -> np.ndarray:
        self._powers(len(words) + 1)
        return np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(word_hashes(words) * self.up[: len(words)])))

    def windows(self, words: list[bytes]) -> np.ndarray:
        return self.runs_of(self.sums(words), WINDOW) if len(words) >= WINDOW else np.zeros(0, dtype=np.uint64)

    def selected(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray] | None:
        """(prefix sums, gram hashes, position of each run's selected gram, first window of each run); None without a window.

        A run is a stretch of windows that select the same gram.
        """
        if len(words) < WINDOW:
            return None
        sums = self.sums(words)
        grams = self.runs_of(sums, GRAM)
        n = len(words) - WINDOW + 1
        at = np.arange(n) + sliding_window_view(grams, WINDOW - GRAM + 1).argmin(axis=1)
        first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
        return sums, grams, at[first], first


def _mapped(make: Callable[[Hasher, tuple], list[tuple]], types: dict[str, pa.DataType]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for b in batches:
            rows = [r for row in zip(*(c.to_pylist() for c in b.columns), strict=True) for r in make(hasher, row)]
            cols = list(zip(*rows, strict=True)) or [()] * len(types)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types.values(), strict=True)], names=list(types))

    return run


def text_key(text: Column) -> Column:
    """Names a text; null and empty ones share a name."""
    return F.unhex(F.md5(F.coalesce(text, F.lit(""))))


PLACE = {"fp": pa.int64(), "key": pa.binary(), "pos": pa.int32(), "copies": pa.int64(), "batch": pa.int32()}


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(fp, key, pos, copies, batch) of every selected gram of (key, text, copies, batch)."""
    hasher = Hasher()
    for b in batches:
        fps, pos, size = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int32)], []
        for text in b.column(1).to_pylist():
            found = hasher.selected((text or "").encode().split())
            size.append(0 if found is None else len(found[2]))
            if found is not None:
                fps.append(found[1][found[2]].view(np.int64))
                pos.append(found[2].astype(np.int32))
        row = pa.array(np.repeat(np.arange(b.num_rows), size))
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(fps)), b.column(0).take(row), pa.array(np.concatenate(pos)), b.column(2).take(row), b.column(3).take(row)], schema=pa.schema(PLACE))


def fingerprints(texts: DataFrame) -> DataFrame:
    return texts.select("key", "text", "copies", "batch").mapInArrow(_fingerprints, "fp long, key binary, pos int, copies long, batch int")


class Index:
    """Sorted immutable runs of (fp, key, pos, copies, batch), and the texts that the keys name, in buckets of a folder.

    Runs are only ever added, or replaced by their merger. ``copies`` rows have the text ``key``; it first came in
    ``batch``. Fingerprints in very many texts of a batch stand apart, unbucketed, where Spark splits their joins.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, buckets: int | None = None) -> None:
        self.spark, self.path, self.made, self.batches = spark, path or scratch_path(spark, "fingerprints"), 0, 0
        #: As many as the partitions that the other side of a join has, or Spark would shuffle both.
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.runs: list[DataFrame] = []
        self.crowded: list[DataFrame] = []
        self.texts: list[DataFrame] = []
        self.tables: list[str] = []
        self.folders: dict[int, str] = {}

    def _write(self, rows: DataFrame, by: str | None, name: str) -> DataFrame:
        at, table = f"{self.path}/{name}-{self.made:05d}", f"helixframe_{uuid.uuid4().hex}"
        self.made += 1
        if by is None:
            rows.write.parquet(at)
            out = self.spark.read.schema(rows.schema).parquet(at)
            self.folders[id(out)] = at
            return out
        # What an aggregate has just dealt out by the same key, to as many partitions, need not be dealt again.
        dealt = rows if by == "key" and self.buckets == int(self.spark.conf.get("spark.sql.shuffle.partitions")) else rows.repartition(self.buckets, by)
        dealt.write.bucketBy(self.buckets, by).sortBy(by).option("path", at).option("compression", "zstd").saveAsTable(table)
        self.tables.append(table)
        out = self.spark.table(table)
        self.folders[id(out)] = at
        return out

    def _all(self, parts: list[DataFrame]) -> DataFrame:
        """The rows of several parts, read without their buckets.

        The union of scans by bucket claims to be dealt out as they are, but isn't in this version of Spark; an aggregate
        of it would be wrong.
        """
        return self.spark.read.schema(parts[0].schema).parquet(*(self.folders[id(x)] for x in parts))

    def _run(self, places: DataFrame) -> None:
        """Write ``places``, a written table that is read twice and then goes, as a run."""
        crowd = places.groupBy("fp").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > CROWDED).select("fp")
        crowd = written(crowd, "crowd")
        if crowd.isEmpty():
            self.runs.append(self._write(places, "fp", "run"))
        else:
            self.runs.append(self._write(places.join(crowd, "fp", "left_anti"), "fp", "run"))
            self.crowded.append(self._write(places.join(crowd, "fp", "left_semi"), None, "crowded"))
        dropped(places, crowd)

    def add(self, docs: DataFrame) -> None:
        """Add a batch of documents as a run; merge the runs of earlier ones if there are many."""
        bounded_batches(self.spark)
        if len(self.runs) > FANOUT:
            self.compact()
        # Copies of a text are one row, also where they are a third of all.
        one = docs.select(text_key(F.col("text")).alias("key"), F.coalesce("text", F.lit("")).alias("text"))
        one = one.groupBy("key").agg(F.first("text").alias("text"), F.count(F.lit(1)).alias("copies"), F.lit(self.batches).cast("int").alias("batch"))
        self.batches += 1
        self.texts.append(self._write(one, "key", "texts"))
        self._run(written(fingerprints(self.texts[-1]), "places"))

    def compact(self) -> None:
        """Merge all runs into one, and all texts; the old ones go when it is written."""
        old, tables = [*self.runs, *self.crowded, *self.texts], self.tables
        if len(self.runs) > 1:
            self.tables = []
            places = self._all([*self.runs, *self.crowded])
            self.runs, self.crowded = [], []
            self._run(written(places.groupBy("fp", "key", "pos").agg(F.sum("copies").alias("copies"), F.min("batch").alias("batch")), "places"))
            texts = self._all(self.texts)
            self.texts = [self._write(texts.groupBy("key").agg(F.first("text").alias("text"), F.sum("copies").alias("copies"), F.min("batch").alias("batch")), "key", "texts")]
            for table in tables:
                self.spark.sql(f"drop table {table}")
            dropped(*old)
            self.folders = {id(x): self.folders[id(x)] for x in [*self.runs, *self.crowded, *self.texts]}

    def counts(self) -> DataFrame:
        """(fp, n) of all that was added."""
        return self._all([*self.runs, *self.crowded]).groupBy("fp").agg(F.sum("copies").alias("n"))

    def repeated(self, fps: DataFrame) -> DataFrame:
        """(fp, n) of those among ``fps`` that occur more than once in all that was added; no run is shuffled."""
        found, total = fps, F.lit(0).cast("long")
        for i, run in enumerate([*self.runs, *self.crowded]):
            found = found.join(run.groupBy("fp").agg(F.sum("copies").alias(f"n{i}")), "fp", "left")
            total = total + F.coalesce(f"n{i}", F.lit(0))
        return found.select("fp", total.alias("n")).where("n > 1")

    def places(self, fps: DataFrame) -> DataFrame:
        """The rows of all runs for the fingerprints of ``fps``, with its columns; no run is shuffled."""
        return reduce(DataFrame.unionByName, [run.join(fps, "fp") for run in [*self.runs, *self.crowded]])

    def firsts(self, keys: DataFrame) -> DataFrame:
        """(key, first) of the texts that ``keys`` names: the first batch that they came in; no text is shuffled."""
        for i, t in enumerate(self.texts):
            keys = keys.join(t.select("key", F.col("batch").alias(f"b{i}")), "key", "left")
        return keys.select("key", F.least(F.lit(None).cast("int"), *(f"b{i}" for i in range(len(self.texts)))).alias("first"))

    def named(self, keys: DataFrame) -> DataFrame:
        """The texts of ``keys`` (key, first, others) as (key, text, others), once each; no text is shuffled."""
        return reduce(DataFrame.unionByName, [t.select("key", "text", "batch").join(keys, "key").where("batch = first").drop("batch", "first") for t in self.texts])


def _windows(hasher: Hasher, row: tuple) -> list[tuple]:
    """(fp, n, key, firsts, copies, windows) of the runs of a text whose selected gram is among the candidates; equal ones as one."""
    key, text, places = row
    found = hasher.selected(text.encode().split())
    if found is None:
        return []
    sums, grams, at, first = found
    windows = hasher.runs_of(sums, WINDOW).view(np.int64)
    ends = np.append(first[1:], len(windows))
    often = {p["pos"]: (p["n"], p["copies"]) for p in places}
    runs: dict[tuple[int, bytes], tuple[int, int, list[int]]] = {}
    for p, a, e in zip(at.tolist(), first.tolist(), ends.tolist(), strict=True):
        if p in often:
            n, copies = often[p]
            runs.setdefault((int(grams[p].view(np.int64)), windows[a:e].tobytes()), (n, copies, []))[2].append(a)
    return [(fp, n, key, firsts, copies * len(firsts), np.frombuffer(raw, dtype=np.int64)) for (fp, raw), (n, copies, firsts) in runs.items()]


JUDGED = {"fp": pa.int64(), "key": pa.binary(), "firsts": pa.list_(pa.int32()), "copies": pa.int64(), "windows": pa.list_(pa.int64()), "mask": pa.int64()}


def _judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs with a repeated window and the mask of those windows; runs of heavy fingerprints as they are, without one.

    Rows come sorted by fingerprint, and all of a light one are here.
    """

    def given(rows: pa.Table, hit: np.ndarray, mask: np.ndarray | None) -> pa.RecordBatch:
        at = pa.array(hit)
        none = pa.nulls(len(hit), pa.int64())
        cols = [rows[c].combine_chunks().take(at) for c in ("fp", "key", "firsts", "copies")]
        windows = rows["windows"].combine_chunks().take(at) if mask is None else pa.nulls(len(hit), JUDGED["windows"])
        return pa.RecordBatch.from_arrays([*cols, windows, none if mask is None else pa.array(mask)], schema=pa.schema(JUDGED))

    def judged(rows: pa.Table) -> pa.RecordBatch:
        lists = rows["windows"].combine_chunks()
        values, starts = lists.flatten().to_numpy(), lists.offsets.to_numpy()
        starts = starts - starts[0]
        lengths = np.diff(starts)
        _, inverse = np.unique(values, return_inverse=True)
        counts = np.bincount(inverse, weights=np.repeat(rows["copies"].to_numpy(), lengths))
        inside = np.arange(len(values)) - np.repeat(starts[:-1], lengths)
        mask = np.bitwise_or.reduceat(np.where(counts[inverse] > 1, np.int64(1) << inside, 0), starts[:-1])
        hit = np.flatnonzero(mask)
        return given(rows, hit, mask[hit])

    held: list[pa.RecordBatch] = []
    size = 0
    for b in batches:
        heavy = b["n"].to_numpy() > HEAVY
        if heavy.any():
            yield given(pa.Table.from_batches([b]), np.flatnonzero(heavy), None)
            b = b.filter(pa.array(~heavy))
        if not b.num_rows:
            continue
        held.append(b)
        size += b.num_rows
        if size >= 20_000:
            rows = pa.Table.from_batches(held)
            fps = rows["fp"].to_numpy()
            cut = int(np.searchsorted(fps, fps[-1]))  # the last fingerprint may go on
            if cut:
                yield judged(rows.slice(0, cut))
            held, size = rows.slice(cut).to_batches(), rows.num_rows - cut
    if size:
        yield judged(pa.Table.from_batches(held))


def _heavy(runs: DataFrame) -> DataFrame:
    """Masks as of _judged(), for any number of runs to a fingerprint: equal runs are counted before their windows are."""
    classes = runs.groupBy("fp", "windows").agg(F.sum("copies").alias("copies"))
    each = classes.select("fp", "windows", "copies", F.posexplode("windows").alias("j", "w"))
    often = each.groupBy("w").agg(F.sum("copies").alias("n")).where("n > 1").select("w")
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("j"))
    masks = each.join(often, "w").groupBy("fp", "windows").agg(F.sum(bit).alias("mask"))
    masks = masks.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    salted = runs.withColumn("salt", F.pmod(F.xxhash64("key", F.col("firsts")[0]), F.lit(SALT)).cast("int"))
    return salted.join(masks, ["fp", "windows", "salt"]).select("key", "firsts", "mask")


def _kept(hasher: Hasher, row: tuple) -> list[tuple]:
    key, text, with_text, flags = row
    words = text.encode().split()
    removed = 0
    if flags:
        firsts = np.array([a for f in flags for a in f["firsts"]], dtype=np.int64)
        mask = np.repeat(np.array([f["mask"] for f in flags], dtype=np.int64), [len(f["firsts"]) for f in flags])
        starts = (firsts[:, None] + _BITS)[(mask[:, None] >> _BITS) & 1 == 1]
        delta = np.zeros(len(words) + 1, dtype=np.int64)
        np.add.at(delta, starts, 1)
        np.add.at(delta, starts + WINDOW, -1)
        keep = delta.cumsum()[:-1] == 0
        removed = len(words) - int(keep.sum())
        if removed:
            words = [w for w, k in zip(words, keep.tolist(), strict=True) if k]
    kept = b" ".join(words)
    return [(key, len(words) + removed, removed, hashlib.sha256(kept).hexdigest(), kept.decode() if with_text else None)]


def remove_repeats(docs: DataFrame, index: Index, *, with_text: bool = True) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_words, n_removed, kept_sha256, kept_text (kept words, one space between; null unless ``with_text``).

    Words are runs of characters other than space and U+0009 to U+000D, unchanged. A word goes if a window of 35
    consecutive words over it starts anywhere else as well, in this or any other row that was added to ``index``; windows
    are those of the input. ``index`` must hold the rows of ``docs``, added in any number of batches, and may hold any
    others: to judge a new batch against all before it, add it, then call this with the batch alone.

    A null or empty text has no words; texts of fewer than 35 words have no window and stay whole. A text of any length
    is judged whole, by one task that holds some 30 bytes for each of its words. A null doc_id stays null. Repeated rows
    are occurrences of their own, so all their windows go. No row gives no rows. Other columns are ignored.
    """
    bounded_batches(docs.sparkSession)
    if not index.texts:
        return docs.sparkSession.createDataFrame([], "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string")
    # All that follows takes a text once, however many rows have it.
    keys = written(index.firsts(docs.select(text_key(F.col("text")).alias("key")).distinct()), "keys")
    own = index.named(keys)
    fps = fingerprints(own.withColumns({"copies": F.lit(1).cast("long"), "batch": F.lit(0)})).select("fp").distinct()
    wanted = written(index.repeated(fps), "wanted")
    at = index.places(wanted).groupBy("key", "pos", "n").agg(F.sum("copies").alias("copies"), F.min("batch").alias("first"))
    places = written(at.groupBy("key").agg(F.min("first").alias("first"), F.collect_list(F.struct("pos", "n", "copies")).alias("places")), "places")
    w_types = {"fp": pa.int64(), "n": pa.int64(), "key": pa.binary(), "firsts": pa.list_(pa.int32()), "copies": pa.int64(), "windows": pa.list_(pa.int64())}
    texts = index.named(places).select("key", "text", "places")
    runs = texts.mapInArrow(_mapped(_windows, w_types), "fp long, n long, key binary, firsts array<int>, copies long, windows array<long>")
    # By fingerprint, but heavy ones are spread; these go another way after this.
    runs = runs.repartition(F.when(F.col("n") > HEAVY, F.xxhash64("key", F.col("firsts")[0])).otherwise(F.col("fp"))).sortWithinPartitions("fp")
    judged = written(runs.mapInArrow(_judged, "fp long, key binary, firsts array<int>, copies long, windows array<long>, mask long"), "judged")
    light = judged.where("mask is not null").select("key", "firsts", "mask")
    heavy = _heavy(judged.where("mask is null").select("fp", "key", "firsts", "copies", "windows"))
    flags = written(light.unionByName(heavy).groupBy("key").agg(F.collect_list(F.struct("firsts", "mask")).alias("flags")), "flags")
    o_types = {"key": pa.binary(), "n_words": pa.int64(), "n_removed": pa.int64(), "kept_sha256": pa.string(), "kept_text": pa.string()}
    cleaned = own.join(flags, "key", "left").select("key", "text", F.lit(with_text).alias("with_text"), "flags").mapInArrow(_mapped(_kept, o_types), "key binary, n_words long, n_removed long, kept_sha256 string, kept_text string")
    # Written, so that Spark splits the join of rows with a text that very many have.
    cleaned = written(cleaned, "cleaned")
    return docs.select("doc_id", text_key(F.col("text")).alias("key")).join(cleaned, "key").select("doc_id", "n_words", "n_removed", "kept_sha256", "kept_text")


def indexed(docs: DataFrame, batches: int = 2) -> Index:
    """An index of ``docs``, added in ``batches`` parts as they would arrive."""
    index = Index(docs.sparkSession)
    for i in range(batches):
        index.add(docs.where(F.pmod(F.xxhash64("text"), F.lit(batches)) == i))
    return index
