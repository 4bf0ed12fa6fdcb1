"""Benchmark decontamination by spaced seeds, in DataFrame functions only.

Fixed masks select some tokens of a short stretch and ignore the others, so a hash under a mask survives substitutions at
the ignored places. Every position of a training text is hashed under every mask and joined with the hashes of the test
items; each hit fixes an alignment, and the tokens around it are compared one by one. The masks are chosen so that no
overlap within the tolerance is without a hit (a test tries all placements of the substitutions).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

#: Token places that each mask looks at.
MASKS = ("11111", "111011", "1101101")
#: Tokens of an overlap, and how many of them may differ, in hundredths rounded down (two of thirteen).
WINDOW, TOLERANCE = 13, 16
#: Items with fewer tokens are no evidence of anything.
SHORTEST = 5
#: The test side is broadcast up to this many bytes, by its measured size; beyond that the hashes are shuffled.
BROADCAST_BYTES = 32 << 20


def tokens(text: Column) -> Column:
    """Runs of letters and digits, in lower case."""
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")


def _hashed(df: DataFrame, *keys: str) -> DataFrame:
    """keys and h, the hashes of each text's tokens in order."""
    return df.select(*keys, F.transform(tokens(F.col("text")), lambda t: F.xxhash64(t)).alias("h"))


def _seeded(df: DataFrame, at: str, seed: str) -> DataFrame:
    """A row for every position and mask that fits there."""
    h, i, n = F.col("h"), F.col(at), F.size("h")
    hashes = []
    for m, mask in enumerate(MASKS):
        picked = F.xxhash64(F.lit(m), *(F.get(h, i + o) for o, c in enumerate(mask) if c == "1"))
        hashes.append(F.when(i + len(mask) <= n, picked))
    # Not a filter on the size, which would be moved below the projection and cut every text into tokens twice.
    placed = df.withColumn(at, F.explode(F.when(n >= SHORTEST, F.sequence(F.lit(0), n - SHORTEST))))
    return placed.withColumn(seed, F.explode(F.array(*hashes))).where(F.col(seed).isNotNull())


def _same(h: str, b: str, i: Column, p: Column) -> Column:
    """Whether the tokens at i of the text and p of the item exist and agree."""
    return (i >= 0) & (p >= 0) & F.coalesce(F.get(F.col(h), i) == F.get(F.col(b), p), F.lit(False))


def _window() -> Column:
    return F.least(F.lit(WINDOW), F.size("b"))


def _goes_on() -> Column:
    """Whether a mask also fits one place earlier: only the first hit of such a row need be verified."""
    i, p = F.col("i") - 1, F.col("p") - 1
    return reduce(Column.__or__, (reduce(Column.__and__, (_same("h", "b", i + o, p + o) for o, c in enumerate(m) if c == "1")) for m in MASKS))


def _matches() -> Column:
    """The most tokens that agree in any window of the alignment near the hit."""
    w, d = _window(), F.col("i") - F.col("p")
    # A row of hits that is longer than this reach to the right is an exact overlap at its start already.
    near = F.transform(F.sequence(F.col("p") - w + 1, F.col("p") + 2 * w + len(MASKS[-1])), lambda j: F.when(_same("h", "b", j + d, j), 1).otherwise(0))
    return F.array_max(F.transform(F.sequence(F.lit(1), F.size("near") - w + 1), lambda q: F.aggregate(F.slice("near", q, w), F.lit(0), lambda a, x: a + x))), near


def overlaps(docs: DataFrame, items: DataFrame, *, key: str = "doc_id") -> DataFrame:
    """(key, item_id, window, matches) of every text in ``docs`` (key, text) that overlaps an item of ``items`` (item_id, text).

    A text overlaps an item if some window of 13 tokens of the item (all of a shorter one's) stands in the text with at
    most two tokens replaced by others (one of 7 to 12, none of fewer). matches is the most tokens of a window that agree.

    Null and empty texts, and items of fewer than five tokens, overlap nothing. Null keys and ids are passed on; rows of
    one key and item are merged. Without texts or items there are no rows. Other columns are ignored.
    """
    tests = _hashed(items, "item_id").withColumnRenamed("h", "b").where(F.size("b") >= SHORTEST).distinct()
    # h is what _seeded() reads.
    seeds = _seeded(tests.select("item_id", F.col("b").alias("h")), "p", "s").select("s", "item_id", "p", F.col("h").alias("b"))
    size = tests.agg(F.sum(F.size("b").cast("long") * len(MASKS) * (8 * F.size("b").cast("long") + 64)).alias("n")).first()["n"] or 0
    if size <= BROADCAST_BYTES:
        hits = _seeded(_hashed(docs, key), "i", "s").join(F.broadcast(seeds), "s")
        hits = hits.where(~_goes_on())
    else:
        named = docs.select(key, "text", F.md5("text").alias("text_key"))
        met = _seeded(_hashed(named, "text_key"), "i", "s").select("text_key", "i", "s").join(seeds.select("s", "item_id", "p", F.xxhash64("b").alias("which")), "s")
        met = met.select("text_key", "i", "p", "item_id", "which").distinct()
        hits = met.join(_hashed(named, "text_key", key), "text_key").join(tests.withColumn("which", F.xxhash64("b")).withColumnRenamed("item_id", "own"), "which")
        hits = hits.where(F.col("own").eqNullSafe(F.col("item_id"))).drop("own").where(~_goes_on())
    best, near = _matches()
    judged = hits.withColumn("near", near).select(key, "item_id", _window().alias("window"), best.alias("matches"))
    enough = F.col("matches") >= F.col("window") - F.floor(F.col("window") * TOLERANCE / 100)
    # Filtered after the sum only: before it, the filter would become part of the join, whose condition must be one that
    # is compiled, or every position of a text would be written out with all the text's tokens.
    best_of = judged.groupBy(key, "item_id").agg(F.max(F.when(enough, F.col("window"))).alias("window"), F.max(F.when(enough, F.col("matches"))).alias("matches"))
    return best_of.where("matches is not null")


def without_overlaps(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose text overlaps no item, with all their columns; null and empty texts stay."""
    keyed = docs.select(F.md5("text").alias("key"), "text", F.struct(*docs.columns).alias("row"))
    found = overlaps(keyed.select("key", "text"), items, key="key").select("key").distinct()
    return keyed.select("key", "row").join(found, "key", "left_anti").select("row.*")


#: The same by brute force: every alignment of every text and item that shares a token, counted window by window.
ORACLE = rf"""
with d as (select doc_id, list_filter(string_split_regex(lower(text), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '') as t from documents),
b as (select item_id, list_filter(string_split_regex(lower(text), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '') as t from benchmark),
dt as (select doc_id, unnest(t) as w, unnest(range(len(t))) as i from d),
bt as (select item_id, unnest(t) as w, unnest(range(len(t))) as p, least({WINDOW}, len(t)) as win, len(t) as n from b where len(t) >= {SHORTEST}),
al as (select doc_id, item_id, i - p as diag, p, win, n from dt join bt using (w)),
bu as (select doc_id, item_id, diag from al group by all having count(*) >= max(win) - max(win) * {TOLERANCE} // 100),
c as (select al.*, count(*) over (partition by doc_id, item_id, diag order by p range between current row and {WINDOW - 1} following) as m13, count(*) over (partition by doc_id, item_id, diag) as mall from al semi join bu using (doc_id, item_id, diag))
select doc_id, item_id, max(win) as "window", max(case when n < {WINDOW} then mall else m13 end) as matches from c group by doc_id, item_id
having max(case when n < {WINDOW} then mall else m13 end) >= max(win) - max(win) * {TOLERANCE} // 100
"""
