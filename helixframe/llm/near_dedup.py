"""Near-duplicate documents by an inverted join over the coordinates of MinHash signatures.

Each distinct shingle set posts itself under the (coordinate, value) pairs of its signature. Two sets of similarity s
agree in about s of the coordinates, so pairs that agree in at least ``MATCHES`` of ``COORDINATES`` are the candidates.
They are found without counting all collisions: the pairs of a set are put in order of rarity, and two sets that agree
in MATCHES places must meet in the prefixes that leave out the MATCHES - 1 most frequent ones. Only prefixes are
joined; the skipped, frequent lists are merged against for the pairs met there. What remains is confirmed on full sets.

A posting list can hold a third of the corpus, and its pairs are never written out. In each round the sets of a list
meet one of their number only, its lead; collisions of these pairs are counted, those above the threshold confirmed, and
linked sets contracted. Lists whose sets are all connected are done with. The sets of lists that stay open, of which no
lead told all, are compared exactly: they are posted once more, under the rarest of their shingles, as few of them as
any set similar enough must share. Components of the links that are found are those of all links.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, functions as F

from helixframe.llm._common import bounded_batches, written
from helixframe.llm.components import components

SHINGLE, COORDINATES, MATCHES = 5, 64, 30
#: Similarity in hundredths from which two documents are linked.
SIMILARITY = 75
#: Rounds in which the sets of a list meet its lead, before what is open is compared by shingles. Any number, none
#: included, gives the same components.
ROUNDS = 2

_random = np.random.Generator(np.random.PCG64(20240229))
_FACTORS = _random.integers(0, 1 << 63, COORDINATES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADDENDS = _random.integers(0, 1 << 63, COORDINATES, dtype=np.uint64)
_PLACES = _random.integers(0, 1 << 63, SHINGLE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def word_hashes(words: list[bytes]) -> np.ndarray:
    """64-bit hashes; computing one costs less than remembering it, as most words are rare."""
    return np.frombuffer(b"".join([xxhash.xxh3_64_digest(w) for w in words]), dtype=">u8").astype(np.uint64)


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread 64-bit values evenly (in place)."""
    for shift, factor in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53)):
        h ^= h >> np.uint64(shift)
        h *= np.uint64(factor)
    h ^= h >> np.uint64(33)
    return h


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted distinct hashes of the shingles of ``text``; A-Z count as lower case."""
    words = (text or "").encode().lower().split()
    if len(words) < SHINGLE:
        return np.array([xxhash.xxh3_64_intdigest(b"\x00".join(words), seed=len(words))] if words else [], dtype=np.uint64)
    w = word_hashes(words)
    n = len(w) - SHINGLE + 1
    h = np.zeros(n, dtype=np.uint64)
    for i, place in enumerate(_PLACES):
        h += w[i : i + n] * place
    return np.unique(mixed(h))


def signature(shingles: np.ndarray) -> np.ndarray:
    """The pairs of the signature, as coordinate << 32 | value."""
    least = np.full(COORDINATES, np.iinfo(np.uint64).max, dtype=np.uint64)
    for i in range(0, len(shingles), 2048):
        x = shingles[None, i : i + 2048] * _FACTORS[:, None]
        x += _ADDENDS[:, None]
        np.minimum(least, x.min(axis=1), out=least)
    return ((least >> np.uint64(32)) | (np.arange(COORDINATES, dtype=np.uint64) << np.uint64(32))).astype(np.int64)


def _per_row(make: Callable, types: dict[str, pa.DataType]) -> Callable:
    """A function over Arrow batches that makes a row, or none, of each row with ``make(*row)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [r for row in zip(*(c.to_pylist() for c in b.columns), strict=True) if (r := make(*row)) is not None]
            cols = list(zip(*rows, strict=True)) or [()] * len(types)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types.values(), strict=True)], names=list(types))

    return run


def _signed(doc_id: int | None, text: str | None) -> tuple:
    s = shingle_set(text)
    key = hashlib.md5(text.encode()).digest() if text is not None else None
    if not len(s):
        return doc_id, key, 0, None, None
    return doc_id, key, len(s), xxhash.xxh3_128_digest(s.tobytes()), signature(s)


def _packed(doc_id: int | None, text: str | None) -> tuple | None:
    return text and (doc_id, hashlib.md5(text.encode()).digest(), zstandard.compress(text.encode(), 1)) or None


def _sets(cid: int, keys: list[int], z: bytes) -> tuple:
    return cid, keys, shingle_set(zstandard.decompress(z).decode()).view(np.int64)


def _postings(classes: DataFrame) -> DataFrame:
    """(key, cid, size, common) of the prefixes of all signatures that can have a partner; common: how many its keys reach."""
    posted = classes.select("cid", F.explode("keys").alias("key"))
    shared = posted.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    lists = posted.join(shared, "key").groupBy("cid").agg(F.collect_list(F.struct("n", "key")).alias("l")).where(F.size("l") >= MATCHES)
    # Pairs that nobody shares stand first in the order and need no posting, so the prefix is that much shorter.
    prefix = F.slice(F.array_sort("l"), F.lit(1), F.size("l") - (MATCHES - 1))
    common = F.aggregate("l", F.lit(0).cast("long"), lambda a, x: a + x["n"])
    sizes = classes.select("cid", F.col("n_shingles").alias("size"))
    rows = lists.join(sizes, "cid").select("cid", "size", common.alias("common"), F.explode(prefix).alias("p"))
    return rows.select(F.col("p.key").alias("key"), "cid", "size", "common")


def _open_lists(posts: DataFrame, *leads: Column) -> DataFrame:
    """(key, leads) of the lists that hold sets of several components."""
    lists = posts.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"), *leads)
    return lists.where("low <> high").drop("low", "high")


def _similar_sizes(a: Column, b: Column) -> Column:
    return (a * 100 >= b * SIMILARITY) & (b * 100 >= a * SIMILARITY)


def _least_common(a: Column, b: Column) -> Column:
    """How many shingles sets of these sizes have in common at least if they are linked."""
    return F.ceil((a + b) * SIMILARITY / (100 + SIMILARITY))


def _met_leads(posts: DataFrame, rank: Column) -> DataFrame:
    """(u, v) of the sets in open lists and the leads that they meet: of each list the set of the highest rank."""
    lead = F.max(F.struct(rank.alias("rank"), "cid", "component", "size")).alias("lead")
    met = posts.join(_open_lists(posts, lead), "key").where((F.col("component") != F.col("lead.component")) & _similar_sizes(F.col("size"), F.col("lead.size")))
    return met.select(F.col("cid").alias("u"), F.col("lead.cid").alias("v")).distinct()


def _met_shingles(posts: DataFrame, sets: DataFrame) -> DataFrame:
    """(u, v) of sets of open lists that share one of their rarest shingles, as all linked ones of two components do.

    Shingles are in one order for all sets: first those of one component only, which no pair has in common, then by
    their number. Linked sets have so many in common that the first of these stands early in both.
    """
    cids = posts.join(_open_lists(posts), "key", "left_semi").select("cid", "component").distinct()
    each = sets.join(cids, "cid").select("cid", "component", F.size("shingles").alias("size"), F.explode("shingles").alias("g"))
    often = each.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("g", "n")
    lists = each.join(often, "g").groupBy("cid").agg(F.first("component").alias("component"), F.first("size").alias("size"), F.array_sort(F.collect_list(F.struct("n", "g"))).alias("l"))
    own, before = F.col("size"), F.col("size") - F.size("l")
    lists = lists.select("cid", "component", "size", before.alias("before"), F.posexplode(F.slice("l", F.lit(1), F.greatest(own - F.ceil(own * SIMILARITY / 100) + 1 - before, F.lit(0)).cast("int"))).alias("i", "p"))
    placed = written(lists.select(F.col("p.g").alias("g"), "cid", "component", "size", (F.col("size") - F.col("before") - F.col("i")).alias("left")), "rarest")
    # The smaller of two sets need be posted with fewer: its partner is no smaller.
    less = placed.where(F.col("left") >= _least_common(own, own)).select("g", *(F.col(c).alias(f"{c}2") for c in ("cid", "component", "size", "left")))
    need = _least_common(F.col("size"), F.col("size2"))
    pairs = placed.join(less, "g").where(
        (F.col("component") != F.col("component2"))
        & ((F.col("size2") < F.col("size")) | ((F.col("size2") == F.col("size")) & (F.col("cid2") < F.col("cid"))))
        & (F.col("left") >= need) & (F.col("left2") >= need)
    )
    return pairs.select(F.col("cid").alias("u"), F.col("cid2").alias("v")).distinct()


def _confirmed(pairs: DataFrame, sets: DataFrame, least: int) -> DataFrame:
    """The pairs that agree in ``least`` coordinates and whose sets are similar enough."""
    one, other = (sets.select(F.col("cid").alias(c), F.col("keys").alias(f"{c}_keys"), F.col("shingles").alias(f"{c}_set")) for c in "uv")
    both = pairs.join(one, "u").join(other, "v")
    if least:
        both = both.where(F.size(F.array_intersect("u_keys", "v_keys")) >= least)
    same = F.size(F.array_intersect("u_set", "v_set"))
    return both.where(same >= _least_common(F.size("u_set"), F.size("v_set"))).select("u", "v")


def links(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """(u, v) that connect the classes of equal sets as all links do; ``classes``: cid, doc_id, text_key, n_shingles, keys."""
    posts = written(_postings(classes), "postings").withColumn("component", F.col("cid"))
    posts = written(posts.join(_open_lists(posts), "key", "left_semi"), "postings")
    wanted = classes.join(posts.select("cid").distinct(), "cid", "left_semi").select("cid", F.col("doc_id").alias("d"), F.col("text_key").alias("t"), "keys")
    texts = docs.select("doc_id", "text").mapInArrow(_per_row(_packed, {"doc_id": pa.int64(), "text_key": pa.binary(), "z": pa.binary()}), "doc_id long, text_key binary, z binary")
    # A row that is repeated as a whole brings its set once.
    found = texts.join(wanted, (F.col("text_key") == F.col("t")) & F.col("doc_id").eqNullSafe(F.col("d"))).groupBy("cid").agg(F.first("keys").alias("keys"), F.first("z").alias("z"))
    types = {"cid": pa.int64(), "keys": pa.list_(pa.int64()), "shingles": pa.list_(pa.int64())}
    sets = written(found.mapInArrow(_per_row(_sets, types), "cid long, keys array<long>, shingles array<long>"), "sets")

    linked = None
    for i in range(ROUNDS + 1):
        if linked is not None:
            member = components(linked)
            at = posts.drop("component").join(member.withColumnRenamed("node", "cid"), "cid", "left").withColumn("component", F.coalesce("component", "cid"))
            posts = written(at.join(_open_lists(at), "key", "left_semi"), "postings")
        if i < ROUNDS:
            # First the set whose pairs are the commonest, as that of which all others are copies is; then any.
            pairs = _met_leads(posts, F.col("common") if not i else F.xxhash64("cid", F.lit(i)))
            new = _confirmed(written(pairs, "pairs"), sets, MATCHES)
        else:
            new = _confirmed(written(_met_shingles(posts, sets), "pairs"), sets, 0)
        new = written(new, "links")
        linked = new if linked is None else linked.unionByName(new)
    return linked


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id, kept, keeper, text_key.

    A text's words are runs of characters other than space and U+0009 to U+000D, with A-Z in lower case; its set holds
    the distinct runs of five words, or all its words as one if they are fewer. Texts are linked if the sets' common part is
    at least 75 hundredths of their union. component_id is the least doc_id that links lead to, kept whether that is the
    row's own. ``keeper`` marks the rows of a component that have its least (doc_id, md5 of the text): one row, unless
    a row is repeated as a whole.

    A null or empty text, or one without words, has an empty set and is linked with nothing. A null doc_id is never the
    component's id unless no row of the component has one. Of rows with one doc_id and different texts each has its own
    links. No row gives no rows. Other columns are ignored. Texts of any length are taken whole; one task holds some 20
    bytes for each of its words. A pair at the least similarity has a chance of about four in ten million to agree in
    fewer than MATCHES coordinates, more similar ones less; such a pair is overlooked unless both have other partners.
    """
    bounded_batches(docs.sparkSession)
    types = {"doc_id": pa.int64(), "text_key": pa.binary(), "n_shingles": pa.int64(), "set_key": pa.binary(), "keys": pa.list_(pa.int64())}
    rows = written(docs.select("doc_id", "text").mapInArrow(_per_row(_signed, types), "doc_id long, text_key binary, n_shingles long, set_key binary, keys array<long>"), "rows")
    made = rows.where("set_key is not null").groupBy("set_key").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")).alias("least"), F.first("keys").alias("keys"), F.first("n_shingles").alias("n_shingles"))
    # Ids are given once, in the written table, and are the same for all that reads it.
    classes = written(made.select(F.monotonically_increasing_id().alias("cid"), "set_key", "least.doc_id", "least.text_key", "n_shingles", "keys"), "classes")
    member = components(links(docs, classes))
    in_comp = classes.select("cid", "set_key", "doc_id", "text_key").join(member.withColumnRenamed("node", "cid"), "cid", "left").withColumn("component", F.coalesce("component", "cid"))
    least = in_comp.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")).alias("least"))
    named = in_comp.join(least, "component").select("set_key", F.col("least.doc_id").alias("cdoc"), F.col("least.text_key").alias("ckey"))
    own = F.col("set_key").isNull()
    out = rows.select("doc_id", "text_key", "n_shingles", "set_key").join(named, "set_key", "left")
    component = F.when(own, F.col("doc_id")).otherwise(F.col("cdoc"))
    return out.select(
        "doc_id",
        "n_shingles",
        component.alias("component_id"),
        F.col("doc_id").eqNullSafe(component).alias("kept"),
        (own | (F.col("doc_id").eqNullSafe(F.col("cdoc")) & F.col("text_key").eqNullSafe(F.col("ckey")))).alias("keeper"),
        "text_key",
    )


def without_near_duplicates(docs: DataFrame) -> DataFrame:
    """One row of each component of near duplicates in ``docs``, with all its columns: the one of least doc_id.

    Rows without a word are no duplicates and stay; of rows that agree in doc_id and text one stays.
    """

    def row_key(doc_id: Column, text_key: Column) -> Column:
        return F.md5(F.concat_ws("|", F.coalesce(doc_id.cast("string"), F.lit("-")), F.coalesce(text_key, F.lit("-"))))

    keep = near_duplicates(docs).where("keeper").select(row_key(F.col("doc_id"), F.lower(F.hex("text_key"))).alias("key"))
    # Rows travel as one column each, so that no name of theirs meets another. One shuffle on the key serves both steps.
    keyed = docs.select(row_key(F.col("doc_id"), F.md5("text")).alias("key"), F.struct(*docs.columns).alias("row"))
    return keyed.join(keep, "key", "left_semi").dropDuplicates(["key"]).select("row.*")
