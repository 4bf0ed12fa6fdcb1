"""k-mers and hashes of them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import BooleanType, LongType, StringType, StructField, StructType

MASK32 = 0xFFFFFFFF


def complemented(s: Column) -> Column:
    """Reverse complement in upper case; null for letters other than A, C, G, T and N."""
    up = F.upper(s)
    return F.when(up.rlike("^[ACGTN]*$"), F.translate(F.reverse(up), "ACGTN", "TGCAN"))


def kmers(df: DataFrame, k: int, *keep: str, seq: str = "seq") -> DataFrame:
    """keep, pos (from 0) and kmer (upper case) of each window of k bases; windows with any other letter are left out.

    The sequence is exploded by position, so that cutting and testing are compiled and no array of windows is made. It
    is cut as bytes, each base being one: in a string, finding a place means reading all characters before it.
    """
    n = F.octet_length("__seq")
    bytes_ = F.regexp_replace(F.upper(seq), "[^ACGT]", "N").cast("binary")
    at = df.select(*keep, bytes_.alias("__seq")).withColumn("pos", F.explode(F.when(n >= k, F.sequence(F.lit(0), n - k))))
    return at.select(*keep, "pos", F.substring("__seq", F.col("pos") + 1, F.lit(k)).cast("string").alias("kmer")).where(~F.col("kmer").contains("N"))


def both_strands(found: DataFrame) -> DataFrame:
    """Each k-mer on its strand and, in its own row, the one of the other strand, with strand + or -."""
    pair = F.array(F.struct(F.lit("+").alias("strand"), F.col("kmer").alias("kmer")), F.struct(F.lit("-").alias("strand"), F.translate(F.reverse("kmer"), "ACGT", "TGCA").alias("kmer")))
    rest = [c for c in found.columns if c != "kmer"]
    return found.select(*rest, F.explode(pair).alias("__s")).select(*rest, "__s.strand", "__s.kmer")


def canonical(kmer: Column) -> Column:
    return F.least(kmer, F.translate(F.reverse(kmer), "ACGT", "TGCA"))


def packed(kmer: Column) -> Column:
    """Two bits to a base, A 0 to T 3, for up to 31 bases."""
    return F.conv(F.translate(F.upper(kmer), "ACGT", "0123"), 4, 10).cast("long")


def unpacked(value: Column, k: int) -> Column:
    return F.translate(F.lpad(F.conv(value.cast("string"), 10, 4), k, "0"), "0123", "ACGT")


def hamming(a: Column, b: Column) -> Column:
    """Places in which two packed k-mers differ."""
    z = a.bitwiseXOR(b)
    return F.bit_count(z.bitwiseOR(F.shiftright(z, 1)).bitwiseAND(F.lit(0x5555555555555555)))


#: Two bits of each letter, 4 for any other, and bases that are packed at a time.
_CODES = np.full(256, 4, dtype=np.uint8)
for _i, _letters in enumerate((b"Aa", b"Cc", b"Gg", b"Tt")):
    _CODES[list(_letters)] = _i
AT_ONCE = 1 << 20


def hash32(x: np.ndarray, seed: int) -> np.ndarray:
    """with_hash32() of an array of packed k-mers."""
    m, h = np.uint64(MASK32), np.full(len(x), seed, dtype=np.uint64)
    rolled = lambda a, r: ((a << np.uint64(r)) | (a >> np.uint64(32 - r))) & m
    for word in (x >> np.uint64(32), x & m):
        h ^= rolled(word * np.uint64(0xCC9E2D51) & m, 15) * np.uint64(0x1B873593) & m
        h = (rolled(h, 13) * np.uint64(5) + np.uint64(0xE6546B64)) & m
    h ^= np.uint64(8)
    for shift, factor in ((16, 0x85EBCA6B), (13, 0xC2B2AE35)):
        h ^= h >> np.uint64(shift)
        h = h * np.uint64(factor) & m
    return h ^ (h >> np.uint64(16))


def packed_windows(codes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places, packed k-mers, those of the other strand) of the windows of ``codes`` without a letter other than A, C, G, T."""
    n = len(codes) - k + 1
    if n < 1:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.uint64)
    odd = np.concatenate(([0], np.cumsum(codes > 3)))
    at = np.flatnonzero(odd[k:] == odd[:-k])
    c = (codes & 3).astype(np.uint64)
    x, y = np.zeros(n, dtype=np.uint64), np.zeros(n, dtype=np.uint64)
    for j in range(k):
        x = (x << np.uint64(2)) | c[j : j + n]
        y |= (np.uint64(3) - c[j : j + n]) << np.uint64(2 * j)
    return at, x[at], y[at]


def packed_kmers(df: DataFrame, k: int, *keep: str, seq: str = "seq", strands: str = "canonical", seed: int | None = None, among: int = 1, take: int = 1) -> DataFrame:
    """Counted k-mers of up to 31 bases as packed longs: keep, x, strand, palindrome and n, partial counts of each.

    ``strands`` is "forward", "both" (each k-mer, and its reverse complement with strand -) or "canonical" (the lesser of
    the two). With a ``seed`` only those stay whose hash32() leaves less than ``take`` when divided by ``among``. Letters
    are packed, compared, hashed and counted as arrays of a million bases, which takes a tenth of the time of cutting
    texts, and what leaves is eight bytes to a k-mer; rows of one ``keep`` are counted together as far as they come in one
    batch. Sequences of any length are cut with overlaps; a null one has no k-mers.
    """
    if not 0 < k < 32 or strands not in ("forward", "both", "canonical"):
        raise ValueError("k must be 1 to 31, strands forward, both or canonical")

    def counted(rows: np.ndarray, x: np.ndarray, strand: np.ndarray, palindrome: np.ndarray, b: pa.RecordBatch) -> pa.RecordBatch:
        if seed is not None:
            hit = hash32(x, seed) % np.uint64(among) < np.uint64(take)
            rows, x, strand, palindrome = rows[hit], x[hit], strand[hit], palindrome[hit]
        order = np.lexsort((x, strand, rows)) if keep else np.lexsort((x, strand))
        rows, x, strand, palindrome = (a[order] for a in (rows if keep else np.zeros_like(rows), x, strand, palindrome))
        new = np.ones(len(x), dtype=bool)
        new[1:] = (x[1:] != x[:-1]) | (strand[1:] != strand[:-1]) | (rows[1:] != rows[:-1])
        first = np.flatnonzero(new)
        n = np.diff(np.append(first, len(x)))
        signs = pa.array(np.where(strand[first], "-", "+"), pa.string())
        return pa.RecordBatch.from_arrays([*(c.take(pa.array(rows[first])) for c in b.columns[:-1]), pa.array(x[first].view(np.int64)), signs, pa.array(palindrome[first]), pa.array(n.astype(np.int64))], names=[*keep, "x", "strand", "palindrome", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pieces, owner, size = [], [], 0
            for i, text in enumerate(b.column(len(keep)).to_pylist()):
                raw = (text or "").encode()
                for start in range(0, max(len(raw) - k + 1, 0), AT_ONCE):
                    piece = raw[start : start + AT_ONCE + k - 1]
                    # A letter that is none keeps sequences apart.
                    pieces.append(piece + b" ")
                    owner.append((i, len(piece) + 1))
                    size += len(piece)
                    if size >= AT_ONCE:
                        yield packed(pieces, owner, b)
                        pieces, owner, size = [], [], 0
            if pieces:
                yield packed(pieces, owner, b)

    def packed(pieces: list[bytes], owner: list[tuple[int, int]], b: pa.RecordBatch) -> pa.RecordBatch:
        codes = _CODES[np.frombuffer(b"".join(pieces), dtype=np.uint8)]
        at, x, y = packed_windows(codes, k)
        rows = np.repeat(np.array([i for i, _ in owner]), [n for _, n in owner])[at]
        same = x == y
        if strands == "both":
            return counted(np.tile(rows, 2), np.concatenate((x, y)), np.repeat([False, True], len(x)), np.tile(same, 2), b)
        return counted(rows, np.minimum(x, y) if strands == "canonical" else x, np.zeros(len(x), dtype=bool), same, b)

    kept = df.select(*keep)
    schema = StructType([*kept.schema.fields, StructField("x", LongType()), StructField("strand", StringType()), StructField("palindrome", BooleanType()), StructField("n", LongType())])
    return df.select(*keep, F.col(seq).alias("__seq")).mapInArrow(run, schema)


def _times32(a: Column, c: int) -> Column:
    # In halves, as the whole product could overflow a long.
    low, high = a.bitwiseAND(F.lit(0xFFFF)) * c, F.shiftleft((F.shiftright(a, 16) * c).bitwiseAND(F.lit(0xFFFF)), 16)
    return (low + high).bitwiseAND(F.lit(MASK32))


def _rolled32(a: Column, r: int) -> Column:
    return F.shiftleft(a, r).bitwiseOR(F.shiftright(a, 32 - r)).bitwiseAND(F.lit(MASK32))


def with_hash32(df: DataFrame, source: str, out: str, seed: int) -> DataFrame:
    """``df`` with out, the 32-bit Murmur3 hash of a long given as two words, the high one first.

    Steps are columns of their own, so that none is written into the next one several times over.
    """
    step = lambda d, c: d.withColumn("__h", c)
    h, w = F.col("__h"), F.col("__w")
    x = F.col(source).cast("long")
    now = df.withColumn("__h", F.lit(seed).cast("long"))
    for word in (F.shiftrightunsigned(x, 32), x.bitwiseAND(F.lit(MASK32))):
        now = now.withColumn("__w", _times32(word, 0xCC9E2D51))
        now = now.withColumn("__w", _times32(_rolled32(w, 15), 0x1B873593))
        now = step(now, h.bitwiseXOR(w))
        now = step(now, (_rolled32(h, 13) * 5 + 0xE6546B64).bitwiseAND(F.lit(MASK32)))
    now = step(now, h.bitwiseXOR(F.lit(8)))
    for shift, factor in ((16, 0x85EBCA6B), (13, 0xC2B2AE35)):
        now = step(now, h.bitwiseXOR(F.shiftright(h, shift)))
        now = step(now, _times32(h, factor))
    # A zero that formally depends on the partition: else a filter on the hash would be moved below all these steps,
    # with each step written into the next one as often as that reads it.
    zero = F.spark_partition_id().cast("long").bitwiseAND(F.lit(0).cast("long"))
    return now.withColumn(out, h.bitwiseXOR(F.shiftright(h, 16)).bitwiseOR(zero)).drop("__h", "__w")


#: Multiplier, left and right rotation of each round of the multiply-rotate hash (fixed values).
ROUNDS = ((0x3B7D530F5D27B987, 15, 13), (0xFC3C906111DE6791, 20, 19))


def multiply_rotate(h: np.ndarray, rounds=ROUNDS) -> np.ndarray:
    for x, left, right in rounds:
        h = h * np.uint64(x)
        h = h ^ ((h << np.uint64(left)) | (h >> np.uint64(64 - left)))
        h = h ^ ((h >> np.uint64(right)) | (h << np.uint64(64 - right)))
    return h


@F.pandas_udf(LongType())
def mixed64(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Multiply-rotate hash of a long: mixed64(seed, x), as a signed long."""
    for seed, x in parts:
        yield pd.Series(multiply_rotate(seed.to_numpy(dtype=np.int64).view(np.uint64) ^ x.to_numpy(dtype=np.int64).view(np.uint64)).view(np.int64))


@F.pandas_udf(LongType())
def mixed64_text(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Multiply-rotate hash of a text's bytes, eight at a time: mixed64_text(seed, text).

    All texts of a batch that have an i-th word take its step together.
    """
    for seeds, texts in parts:
        raw = [t.encode() for t in texts]
        h = seeds.to_numpy(dtype=np.int64).view(np.uint64).copy()
        size = np.array([len(r) for r in raw], dtype=np.int64)
        for i in range(0, int(size.max(initial=0)), 8):
            at = np.flatnonzero(size > i)
            # A short last word is a smaller number, not one with zeros behind.
            word = np.frombuffer(b"".join(raw[j][i : i + 8].rjust(8, b"\0") for j in at), dtype=">u8").astype(np.uint64)
            h[at] = multiply_rotate(h[at] ^ word)
        yield pd.Series(h.view(np.int64))


def sampled(df: DataFrame, kmer: str, seed: int, among: int, take: int = 1) -> DataFrame:
    """The rows whose k-mer's hash leaves less than ``take`` when divided by ``among``: the same k-mers in every table."""
    return with_hash32(df.withColumn("__k", packed(F.col(kmer))), "__k", "__hash", seed).where(F.col("__hash") % among < take).drop("__k", "__hash")
