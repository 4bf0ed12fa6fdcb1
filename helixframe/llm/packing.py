"""Sequence packing by power-of-two decomposition.

Every document, tokenised and closed by an end id, is cut into pieces whose lengths are the binary digits of its token
count, the largest ones ``max_len`` long. A piece is a training sequence by itself: no sequence crosses documents, and
no sequence needs padding because every length is a power of two. Equal lengths form the buckets that a trainer draws
batches from. The cut is local to a document, so there is no shuffle, and any executor can redo any part.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from helixframe.llm._common import bounded_batches

#: The pre-tokenisation pattern of the public byte-level vocabulary (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: What that pattern takes for white space (fixed value).
SPACES = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Runs of white space that are cut out of a text first, as the pattern's matcher has no room for much longer ones.
LONG_SPACE = 100_000

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, ids array<int>"


def byte_symbols() -> dict[str, int]:
    """Printable stand-in of each byte in byte-level vocabularies: printable Latin-1 is itself, the rest follow from U+0100."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@lru_cache(maxsize=2)
def encoder(path: str) -> Callable[[str], list[int]]:
    """Gives the ids of a text as tokenizers does with this byte-level BPE in JSON form and add_special_tokens=False.

    In that vocabulary ids are merge ranks, so tiktoken gives the same ids (a test holds them against each other) in a
    fourth of the time. Strings of added tokens in a text are those tokens.
    """
    import tiktoken

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    if any(t[x] for t in spec["added_tokens"] for x in ("single_word", "lstrip", "rstrip")):
        raise ValueError("added tokens that reach beyond their own characters")
    symbols = byte_symbols()
    added = {t["content"]: t["id"] for t in spec["added_tokens"]}
    ranks = {bytes(symbols[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in added}
    bpe = tiktoken.Encoding("byte_bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    cut = re.compile("|".join(map(re.escape, sorted(added, key=len, reverse=True))) or r"(?!)")
    run = re.compile(f"[{SPACES}]{{{LONG_SPACE},}}")

    def plain(text: str) -> list[int]:
        if len(text) < LONG_SPACE:
            return bpe.encode_ordinary(text)
        ids, at = [], 0
        for m in run.finditer(text):
            # The pattern takes such a run as a whole, but leaves its last character to what follows.
            end = m.end() - (m.end() < len(text))
            ids += bpe.encode_ordinary(text[at : m.start()])
            ids += bpe._encode_single_piece(text[m.start() : end])
            at = end
        return ids + bpe.encode_ordinary(text[at:])

    def encode(text: str) -> list[int]:
        ids, at = [], 0
        for m in cut.finditer(text):
            ids += plain(text[at : m.start()])
            ids.append(added[m.group()])
            at = m.end()
        return ids + plain(text[at:]) if at else plain(text)

    return encode


def binary_cuts(n: int, max_len: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` tokens: as many of ``max_len`` as fit, then the binary digits of the rest."""
    cuts = [(s, max_len) for s in range(0, n - n % max_len, max_len)]
    at, bit = n - n % max_len, max_len >> 1
    while bit:
        if n & bit:
            cuts.append((at, bit))
            at += bit
        bit >>= 1
    return cuts


def pack(docs: DataFrame, vocab: str, *, max_len: int = 1024, end_id: int = 0, with_ids: bool = True) -> DataFrame:
    """Pieces of ``docs`` (doc_id, text): doc_id, start, length, ids_crc32, doc_tokens, ids, bucket, sequence_id, offset.

    ``vocab`` is the path of a byte-level BPE vocabulary, present on every machine. ``bucket`` is the length, so
    ``write.partitionBy("bucket")`` gives the buckets as folders. sequence_id is unique, offset always 0.

    A null or empty text is the end id alone: one piece of one token. A text of any length and kind is encoded whole, by
    one task that holds its ids. A null doc_id stays null. Repeated rows are packed once each. No row gives no rows.
    Other columns are ignored.
    """
    if max_len < 1 or max_len & (max_len - 1):
        raise ValueError("max_len must be a power of two")
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocab)
        for b in batches:
            out: list[list] = [[], [], [], [], [], []]
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids = np.asarray([*encode(text or ""), end_id], dtype="<u4")
                raw = ids.tobytes()
                for start, length in binary_cuts(len(ids), max_len):
                    piece = raw[4 * start : 4 * (start + length)]
                    for c, v in zip(out, (doc, start, length, zlib.crc32(piece), len(ids), ids[start : start + length].astype("i4") if with_ids else None), strict=True):
                        c.append(v)
            types = [pa.int64()] * 5 + [pa.list_(pa.int32())]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids"])

    pieces = docs.select("doc_id", "text").mapInArrow(run, SCHEMA)
    return pieces.withColumns({"bucket": F.col("length"), "sequence_id": F.monotonically_increasing_id(), "offset": F.lit(0).cast("long")})
