"""Language identification with spans.

The script of a word narrows the languages it can belong to; a naive Bayes model over hashed letter n-grams scores the
word under each of them; a Viterbi pass with a penalty for every change of language labels the spans of a text. The
model is fitted on labelled rows and knows exactly the labels that it has seen.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StringType, StructField, StructType

from helixframe.llm._common import bounded_batches

#: First code point of each block of letters and its script (fixed values); blocks not named carry no script.
SCRIPT_RANGES = (
    (0x0041, "latin"), (0x0250, ""), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"),
    (0x0600, "arabic"), (0x0700, ""), (0x0900, "devanagari"), (0x0980, "bengali"), (0x0A00, ""), (0x0B80, "tamil"),
    (0x0C00, ""), (0x0E00, "thai"), (0x0E80, ""), (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, ""),
    (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, ""), (0x3040, "kana"), (0x3100, ""), (0x3400, "han"),
    (0xA000, ""), (0xAC00, "hangul"), (0xD7B0, ""),
)
_STARTS = [a for a, _ in SCRIPT_RANGES]

WORD = re.compile(r"[^\W\d_]+")
#: Letter n-grams are hashed into this many counters for each language.
BUCKETS = 1 << 16
#: Labelled rows of each language that the model is fitted on, at most about so many (chosen by a hash of the row's id).
TRAIN_ROWS = 3000
#: Natural logarithms: cost of a change of language, and the most one word can speak against a language.
SWITCH, WORST = 14.0, 10.0
MEMO_WORDS = 400_000
#: What a model may weigh that is sent to all workers: half a MB to a language, so some 500 languages.
MODEL_BYTES = 256 << 20
UNDETERMINED = "und"
SPAN = StructType([StructField("start", IntegerType()), StructField("length", IntegerType()), StructField("lang", StringType())])
FOUND = [StructField("lang_pred", StringType()), StructField("score", DoubleType()), StructField("n_words", LongType()), StructField("spans", ArrayType(SPAN))]


def script_of(word: str) -> str:
    i = bisect_right(_STARTS, ord(word[0])) - 1
    return SCRIPT_RANGES[i][1] if i >= 0 else ""


def _buckets(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return ((h ^ (h >> np.uint64(29))) % np.uint64(BUCKETS)).astype(np.int64)


def grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, word) of the bigrams, trigrams and whole of lower-case words between their borders, word by word.

    All words are one array of code points, so the hashes take a few operations for all of them.
    """
    c = np.frombuffer("".join([f"^{w}$" for w in words]).encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
    size = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 2
    word = np.repeat(np.arange(len(words)), size)
    left = np.repeat(size.cumsum(), size) - np.arange(len(c))  # code points from here to the end of the word
    two = c[:-1] * np.uint64(0x1F123BB5) + c[1:] * np.uint64(0x5851F42D4C957F2D)
    three = two[:-1] + c[2:] * np.uint64(0xD1342543DE82EF95)
    whole = np.add.reduceat(c * (left.astype(np.uint64) * np.uint64(0xBF58476D1CE4E5B9) | np.uint64(1)), np.concatenate(([0], size.cumsum()[:-1])))
    at2, at3 = np.flatnonzero(left[:-1] >= 2), np.flatnonzero(left[:-2] >= 3)
    bucket = np.concatenate((_buckets(two[at2] + np.uint64(1)), _buckets(three[at3] + np.uint64(2)), _buckets(whole + np.uint64(3))))
    owner = np.concatenate((word[at2], word[at3], np.arange(len(words))))
    order = np.argsort(owner, kind="stable")
    return bucket[order], owner[order]


@dataclass
class Model:
    langs: list[str]
    weights: np.ndarray  # BUCKETS x languages: log-probabilities
    scripts: dict[str, np.ndarray]  # script: which languages use it

    def words(self, words: list[str]) -> np.ndarray:
        """Log-scores of words (rows) for each language, 0 for the best of a word."""
        bucket, owner = grams(words)
        s = np.add.reduceat(self.weights[bucket], np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1]))), axis=0)
        every = np.ones(len(self.langs), dtype=bool)
        own = [self.scripts.get(script_of(w)) for w in words]
        s = np.where(np.array([every if m is None else m for m in own]), s, -np.inf)
        # A word of a script that no language uses speaks for none.
        s[[m is None for m in own]] = 0
        return np.maximum(s - s.max(axis=1, keepdims=True), -WORST)


def fit(docs: DataFrame, *, per_lang: int = TRAIN_ROWS) -> Model:
    """Fit on ``docs`` (doc_id, text, lang); rows with a null text or lang don't count.

    Of a language with more than ``per_lang`` rows, about that many are taken by a hash of their ids; each is used whole.
    The model's size depends on the number of languages only; more than MODEL_BYTES of it are an error. Without a
    labelled row the model knows no language. Texts of any length are counted whole; repeated rows and null ids count as
    any; other columns are ignored.
    """
    bounded_batches(docs.sparkSession)
    rows = docs.select("doc_id", "text", "lang").where("text is not null and lang is not null")
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    langs = sorted(sizes)
    if not langs:
        return Model([], np.zeros((BUCKETS, 0)), {})
    if len(langs) * BUCKETS * 8 > MODEL_BYTES:
        raise ValueError(f"{len(langs)} labels are more than a model of {MODEL_BYTES} bytes holds")
    share = F.create_map(*[x for k in langs for x in (F.lit(k), F.lit(min(1.0, per_lang / sizes[k])))])
    taken = rows.where(F.pmod(F.xxhash64("doc_id", F.lit("fit")), F.lit(1_000_000)) < share[F.col("lang")] * 1_000_000)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: dict[str, Counter] = {}
        for b in batches:
            for text, lang in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                words.setdefault(lang, Counter()).update(WORD.findall(text.lower()))
            if sum(map(len, words.values())) > MEMO_WORDS:
                yield counted(words)
                words = {}
        yield counted(words)

    def counted(words: dict[str, Counter]) -> pa.RecordBatch:
        out: list[list] = [[], [], [], []]
        for lang, all_words in words.items():
            n, scripts = np.zeros(BUCKETS, dtype=np.int64), Counter()
            if all_words:
                bucket, owner = grams(list(all_words))
                np.add.at(n, bucket, np.fromiter(all_words.values(), dtype=np.int64, count=len(all_words))[owner])
            for w, k in all_words.items():
                scripts[script_of(w)] += k
            for c, v in zip(out, ([lang] * int((n > 0).sum()), [""] * int((n > 0).sum()), np.flatnonzero(n).tolist(), n[n > 0].tolist()), strict=True):
                c.extend(v)
            for s, k in scripts.items():
                for c, v in zip(out, (lang, s, -1, k), strict=True):
                    c.append(v)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.string(), pa.string(), pa.int64(), pa.int64()), strict=True)], names=["lang", "script", "bucket", "n"])

    sums = taken.mapInArrow(run, "lang string, script string, bucket long, n long").groupBy("lang", "script", "bucket").agg(F.sum("n").alias("n")).toArrow()
    at = {k: i for i, k in enumerate(langs)}
    counts, used = np.zeros((BUCKETS, len(langs))), {}
    for lang, script, bucket, n in zip(*(c.to_pylist() for c in sums.columns), strict=True):
        if bucket >= 0:
            counts[bucket, at[lang]] = n
        elif script:
            used.setdefault(script, np.zeros(len(langs)))[at[lang]] = n
    letters = sum(used.values(), np.zeros(len(langs)))
    weights = np.log((counts + 0.3) / (counts.sum(axis=0) + 0.3 * BUCKETS))
    may = {s: n >= np.maximum(1, 0.01 * letters) for s, n in used.items()}
    return Model(langs, weights, {s: m for s, m in may.items() if m.any()})


def spans(scores: np.ndarray, switch: float = SWITCH) -> list[tuple[int, int, int]]:
    """(start, length, language) of the best path through ``scores`` (words x languages), a change costing ``switch``.

    One language throughout is the best path whenever no stretch of words gains as much as a change costs by leaving it
    for the best other language of each word; only other texts need the full pass.
    """
    n, k = scores.shape
    best = int(scores.sum(axis=0).argmax())
    if k == 1:
        return [(0, n, 0)]
    gain = np.concatenate(([0.0], (scores.max(axis=1) - scores[:, best]).cumsum()))
    away = np.concatenate(([0.0], (np.delete(scores, best, axis=1).max(axis=1) - scores[:, best]).cumsum()))
    if gain[-1] <= switch or (away - np.minimum.accumulate(away)).max() <= switch:
        return [(0, n, best)]
    value, back = scores[0].tolist(), []
    for row in scores[1:].tolist():
        top = max(value)
        j = value.index(top)
        top -= switch
        came, now = [], []
        for i, (v, s) in enumerate(zip(value, row, strict=True)):
            if v >= top:
                came.append(i)
                now.append(v + s)
            else:
                came.append(j)
                now.append(top + s)
        back.append(came)
        value = now
    path = [value.index(max(value))]
    for came in reversed(back):
        path.append(came[path[-1]])
    path.reverse()
    out, start = [], 0
    for i in range(1, n + 1):
        if i == n or path[i] != path[start]:
            out.append((start, i - start, path[start]))
            start = i
    return out


def identify(docs: DataFrame, model: Model, *, columns: tuple[str, ...] = ("doc_id",), switch: float = SWITCH) -> DataFrame:
    """``columns``, lang_pred, score, n_words and spans (over the words of letters) of each row of ``docs`` (columns, text).

    lang_pred is the language with most letters among the spans, ties to the first in alphabetical order; score is its
    share of the letters times its probability on its own words. A null text, one without a letter, or a model without
    languages gives ``und``, score 0 and no spans. Nulls in ``columns`` stay; repeated rows are labelled once each; no
    row gives no rows. Other columns are ignored, but ``columns`` can't have the names of the results.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    sent = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        names, k = m.langs, len(m.langs)
        rows: dict[str, int] = {}
        table = np.zeros((0, k))
        for b in batches:
            out: list[list] = [[], [], [], []]
            texts = [WORD.findall(t.lower()) if t and k and any(map(str.isalpha, t)) else [] for t in b.column(len(columns)).to_pylist()]
            if len(rows) > MEMO_WORDS:
                rows, table = {}, table[:0]
            if new := list(set().union(*texts) - rows.keys()):
                rows |= zip(new, range(len(rows), len(rows) + len(new)), strict=True)
                while len(table) < len(rows):
                    table = np.concatenate((table, np.zeros((max(1024, len(table), len(rows) - len(table)), k))))
                table[len(rows) - len(new) : len(rows)] = m.words(new)
            for words in texts:
                row = (UNDETERMINED, 0.0, len(words), [])
                if words:
                    s = table[np.fromiter(map(rows.__getitem__, words), dtype=np.int64, count=len(words))]
                    found = spans(s, switch)
                    if len(found) == 1:
                        top, share, own = found[0][2], 1.0, s.sum(axis=0)
                    else:
                        size = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
                        letters, own_words = np.zeros(k), np.zeros(len(words), dtype=bool)
                        for a, n, lang in found:
                            letters[lang] += size[a : a + n].sum()
                        top = int(letters.argmax())
                        for a, n, lang in found:
                            own_words[a : a + n] = lang == top
                        share, own = letters[top] / letters.sum(), s[own_words].sum(axis=0)
                    p = np.exp(own - own.max())
                    row = (names[top], float(share * p[top] / p.sum()), len(words), [{"start": a, "length": n, "lang": names[lang]} for a, n, lang in found])
                for c, v in zip(out, row, strict=True):
                    c.append(v)
            span = pa.list_(pa.struct([("start", pa.int32()), ("length", pa.int32()), ("lang", pa.string())]))
            found = [pa.array(c, t) for c, t in zip(out, (pa.string(), pa.float64(), pa.int64(), span), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(columns)], *found], names=[*columns, "lang_pred", "score", "n_words", "spans"])

    kept = docs.select(*columns)
    return docs.select(*columns, F.col("text").alias("__text")).mapInArrow(run, StructType(kept.schema.fields + FOUND))


def held_out(doc_id: Column) -> Column:
    """Whether a row is kept from fitting: crc32 of its id as text leaves 1 when divided by 3 (null: no)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))
