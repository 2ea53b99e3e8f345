"""Quality rules: a hashed n-gram log-likelihood ratio between trusted documents and the raw corpus.

Every word and every pair of neighbouring words of a text falls into one of `buckets` hash buckets. Two multinomials over
the buckets are counted in one pass over the whole corpus: one of all documents, one of trusted documents (additive
smoothing). A text's score is the mean log ratio of its n-grams, so texts of any length compare; a text is kept if it
passes the base rules and its score is at least `threshold`.

Bounds: the trusted documents are at most `max_trusted` labelled ids (those first by a hash of the id), the only thing
sampled; the counts cover every document. Tasks send at most `buckets` rows each, and only the vector of `buckets` log
ratios is held by the driver and sent to the tasks. Texts are never shuffled.

Defined cases: a null text has no words and fails the base rules; repeated rows each count and are each judged; without any
trusted document the ratio is 0 everywhere, so only the base rules decide; a score equal to the threshold is kept; an
empty table gives an empty result. Only the id and text columns are read, whatever else the table has; `keep_good` returns
all columns as they came.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridspark.llm.textvec import SPACE_WORDS, Texts, Words, byte_class, slices

_SYMBOLS = byte_class(*((b, b) for b in b"#*$%&|<>"))
COLUMNS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


@dataclass(frozen=True)
class Rules:
    buckets: int = 1 << 14
    smoothing: float = 16.0
    threshold: float = -0.1
    max_trusted: int = 100_000
    min_words: int = 20
    max_repeat_percent: int = 30
    window: int = 8


def _buckets(words: Words, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and bucket of every unigram and bigram."""
    at, pairs = words.grams(2)
    rows = np.concatenate([words.row, words.row[at]])
    return rows, (np.concatenate([words.hash, pairs]) % np.uint64(buckets)).astype(np.int64)


def trusted_ids(labels: DataFrame, rules: Rules, id_col: str = "doc_id") -> list[int]:
    """At most `max_trusted` ids labelled good, the first ones by a hash of the id."""
    good = labels.filter("quality = 1").select(F.col(id_col).cast("long").alias("i")).filter("i is not null").distinct()
    return [r.i for r in good.orderBy(F.xxhash64("i"), "i").limit(rules.max_trusted).collect()]


def log_ratios(docs: DataFrame, labels: DataFrame, rules: Rules = Rules(), id_col: str = "doc_id", text_col: str = "text") -> np.ndarray:
    """log(p_trusted / p_raw) of each bucket, counted over all documents in one pass."""
    trusted = np.sort(np.array(trusted_ids(labels, rules, id_col), np.int64))

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, good = np.zeros(rules.buckets, np.int64), np.zeros(rules.buckets, np.int64)
        for batch in batches:
            for part in slices(batch, "t"):
                rows, bucket = _buckets(Texts.of(part.column("t")).words(SPACE_WORDS), rules.buckets)
                raw += np.bincount(bucket, minlength=rules.buckets)
                ids = part.column("i")
                mine = np.isin(ids.fill_null(0).to_numpy(), trusted) & ids.is_valid().to_numpy(zero_copy_only=False)
                good += np.bincount(bucket[mine[rows]], minlength=rules.buckets)
        at = np.flatnonzero(raw)
        yield pa.RecordBatch.from_pydict({"bucket": at, "raw": raw[at], "good": good[at]})

    part = docs.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).cast("string").alias("t"))
    totals = part.mapInArrow(counts, "bucket long, raw long, good long").groupBy("bucket").agg(F.sum("raw"), F.sum("good"))
    raw, good = np.zeros(rules.buckets), np.zeros(rules.buckets)
    for bucket, r, g in totals.collect():
        raw[bucket], good[bucket] = r, g
    if not good.any():
        return np.zeros(rules.buckets)
    return ratio(raw, good, rules.smoothing)


def ratio(raw: np.ndarray, good: np.ndarray, smoothing: float) -> np.ndarray:
    """log(p / q); the pseudo-counts have the same weight in both, so a bucket seen rarely in either is worth about 0."""
    scale = raw.sum() / good.sum()
    p = (good + smoothing) / (good.sum() + smoothing * len(good))
    q = (raw + smoothing * scale) / (raw.sum() + smoothing * scale * len(raw))
    return np.log(p / q)


def _repeated(words: Words, k: int) -> np.ndarray:
    """Per row: words inside windows of k words that occur twice or more in the row."""
    at, grams = words.grams(k)
    order = np.lexsort((grams, words.row[at]))
    same = (np.diff(grams[order]) == 0) & (np.diff(words.row[at][order]) == 0)
    hit = np.zeros(len(at), bool)
    hit[order[1:][same]] = True
    hit[order[:-1][same]] = True
    edge = np.zeros(len(words.start) + 1, np.int64)
    np.add.at(edge, at[hit], 1)
    np.add.at(edge, at[hit] + k, -1)
    return np.bincount(words.row[np.cumsum(edge[:-1]) > 0], minlength=len(words.texts))


def _repeated_lines(texts: Texts, words: Words) -> np.ndarray:
    """Per row: lines with a word that equal an earlier line of the row."""
    breaks = np.flatnonzero(texts.data == 10)
    start = np.sort(np.concatenate([texts.offsets[:-1], breaks + 1]))
    row = np.concatenate([np.arange(len(texts)), texts.owner(breaks)])
    row.sort()
    last = np.append(row[1:] != row[:-1], True) if len(row) else np.zeros(0, bool)
    end = np.where(last, texts.offsets[1:][row], np.append(start[1:] - 1, 0))
    full = np.searchsorted(words.start, end) > np.searchsorted(words.start, start)
    row, start, end = row[full], start[full], end[full]
    h = texts.hashes(start, end)
    order = np.lexsort((h, row))
    again = (np.diff(h[order]) == 0) & (np.diff(row[order]) == 0)
    return np.bincount(row[order[1:][again]], minlength=len(texts))


def judge(texts: Texts, ratios: np.ndarray, rules: Rules) -> dict[str, np.ndarray]:
    words = texts.words(SPACE_WORDS)
    n = words.per_row
    repeats = _repeated(words, rules.window)
    failed = (n < rules.min_words) | (100 * repeats > rules.max_repeat_percent * n)
    rows, bucket = _buckets(words, rules.buckets)
    grams = np.bincount(rows, minlength=len(texts))
    score = np.bincount(rows, weights=ratios[bucket], minlength=len(texts)) / np.maximum(grams, 1)
    heads = SPACE_WORDS[texts.data] & ((texts.data & 0xC0) != 0x80)
    return {"n_words": n, "word_chars": texts.count(heads), "n_symbols": texts.count(_SYMBOLS[texts.data]),
            "n_dup_lines": _repeated_lines(texts, words), "n_repeat_words": repeats, "base_failed": failed, "score": score,
            "kept": ~failed & (score >= rules.threshold)}


def assess(docs: DataFrame, labels: DataFrame, rules: Rules = Rules(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: base counts, score and verdict."""
    ratios = log_ratios(docs, labels, rules, id_col, text_col)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "t"):
                out = judge(Texts.of(part.column("t")), ratios, rules)
                yield pa.RecordBatch.from_pydict({"i": part.column("i"), **out})

    part = docs.select(F.col(id_col).alias("i"), F.col(text_col).cast("string").alias("t"))
    kind = docs.schema[id_col].dataType.simpleString()
    longs = ", ".join(f"{c} long" for c in COLUMNS)
    out = part.mapInArrow(rows, f"i {kind}, {longs}, base_failed boolean, score double, kept boolean")
    return out.withColumnRenamed("i", id_col)


def keep_good(docs: DataFrame, labels: DataFrame, rules: Rules = Rules(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that pass, with all their columns."""
    ratios = log_ratios(docs, labels, rules, id_col, text_col)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text_col):
                yield part.filter(pa.array(judge(Texts.of(part.column(text_col)), ratios, rules)["kept"]))

    return docs.mapInArrow(rows, docs.schema)
