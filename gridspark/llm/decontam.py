"""Benchmark decontamination: prefix-filtered join of word shingles, verified over item-sized windows.

A benchmark item is cut into windows of `window` words (a shorter item is one window). Each window is a set of shingles of
`shingle` words; since a window must be contained whole, its prefix is one shingle: the one that is rarest in the corpus,
counted over all documents. Documents are scanned on the workers for shingles that pass a bitmap of fixed size; the rest
is a Spark equi-join of shingle hashes to prefix shingles. The shingle's place in the window gives the only possible
start (positional bound), which must fit in the document (length bound), and the window's words are then compared.

Bounds: the bitmaps have `BITS` bits whatever the benchmark's size; the join itself is between distributed tables. Candidates carry the
words around them, so texts are not shuffled. Equal texts are joined once.

Defined cases: null texts have no words; an item without words has no windows; items with equal ids are one item and a null
item id is not counted or listed, though its words are hits; repeated documents each get a row; other columns are ignored;
empty tables work. Two passes over the documents: rarity, then candidates.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridspark.llm.common import fresh, join_spread, row_key, written
from gridspark.llm.textvec import ALNUM_WORDS, Texts, Words, slices

WINDOW = 10
SHINGLE = 3
BITS = 1 << 22


def _signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def _grams(words: Words, window: int, shingle: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Shingles of the usual length, and of the lengths that only windows shorter than it can have."""
    for k in range(1, shingle + 1):
        at, h = words.grams(k)
        yield k, at, h


def windows(benchmark: DataFrame, window: int = WINDOW, shingle: int = SHINGLE, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """item, words, hash, pos: one row per window and shingle in it, with the shingle's place."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "t"):
                words = Texts.of(part.column("t")).words(ALNUM_WORDS, lower=True)
                ids, out = part.column("item").to_pylist(), {"item": [], "words": [], "hash": [], "pos": []}
                by_length = {k: dict(zip(at.tolist(), _signed(h).tolist(), strict=True)) for k, at, h in _grams(words, window, shingle)}
                for row, (n, first) in enumerate(zip(words.per_row.tolist(), words.first.tolist(), strict=True)):
                    size = min(n, window)
                    k = min(size, shingle)
                    for start in range(first, first + n - size + 1) if n else ():
                        text = [words.text(i).decode() for i in range(start, start + size)]
                        for pos in range(size - k + 1):
                            for name, value in zip(out, (ids[row], text, by_length[k][start + pos], pos), strict=True):
                                out[name].append(value)
                yield pa.RecordBatch.from_pydict(out, schema=schema)

    schema = pa.schema([("item", pa.string()), ("words", pa.list_(pa.string())), ("hash", pa.int64()), ("pos", pa.int32())])
    part = benchmark.select(F.col(id_col).cast("string").alias("item"), F.col(text_col).cast("string").alias("t"))
    return part.mapInArrow(rows, "item string, words array<string>, hash long, pos int")


def _bitmap(hashes: DataFrame, bits: int) -> np.ndarray:
    """Slots that some hash falls into: at most `bits` small numbers reach the driver, in rows of 4096."""
    slot = F.pmod("hash", F.lit(bits)).cast("int")
    rows = hashes.select(slot.alias("slot")).distinct().groupBy(F.floor(F.col("slot") / 4096).alias("page")).agg(F.collect_list("slot").alias("slots"))
    out = np.zeros(bits, bool)
    for r in rows.select("slots").toLocalIterator():
        out[r.slots] = True
    return np.packbits(out)


def _passes(packed: np.ndarray, h: np.ndarray, bits: int) -> np.ndarray:
    slot = (h & np.uint64(bits - 1)).astype(np.int64)   # bits is a power of two, so this is pmod of the signed value too
    return (packed[slot >> 3] >> (7 - (slot & 7)).astype(np.uint8)) & 1 == 1


def rarity(docs: DataFrame, shingles: DataFrame, lengths: list[int], window: int, shingle: int, text_col: str, bits: int) -> DataFrame:
    """hash, seen: how often each benchmark shingle stands in the corpus. Tasks send only what passes the bitmap, counted."""
    packed = _bitmap(shingles, bits)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "t"):
                words = Texts.of(part.column("t")).words(ALNUM_WORDS, lower=True)
                for k, _, h in _grams(words, window, shingle):
                    if k in lengths:
                        found, n = np.unique(h[_passes(packed, h, bits)], return_counts=True)
                        yield pa.RecordBatch.from_pydict({"hash": _signed(found), "n": n})

    return docs.select(F.col(text_col).cast("string").alias("t")).mapInArrow(rows, "hash long, n long").groupBy("hash").agg(F.sum("n").alias("seen"))


def prefixes(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shingle: int = SHINGLE, bits: int = BITS, text_col: str = "text",
             item_col: str = "item_id", item_text_col: str = "text") -> tuple[DataFrame, list[int]]:
    """Each distinct window with its rarest shingle (hash, pos) and the items it is part of; and the shingle lengths in use."""
    spread = written(windows(benchmark, window, shingle, item_col, item_text_col), "windows")
    sizes = [r.n for r in spread.select(F.least(F.size("words"), F.lit(shingle)).alias("n")).distinct().collect()]
    seen = rarity(docs, spread, sizes, window, shingle, text_col, bits)
    ranked = spread.join(seen, "hash", "left").groupBy("words").agg(
        F.min(F.struct(F.coalesce("seen", F.lit(0)).alias("seen"), "pos", "hash")).alias("best"), F.collect_set("item").alias("items"))
    return written(ranked.select("words", "items", "best.pos", "best.hash"), "prefixes"), sizes


def candidates(docs: DataFrame, prefix: DataFrame, lengths: list[int], window: int, shingle: int, id_col: str, text_col: str, bits: int) -> DataFrame:
    """i, key, n_words, found: places of shingles that pass the bitmap, with the words around them."""
    packed = _bitmap(prefix, bits)
    kind = docs.schema[id_col].dataType.simpleString()
    found_type = pa.list_(pa.struct([("hash", pa.int64()), ("at", pa.int64()), ("low", pa.int64()), ("around", pa.list_(pa.string()))]))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "t"):
                words = Texts.of(part.column("t")).words(ALNUM_WORDS, lower=True)
                found: list[list[dict]] = [[] for _ in range(part.num_rows)]
                for k, at, h in _grams(words, window, shingle):
                    if k not in lengths:
                        continue
                    hit = _passes(packed, h, bits)
                    for i, value in zip(at[hit].tolist(), _signed(h[hit]).tolist(), strict=True):
                        row = int(words.row[i])
                        first = int(words.first[row])
                        low, high = max(first, i - window), min(first + int(words.per_row[row]), i + window)
                        found[row].append({"hash": value, "at": i - first, "low": low - first,
                                           "around": [words.text(j).decode() for j in range(low, high)]})
                yield pa.RecordBatch.from_arrays([part.column("i"), part.column("key"), pa.array(words.per_row), pa.array(found, found_type)],
                                                 ["i", "key", "n_words", "found"])

    part = docs.select(F.col(id_col).alias("i"), row_key(text_col).alias("key"), F.col(text_col).cast("string").alias("t"))
    return part.mapInArrow(rows, f"i {kind}, key string, n_words long, found array<struct<hash:bigint,at:bigint,low:bigint,around:array<string>>>")


def _sorted_hex(items: Column) -> Column:
    return F.sha2(F.array_join(F.array_sort(items), ",").cast("binary"), 256)


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shingle: int = SHINGLE, bits: int = BITS, id_col: str = "doc_id",
                  text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """id, key (of the text), n_words, n_hit, n_items, items_sha256, contaminated of every row."""
    prefix, lengths = prefixes(docs, benchmark, window, shingle, bits, text_col, item_col, item_text_col)
    scanned = written(candidates(docs, prefix, lengths, window, shingle, id_col, text_col, bits), "scanned")
    seen = scanned.filter(F.size("found") > 0).groupBy("key").agg(F.first("n_words").alias("n_words"), F.first("found").alias("found"))
    at = seen.select("key", "n_words", F.explode("found").alias("f")).select("key", "n_words", "f.*")
    start = F.col("at") - F.col("pos")
    n = F.size("words")
    hits = at.join(prefix, "hash").filter((start >= F.col("low")) & (start + n <= F.col("n_words"))) \
        .filter(F.slice("around", (start - F.col("low") + 1).cast("int"), n) == F.col("words")) \
        .select("key", start.alias("start"), (start + n).alias("end"), "items")
    order = Window.partitionBy("key").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    spans = hits.select("key", "start", "end").distinct().withColumn("done", F.coalesce(F.max("end").over(order), F.lit(0)))
    covered = spans.groupBy("key").agg(F.sum(F.greatest(F.col("end") - F.greatest("start", "done"), F.lit(0))).alias("n_hit"))
    named = hits.select("key", F.explode("items").alias("item")).groupBy("key").agg(F.collect_set("item").alias("items"))
    none = F.array().cast("array<string>")
    out = join_spread(scanned.select("i", "key", "n_words"), covered.join(named, "key", "left"), "key")
    return out.select(F.col("i").alias(id_col), "key", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
                      F.size(F.coalesce("items", none)).cast("long").alias("n_items"), _sorted_hex(F.coalesce("items", none)).alias("items_sha256"),
                      (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"))


def keep_clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """The documents without a benchmark window, with all their columns."""
    key = fresh(docs, "key")["key"]
    hit = contamination(docs, benchmark, text_col=text_col, **options).filter("contaminated").select(F.col("key").alias(key)).distinct()
    return join_spread(docs.withColumn(key, row_key(text_col)), hit, key, "left_anti").select(*docs.columns)
