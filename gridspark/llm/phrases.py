"""Phrase collocations by SON partitioning: shards mined whole at lowered support, their union counted exactly over everything.

1. Words per language are counted (`n`).
2. Level by level (1 word, 2 words, ...), every shard, a run of texts of about `SHARD_BYTES` in one task, is mined completely:
   all its phrases of that length whose two parts (without the last and without the first word) are candidates one level
   down, with support lowered in proportion, ceil(support * words of the shard / n) for the language. A phrase with the full
   support reaches that share in some shard, so the union over shards misses none. Where a shard's share falls to one
   occurrence, every shard reports all it has and the reports add up to the count, so the union keeps only sums of at least
   the support; with a lowered support above one a single report is enough.
   Reports are 64-bit hashes, packed per shard and hash bucket and merged by sorting in the one task that owns the bucket.
3. Candidates reach the next scan as a bitmap of bounded size. A wrong bit costs only time: the last scan counts the phrases
   themselves, by their words, in every shard, and a grouping adds them up exactly; those under the support go.
4. Parts of phrases are looked up in that table, scores are whole-number divisions in 38 digits, phrases inside a longer one
   that takes at least the given share of their occurrences go, and each language keeps its best.

With an absolute support every shard's share is one occurrence as soon as there are more shards than the support, so at
scale pruning comes from the levels and the sums, not from the lowered support; a support that grows with n prunes in the shards.

Defined cases: a null language is `und`; null and empty texts have no words; ties are ranked by phrase, so ranks are unique;
repeated rows count as often as they stand there; other columns are ignored; empty tables give no rows.
"""

from __future__ import annotations

import dataclasses
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridspark.llm import textvec
from gridspark.llm.common import labelled, written
from gridspark.llm.textvec import Texts, Words, byte_class, mix

MIN_WORDS, MAX_WORDS, SUPPORT, INSIDE_PERCENT, TOP = 2, 3, 10, 50, 2000
UNKNOWN = "und"
SHARD_BYTES = 16 << 20
SLICE_BYTES = 512 << 10         # of text at a time: hashing holds some 60 bytes a byte of it
HELD_BYTES = 32 << 20           # of phrases that a worker holds before it counts them
BUCKET_WORDS = 1 << 21          # words of the input that one bucket of reports stands for
MIN_BITS, MAX_BITS = 16, 27     # of the candidates' bitmap, as powers of two
MAX_LANGS = 10_000              # beyond it shards are mined at support one, which is always complete
PARTS = 64
_PIECE = byte_class((0x0A, 0x0D), (0x21, 0x21), (0x2C, 0x2C), (0x2E, 0x2E), (0x3A, 0x3B), (0x3F, 0x3F))
_WORD = ~(_PIECE | byte_class((0x09, 0x09), (0x20, 0x20)))


def _lang(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(UNKNOWN))


def slices(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    return textvec.slices(batch, column, SLICE_BYTES)


def _words(part: pa.RecordBatch) -> tuple[np.ndarray, Words]:
    """The text of each word, and the words; their `row` numbers pieces, so no run of words crosses a break between pieces."""
    texts = Texts.of(part.column("t"))
    words = texts.words(_WORD, lower=True)
    breaks = np.cumsum(_PIECE[texts.data], dtype=np.int64)
    return words.row, dataclasses.replace(words, row=(breaks[words.start] if len(words.start) else words.row) + words.row)


def _text_rows(part: pa.RecordBatch) -> np.ndarray:
    texts = Texts.of(part.column("t"))
    return texts.owner(texts.words(_WORD).start)


def _salted(langs: list[str]) -> np.ndarray:
    """A hash per language that tells equal phrases of two languages apart."""
    found = Texts.of(pa.array(langs, pa.string()))
    return found.hashes(found.offsets[:-1], found.offsets[1:])


class Bitmap:
    """A set of hashes as one bit each; it may say yes wrongly, never no."""

    def __init__(self, bits: int, words: np.ndarray):
        self.bits, self.words = bits, words

    def holds(self, h: np.ndarray) -> np.ndarray:
        at = mix(h) >> np.uint64(64 - self.bits)
        return (self.words[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) == 1

    @classmethod
    def of(cls, hashes: DataFrame) -> Bitmap:
        """From a column h. What reaches the driver is the map, at most 2^MAX_BITS bits, not the hashes."""
        bits = min(max(math.ceil(math.log2(32 * max(hashes.count(), 1))), MIN_BITS), MAX_BITS)

        def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                at = mix(b.column("h").to_numpy().view(np.uint64)) >> np.uint64(64 - bits)
                yield pa.RecordBatch.from_pydict({"w": (at >> np.uint64(6)).view(np.int64),
                                                  "v": (np.uint64(1) << (at & np.uint64(63))).view(np.int64)})

        table = hashes.mapInArrow(rows, "w long, v long").groupBy("w").agg(F.bit_or("v").alias("v")).toArrow()
        words = np.zeros(1 << (bits - 6), np.uint64)
        words[table.column("w").to_numpy()] = table.column("v").to_numpy().view(np.uint64)
        return cls(bits, words)


class Shard:
    """Hashes of one level's phrases, with their language, gathered until the shard is full."""

    def __init__(self):
        self.bytes, self.hash, self.lang, self.words = 0, [], [], {}

    def reports(self, totals: dict[str, int] | None, support: int, buckets: int) -> Iterator[dict]:
        """Distinct hashes with their counts, cut into buckets, which are ranges of hashes; only a bucket at a time is copied."""
        h = np.concatenate(self.hash)
        self.hash, lang = [], self.lang
        self.lang = []
        names = list(self.words)
        share = np.array([1 if totals is None else max(-(-support * self.words[x] // max(totals[x], 1)), 1) for x in names], np.int64)
        edges = np.array([(i << 64) // buckets for i in range(1, buckets)], np.uint64)
        if share.max() == 1:        # every hash is reported: no language is looked up, and the hashes are sorted in place
            code = order = None
            lang.clear()
            h.sort()
        else:
            code = np.concatenate(lang)
            lang.clear()
            order = np.argsort(h)
        cuts = [0, *np.searchsorted(h, edges, sorter=order).tolist(), len(h)]
        for bucket, (lo, hi) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
            part = h[lo:hi] if order is None else h[order[lo:hi]]
            first = np.flatnonzero(np.append(part[:1] == part[:1], part[1:] != part[:-1]))
            count = np.diff(first, append=len(part))
            part = part[first]
            if order is not None:
                least = share[code[order[lo:hi][first]]]
                count[(count >= least) & (least > 1)] = support
                keep = count >= least
                part, count = part[keep], count[keep]
            if not len(part):
                continue
            many = count > 1
            yield {"bucket": bucket, "ones": part[~many].tobytes(), "many": part[many].tobytes(),
                   "counts": np.minimum(count[many], support).astype("<u4").tobytes()}


_REPORT = pa.schema([("bucket", pa.int32()), ("ones", pa.binary()), ("many", pa.binary()), ("counts", pa.binary())])


def mine(texts: DataFrame, k: int, below: Bitmap | None, totals: dict[str, int] | None, support: int, buckets: int) -> DataFrame:
    """Hashes h of the union of phrases of k words that are frequent in some shard."""
    known = texts.sparkSession.sparkContext.broadcast(None if below is None else (below.bits, below.words))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lower = None if known.value is None else Bitmap(*known.value)
        shard, codes = Shard(), {}

        def close() -> Iterator[pa.RecordBatch]:
            for report in shard.reports(totals, support, buckets) if shard.hash else ():
                yield pa.RecordBatch.from_pylist([report], _REPORT)

        for batch in batches:
            for part in slices(batch, "t"):
                langs = part.column("lang").to_pylist()
                for x in langs:
                    codes.setdefault(x, len(codes))
                    shard.words.setdefault(x, 0)
                row, words = _words(part)
                code = np.array([codes[x] for x in langs], np.int32)[row]
                salt = _salted(langs)[row]
                for x, n in zip(langs, np.bincount(row, minlength=len(langs)).tolist(), strict=True):
                    shard.words[x] += n
                at, h = words.grams(k)
                h = mix(h ^ salt[at])
                if lower is not None:
                    left, a = words.grams(k - 1)
                    ok = np.zeros(len(row) + 1, bool)
                    ok[left] = lower.holds(mix(a ^ salt[left]))
                    good = ok[at] & ok[at + 1]
                    at, h = at[good], h[good]
                shard.hash.append(h)
                shard.lang.append(code[at])
                shard.bytes += part.column("t").nbytes
                if shard.bytes >= SHARD_BYTES:
                    yield from close()
                    shard, codes = Shard(), {}
        yield from close()

    def union(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ones, many, counts = [], [], []
        for batch in batches:
            for o, m, c in zip(batch.column("ones"), batch.column("many"), batch.column("counts"), strict=True):
                ones.append(o.as_buffer())      # views, not copies
                many.append(m.as_buffer())
                counts.append(c.as_buffer())
        if ones:
            once = sum(x.size for x in ones) // 8
            h = np.frombuffer(b"".join(ones + many), "<u8")
            c = np.append(np.ones(once, "<u4"), np.frombuffer(b"".join(counts), "<u4"))
            del batch, o, m, ones, many, counts
            order = np.argsort(h)
            h, c = h[order], c[order]
            del order
            first = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
            yield pa.RecordBatch.from_pydict({"h": h[first][np.add.reduceat(c, first, dtype=np.int64) >= support].view(np.int64)})
        pa.default_memory_pool().release_unused()   # a worker that waits for its next task should not hold this one's memory

    reports = texts.mapInArrow(scan, "bucket int, ones binary, many binary, counts binary")
    # a task holds one bucket, and holds it in the worker alone: nothing is sorted before
    return reports.repartitionById(buckets, "bucket").mapInArrow(union, "h long")


def count_exactly(texts: DataFrame, levels: list[Bitmap], support: int) -> DataFrame:
    """lang, phrase, k, f of every phrase with at least the support, counted by its words over all texts."""
    known = texts.sparkSession.sparkContext.broadcast([(b.bits, b.words) for b in levels])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maps = [Bitmap(*x) for x in known.value]
        held: list[pa.Table] = []       # every occurrence: its phrase, and its language and length as one number
        codes: dict[str, int] = {}

        def close() -> Iterator[pa.RecordBatch]:
            if not held:
                return
            found = pa.concat_tables(held)
            held.clear()
            found = found.group_by(["kind", "phrase"], use_threads=False).aggregate([([], "count_all")])
            pa.default_memory_pool().release_unused()
            names = pa.array(list(codes), pa.string())
            for b in found.to_batches(max_chunksize=20_000):
                code, k = np.divmod(b.column("kind").to_numpy(), np.int32(len(maps)))
                yield pa.RecordBatch.from_pydict({"lang": names.take(pa.array(code)), "k": k + np.int32(1),
                                                  "phrase": b.column("phrase").cast(pa.string()), "f": b.column("count_all")})

        for batch in batches:
            for part in slices(batch, "t"):
                langs = part.column("lang").to_pylist()
                row, words = _words(part)
                code = np.array([codes.setdefault(x, len(codes)) for x in langs], np.int32)[row]
                salt = _salted(langs)[row]
                joined, start, end = words.joined()
                joined = np.frombuffer(joined, np.uint8)
                for k, bits in enumerate(maps, 1):
                    at, h = words.grams(k)
                    at = at[bits.holds(mix(h ^ salt[at]))]
                    if not len(at):
                        continue
                    a, size = start[at], end[at + k - 1] - start[at]
                    offsets = np.concatenate([[0], np.cumsum(size)])
                    short = max(offsets[-1], len(joined)) < 1 << 31
                    whole, strings = (np.int32, pa.StringArray) if short else (np.int64, pa.LargeStringArray)
                    place = np.repeat((a - offsets[:-1]).astype(whole), size)
                    place += np.arange(offsets[-1], dtype=whole)
                    phrase = strings.from_buffers(len(at), pa.py_buffer(offsets.astype(whole)), pa.py_buffer(joined[place]))
                    table = pa.table({"kind": code[at] * np.int32(len(maps)) + np.int32(k - 1), "phrase": phrase})
                    if held and held[-1].schema != table.schema:
                        yield from close()
                    held.append(table)
                if sum(x.nbytes for x in held) >= HELD_BYTES:
                    yield from close()
        yield from close()

    counted = texts.mapInArrow(scan, "lang string, k int, phrase string, f long")
    return counted.groupBy("lang", "phrase").agg(F.first("k").alias("k"), F.sum("f").alias("f")).filter(F.col("f") >= support)


def totals_of(texts: DataFrame) -> DataFrame:
    """lang, n: words per language."""
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "t"):
                n = np.bincount(_text_rows(part), minlength=part.num_rows)
                yield pa.RecordBatch.from_pydict({"lang": part.column("lang"), "n": n.astype(np.int64)})

    return texts.mapInArrow(scan, "lang string, n long").groupBy("lang").agg(F.sum("n").alias("n"))


def frequent(docs: DataFrame, max_words: int = MAX_WORDS, support: int = SUPPORT, lang_col: str = "lang",
             text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, k, f) of phrases of 1 to max_words words with at least the support, and (lang, n)."""
    texts = docs.select(_lang(lang_col).alias("lang"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t"))
    n = written(totals_of(texts), "totals")
    shares = n.limit(MAX_LANGS + 1).collect()       # a row per language
    totals = {r.lang: r.n for r in shares} if len(shares) <= MAX_LANGS else None
    words = n.agg(F.sum("n")).first()[0] or 0
    buckets = max(words // BUCKET_WORDS, 16)
    levels: list[Bitmap] = []
    for k in range(1, max_words + 1):
        levels.append(Bitmap.of(written(mine(texts, k, levels[-1] if levels else None, totals, support, buckets), "candidates")))
    return written(count_exactly(texts, levels, support), "phrases"), n


def collocations(docs: DataFrame, min_words: int = MIN_WORDS, max_words: int = MAX_WORDS, support: int = SUPPORT,
                 inside_percent: int = INSIDE_PERCENT, top: int = TOP, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """Each language's best phrases: lang, rank, phrase, a, l, r, n, score, cut (words before the lowest-scoring cut)."""
    found, n = frequent(docs, max_words, support, lang_col, text_col)
    words = F.split("phrase", " ")
    phrases = found.filter((F.col("k") >= max(min_words, 2)))
    cuts = phrases.withColumn("w", words).withColumn("cut", F.explode(F.sequence(F.lit(1), F.col("k") - 1)))
    sides = cuts.select("lang", "phrase", "k", "f", "cut", F.posexplode(F.array(
        F.array_join(F.slice("w", F.lit(1), F.col("cut")), " "), F.array_join(F.slice("w", F.col("cut") + 1, F.col("k") - F.col("cut")), " "))).alias("side", "part")) \
        .withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(PARTS)).cast("int"))
    counts = found.filter(F.col("k") < max_words).select("lang", F.col("phrase").alias("part"), F.col("f").alias("pf"))
    known = labelled(sides, counts, ["lang", "part"], "salt").groupBy("lang", "phrase", "k", "f", "cut").agg(
        F.max(F.when(F.col("side") == 0, F.col("pf"))).alias("l"), F.max(F.when(F.col("side") == 1, F.col("pf"))).alias("r"))

    def wide(c: str) -> Column:
        return F.col(c).cast("decimal(18,0)")

    million = F.lit(1_000_000).cast("decimal(7,0)")
    known = known.select("*", (million * (wide("f") * wide("f"))).cast("decimal(38,0)").alias("x"), (wide("l") * wide("r")).cast("decimal(38,0)").alias("y")) \
        .withColumn("score", F.expr("x div y"))
    best = known.groupBy("lang", "phrase", "k", "f").agg(F.min(F.struct("score", "cut", "l", "r")).alias("b"))
    longer = found.filter(F.col("k") > max(min_words, 2)).withColumn("w", words)
    starts = F.flatten(F.transform(F.sequence(F.lit(max(min_words, 2)), F.col("k") - 1), lambda m: F.transform(
        F.sequence(F.lit(1), F.col("k") - m + 1), lambda i: F.array_join(F.slice("w", i, m), " "))))
    inside = longer.select("lang", F.col("f").alias("lf"), F.explode(starts).alias("phrase")).groupBy("lang", "phrase").agg(F.max("lf").alias("lf"))
    left = best.join(inside, ["lang", "phrase"], "left").filter(F.col("lf").isNull() | (100 * F.col("lf") < inside_percent * F.col("f")))
    order = Window.partitionBy("lang").orderBy(F.desc("b.score"), F.desc("f"), "phrase")
    ranked = left.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return ranked.join(n, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", F.col("f").alias("a"), F.col("b.l").alias("l"),
                                         F.col("b.r").alias("r"), "n", F.col("b.score").alias("score"), F.col("b.cut").cast("long").alias("cut"))
