"""Mixing sources to target weights over fixed-length blocks of words.

Every source's documents, in a fixed pseudorandom order, are one stream of words cut into blocks of `block` words. The
sources' targets are shares of `share` times all words by weight, none above `most` times its source, what is left over
reshared by weight. Each output shard draws how many slots it gives each source: multinomial draws over the shards,
conditioned on the source's total, so the sum keeps the target. Slot k of a source reads block perm(k mod blocks), where
perm is a Feistel permutation of the source's block numbers; the last slot takes only the words still wanted. Slots
and documents meet in one equi-join on (source, block). Slots are numbered by source, shard after shard, so every slot
belongs to one output shard; `mix` returns the shard, the slot and its words with each document.

Bounds: only rows with one line per source, per (source, bucket) and per (source, output shard) pass through small windows
or a single sort; streams of any length are numbered in buckets, and a hot source's blocks and slots are spread by block
number. Draws depend on the seed and the counts alone, so reruns agree.

Defined cases: a null text has no words; a null source is a source of its own, last in order; documents without words take
nothing; repeated rows are neighbours in the stream and each count; other columns are carried along or ignored, whatever their names; an empty table gives an
empty result. A document never gives more than ceil(`most`) times its words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridspark.llm.common import fresh, row_key, written
from gridspark.llm.permute import permuted
from gridspark.llm.textvec import SPACE_WORDS, Texts, slices

WEIGHTS = (3, 1, 2)
BLOCK = 128
OUTPUT_SHARDS = 64
RUN = 1 << 14
SEED = "mix-1"


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """i, source, size, key, uid: a row per document, without its text. `uid` tells repeated rows apart once it is written."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "t"):
                n = Texts.of(part.column("t")).words(SPACE_WORDS).per_row
                yield pa.RecordBatch.from_arrays([part.column("i"), part.column("source"), pa.array(n), part.column("key")],
                                                 ["i", "source", "size", "key"])

    part = docs.select(F.col(id_col).cast("long").alias("i"), F.col(source_col).cast("string").alias("source"),
                       row_key(id_col, text_col, source_col).alias("key"), F.col(text_col).cast("string").alias("t"))
    return part.mapInArrow(rows, "i long, source string, size long, key string").withColumn("uid", F.monotonically_increasing_id())


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, share: float = 1.5, most: int = 2) -> DataFrame:
    """source, rank, source_size, target. One row per source; the windows here run over those rows only."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    per = per.withColumn("rank", F.row_number().over(order) - 1).withColumn("w", weight)
    all_rows = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    per = per.withColumn("cap", F.col("source_size") * most).withColumn("wanted", F.lit(share) * F.sum("source_size").over(all_rows))
    fill = Window.orderBy(F.col("cap") / F.col("w"), "rank")
    below, onward = fill.rowsBetween(Window.unboundedPreceding, -1), fill.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    # the level is set by the first source, fullest first, that stays under its own cap at the level of those from it on
    level = (F.col("wanted") - F.coalesce(F.sum("cap").over(below), F.lit(0))) / F.sum("w").over(onward)
    per = per.withColumn("level", level).withColumn("under", F.col("level") * F.col("w") <= F.col("cap"))
    per = per.withColumn("at", F.min(F.when(F.col("under"), F.struct(F.col("cap") / F.col("w"), "rank", "level"))).over(all_rows)["level"])
    return per.select("source", "rank", "source_size", F.when(F.col("at") * F.col("w") < F.col("cap"), F.col("at") * F.col("w"))
                      .otherwise(F.col("cap")).cast("double").alias("target"))


def _bucket(key: Column) -> Column:
    return F.conv(F.substring(key, 1, 3), 16, 10).cast("int")


def streams(sizes: DataFrame) -> DataFrame:
    """Each document with words and where its words start in its source's stream (`at`)."""
    rows = sizes.filter("size > 0").withColumn("bucket", _bucket(F.col("key")))
    sums = rows.groupBy("source", "bucket").agg(F.sum("size").alias("n"))
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("source", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset")).alias("o")
    inside = Window.partitionBy("source", "bucket").orderBy("key", "uid").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("inner", F.coalesce(F.sum("size").over(inside), F.lit(0))).alias("r")
    return rows.join(offsets, F.col("r.source").eqNullSafe(F.col("o.source")) & (F.col("r.bucket") == F.col("o.bucket"))) \
        .select("r.source", "uid", "size", (F.col("offset") + F.col("inner")).alias("at"))


def slots(plan: DataFrame, block: int = BLOCK, output_shards: int = OUTPUT_SHARDS, seed: str = SEED) -> DataFrame:
    """source, shard, slot, block, words: what each drawn slot reads, `words` from the block's start."""
    key = int.from_bytes(seed.encode()[:8], "big")

    @F.pandas_udf("array<long>")
    def draw(rank: pd.Series, n: pd.Series) -> pd.Series:
        share = np.full(output_shards, 1 / output_shards)
        return pd.Series([np.random.Generator(np.random.PCG64([key, int(r)])).multinomial(int(k), share) for r, k in zip(rank, n, strict=True)])

    blocks = F.ceil(F.col("source_size") / block).cast("long")
    passes = F.floor(F.col("take") / F.col("source_size")).cast("long")
    plan = plan.filter("source_size > 0").withColumn("take", F.round("target").cast("long")).withColumn("blocks", blocks)
    plan = plan.withColumn("slots", passes * F.col("blocks") + F.ceil((F.col("take") - passes * F.col("source_size")) / block).cast("long"))
    counts = plan.withColumn("counts", draw("rank", "slots")).withColumn("firsts", F.transform("counts", lambda c, i: F.aggregate(
        F.slice(F.col("counts"), F.lit(1), i), F.lit(0).cast("long"), lambda x, y: x + y)))
    shards = counts.select("source", "source_size", "take", "blocks", F.posexplode(F.arrays_zip("counts", "firsts")).alias("shard", "x")) \
        .filter("x.counts > 0")
    # slots are listed in runs of at most RUN, so no array grows with the source; the few rows that explode to many keep a set
    # number of partitions, which is not coalesced for their small size
    last = F.col("x.firsts") + F.col("x.counts") - 1
    runs = shards.select("source", "source_size", "take", "blocks", "shard", last.alias("last"),
                         F.explode(F.sequence(F.col("x.firsts"), last, F.lit(RUN).cast("long"))).alias("low"))
    runs = runs.repartition(int(plan.sparkSession.conf.get("spark.sql.shuffle.partitions")), "source", "low")
    drawn = runs.select("source", "source_size", "take", "blocks", "shard", F.explode(
        F.sequence(F.col("low"), F.least(F.col("low") + RUN - 1, F.col("last")))).alias("slot"))
    # the full blocks of a pass are permuted; a short last block is read last
    full = F.floor(F.col("source_size") / block).cast("long")
    drawn = drawn.withColumn("turn", F.floor(F.col("slot") / F.col("blocks")).cast("long")).withColumn("j", F.col("slot") % F.col("blocks"))
    drawn = drawn.withColumn("block", F.when(F.col("j") < full, permuted(F.col("j"), full, seed)).otherwise(F.col("j")))
    before = F.col("turn") * F.col("source_size") + F.col("j") * block
    length = F.least(F.lit(block).cast("long"), F.col("source_size") - F.col("block") * block)
    words = F.greatest(F.least(F.col("take") - before, length), F.lit(0)).cast("long")
    return drawn.withColumn("words", words).filter("words > 0").select("source", "shard", "slot", "turn", "block", "words")


def pieces(sizes: DataFrame, plan: DataFrame, block: int = BLOCK, output_shards: int = OUTPUT_SHARDS, seed: str = SEED) -> DataFrame:
    """What the mix reads of each document: uid, output shard, slot, turn, and the words first..last (exclusive) of the document."""
    end = F.col("at") + F.col("size")
    cut = streams(sizes).withColumn("block", F.explode(F.sequence(
        F.floor(F.col("at") / block).cast("long"), F.floor((end - 1) / block).cast("long")))).alias("d")
    # the few rows that slots come from look small enough to broadcast, the slots are not
    taken = slots(plan, block, output_shards, seed).hint("merge").alias("t")
    both = cut.join(taken, F.col("d.source").eqNullSafe(F.col("t.source")) & (F.col("d.block") == F.col("t.block")))
    low = F.greatest(F.col("d.block") * block, F.col("at"))
    high = F.least(F.col("d.block") * block + F.col("words"), end)
    return both.select("uid", "shard", "slot", "turn", (low - F.col("at")).alias("first"), (high - F.col("at")).alias("last")).filter("last > first")


def mix(docs: DataFrame, weights: tuple = WEIGHTS, share: float = 1.5, most: int = 2, block: int = BLOCK, output_shards: int = OUTPUT_SHARDS,
        seed: str = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """id, size, source_size, target, taken, reads of every row; `reads` lists shard:slot:words of each slot that reads it, by slot."""
    sizes = written(word_counts(docs, id_col, text_col, source_col), "sizes")
    plan = targets(sizes, weights, share, most)
    words = F.col("last") - F.col("first")
    got = pieces(sizes, plan, block, output_shards, seed).groupBy("uid").agg(
        F.sum(words).alias("taken"), F.array_sort(F.collect_list(F.struct("slot", "shard", words.alias("words")))).alias("reads"))
    reads = F.array_join(F.transform("reads", lambda x: F.concat_ws(":", x["shard"], x["slot"], x["words"])), ",")
    p = plan.select(F.col("source").alias("s2"), "source_size", "target")
    out = sizes.join(got, "uid", "left").join(p, F.col("source").eqNullSafe(F.col("s2")))
    return out.select(F.col("i").alias(id_col), "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"),
                      F.coalesce(reads, F.lit("")).alias("reads"))


def mixed_documents(docs: DataFrame, weights: tuple = WEIGHTS, share: float = 1.5, most: int = 2, block: int = BLOCK,
                    output_shards: int = OUTPUT_SHARDS, seed: str = SEED, text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix itself with the documents' columns: one row per document and pass, its text cut to the words that are read.

    A document that a pass reads whole keeps its text as it is; one read twice appears twice; one not read is gone.
    """
    own = fresh(docs, "uid", "read")
    numbered = written(docs.withColumn(own["uid"], F.monotonically_increasing_id()), "numbered")
    sizes = written(word_counts(numbered, own["uid"], text_col, source_col).drop("uid").withColumnRenamed("i", "uid"), "sizes")
    read = pieces(sizes, targets(sizes, weights, share, most), block, output_shards, seed)
    read = read.groupBy(F.col("uid").alias(own["uid"]), "turn").agg(
        F.array_sort(F.collect_list(F.struct("first", "last"))).alias(own["read"]))
    both = numbered.join(read.drop("turn"), own["uid"])

    names = docs.columns

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text_col):
                texts = Texts.of(part.column(text_col))
                words = texts.words(SPACE_WORDS)
                out = []
                for k, spans in enumerate(part.column(own["read"]).to_pylist()):
                    raw, first = texts.data[texts.offsets[k]:texts.offsets[k + 1]].tobytes(), words.first[k]
                    joined: list[list[int]] = []
                    for s in spans:
                        if joined and joined[-1][1] == s["first"]:
                            joined[-1][1] = s["last"]
                        else:
                            joined.append([s["first"], s["last"]])
                    if joined == [[0, words.per_row[k]]]:
                        out.append(raw.decode())
                        continue
                    at = texts.offsets[k]
                    out.append("\n".join(raw[words.start[first + a] - at:words.end[first + b - 1] - at].decode() for a, b in joined))
                texts_out = pa.array(out, part.schema.field(text_col).type)
                yield pa.RecordBatch.from_arrays([texts_out if n == text_col else part.column(n) for n in names], names)

    return both.select(*names, own["read"]).mapInArrow(cut, docs.schema)
