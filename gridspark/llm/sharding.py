"""Sharding by a Feistel permutation of global row numbers: reproducible, with computable shard and slot.

Rows get a global number in the order (hash bucket, id, size, checksum): rows are counted by those values first, bucket
totals give each bucket its offset, and a running sum inside the bucket gives the rest, so no task sorts the table and rows
repeated in full are one counted row until the end. The permuted number p means shard p mod k, slot p div k: shard counts
differ by one at most and slots have no gaps (law `rows`).

Defined cases: a null text has size 1 and a null checksum; a null id is a value like any other; rows alike in id, size and
checksum are interchangeable and take consecutive numbers; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridspark.llm.permute import permuted

BUCKET_DIGITS = 3   # hexadecimal: 4096 buckets
RUN = 1 << 14


def numbered(df: DataFrame, columns: list[str], digits: int = BUCKET_DIGITS) -> DataFrame:
    """The columns, the row's global number (`number`) and the number of rows (`total`)."""
    text = F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in columns))
    bucket = F.conv(F.substring(F.md5(text.cast("binary")), 1, digits), 16, 10).cast("int")
    counted = df.groupBy(*columns).agg(F.count("*").alias("copies")).withColumn("bucket", bucket)
    sums = counted.groupBy("bucket").agg(F.sum("copies").alias("n"))
    # one window over at most 16 ** digits rows
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"),
                          F.sum("n").over(Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("total"))
    inside = Window.partitionBy("bucket").orderBy(*columns).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = counted.withColumn("upto", F.sum("copies").over(inside)).join(offsets, "bucket")
    end = F.col("offset") + F.col("upto") - 1
    # rows repeated in full are listed in runs of at most RUN, and the runs spread, so no array or task grows with the copies
    runs = placed.select(*columns, "total", end.alias("end"), F.explode(
        F.sequence(end - F.col("copies") + 1, end, F.lit(RUN).cast("long"))).alias("low")).repartition("low")
    return runs.select(*columns, "total", F.explode(F.sequence(F.col("low"), F.least(F.col("low") + RUN - 1, F.col("end")))).alias("number"))


def shards(docs: DataFrame, n_shards: int = 8, seed: str = "shuffle-1", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, size, text_crc32, law, shard, slot, grown_shard of every row."""
    raw = docs.select(F.col(id_col).alias("i"), (F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)) + 1).cast("long").alias("size"),
                      F.crc32(F.col(text_col).cast("string").cast("binary")).alias("crc"))
    rows = numbered(raw, ["i", "size", "crc"]).withColumn("p", permuted(F.col("number"), F.col("total"), seed))
    return rows.select(F.col("i").alias(id_col), "size", F.col("crc").alias("text_crc32"), F.lit("rows").alias("law"),
                       (F.col("p") % n_shards).cast("int").alias("shard"), F.floor(F.col("p") / n_shards).cast("long").alias("slot"),
                       F.lit(None).cast("int").alias("grown_shard"))
