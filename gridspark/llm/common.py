"""What the operators share: shared folders, table reads, row keys, components of links."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

SALTS = 16

_own: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Only a local session without one gets a temporary folder of its own."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if "folder" not in _own:
        _own["folder"] = tempfile.mkdtemp(prefix="spark-llm-")
        atexit.register(shutil.rmtree, _own["folder"], ignore_errors=True)
    return f"file://{_own['folder']}"


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write once to the shared folder and read back. Unlike checkpoint() it computes the rows once."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_written(df: DataFrame) -> None:
    """Delete what `written` made; the frame must not be used again."""
    spark = df.sparkSession
    for f in df.inputFiles()[:1]:
        path = spark._jvm.org.apache.hadoop.fs.Path(f).getParent()
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def fresh(df: DataFrame, *names: str) -> dict[str, str]:
    """Helper column names that the frame does not have, whatever its columns are called."""
    taken = {c.lower() for c in df.columns}
    out = {}
    for name in names:
        new = f"__{name}"
        while new in taken:
            new += "_"
        out[name] = new
        taken.add(new)
    return out


def row_key(*columns: str) -> Column:
    """One string per distinct content of the columns; nulls differ from empty strings. Rows alike in all of them share it."""
    parts = [F.coalesce(F.concat(F.lit("v"), F.md5(F.col(c).cast("string").cast("binary"))), F.lit("n")) for c in columns]
    return F.md5(F.concat_ws("|", *parts).cast("binary"))


def join_spread(rows: DataFrame, found: DataFrame, key: str, how: str = "left") -> DataFrame:
    """Join what was found per text (one row per key) to all rows with that text.

    One text may be that of a third of all rows, so rows are dealt over SALTS parts by their position in the scan, and the
    rows of `found`, which are only those of texts with a find, are repeated for each part.
    """
    salt = fresh(rows, "salt")["salt"]
    dealt = rows.withColumn(salt, (F.monotonically_increasing_id() % SALTS).cast("int"))
    repeated = found.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return dealt.join(repeated, [key, salt], how).drop(salt)


def labelled(rows: DataFrame, labels: DataFrame, key: list[str], salt: str) -> DataFrame:
    """Left join with at most one label per key, for rows whose key may be that of a third of them.

    `salt` deals the rows of a key over parts. Labels meet the distinct (key, salt) pairs first, at most one a part, and only
    these pairs meet the rows, so nothing is repeated for keys that have few rows. Keys must not be null.
    """
    parts = rows.select(*key, salt).distinct().join(labels, key)
    return rows.join(parts, [*key, salt], "left")


def _with_least(edges: DataFrame) -> DataFrame:
    """a, b and m, the least b of a; a hub's edges stay dealt over SALTS parts in the aggregate and in the join."""
    dealt = edges.withColumn("s", F.pmod(F.xxhash64("b"), F.lit(SALTS)).cast("int"))
    part = dealt.groupBy("a", "s").agg(F.min("b").alias("m"))
    whole = part.groupBy("a").agg(F.min("m").alias("m"))
    return dealt.join(part.select("a", "s").join(whole, "a"), ["a", "s"]).select("a", "b", "m")


def components(links: DataFrame, a: str = "a", b: str = "b", name: str = "components") -> DataFrame:
    """(node, component) with the smallest node reachable, for every node of the links.

    Alternates large-star and small-star contraction. A node's least neighbour is found in two levels, per part of its edges
    and per node, and joined back by node and part, so a hub's links stay spread over tasks; rounds grow with the logarithm
    of the longest chain. What a round writes is counted while it is written.
    """
    def kept(df: DataFrame) -> tuple[DataFrame, tuple]:
        seen = Observation()
        out = written(df.observe(seen, F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.xxhash64("a", "b") % (1 << 32)), F.lit(0)).alias("h")), name)
        return out, (seen.get["n"], seen.get["h"])

    edges, before = kept(links.select(F.least(a, b).alias("b"), F.greatest(a, b).alias("a")).filter("a <> b").distinct())
    while before[0]:
        sides = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = _with_least(sides).withColumn("m", F.least("m", "a"))
        large = written(least.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct(), name)
        pair = F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))
        after, now = kept(_with_least(large).select(F.explode(pair).alias("e")).select("e.*").filter("a <> b").distinct())
        drop_written(large)
        drop_written(edges)
        edges = after
        if now == before:
            break
        before = now
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
