"""Writes: month partitions that keep settled months, sorted tables, JSON lines per split, reports, resume."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridspark.functions import timeconv as T


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def _files(spark: SparkSession, path: str) -> set[str]:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return {s.getPath().getName() for s in p.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(p)} if _exists(spark, path) else set()


def _months(spark: SparkSession, path: str) -> list[str]:
    """Labels of the month folders under a path."""
    return sorted(n.removeprefix("month=") for n in _files(spark, path) if n.startswith("month="))


def write_months(df: DataFrame, path: str, overwrite_months: list[str] | None = None, column: str = "start_local") -> list[str]:
    """One partition per local month. Months already written stay as they are unless listed; returns those written.

    Month labels come from the folder names; a large month is split by size at run time. A listed month that was already there
    came up again if its folder holds other files after the write, so the input is read once."""
    spark = df.sparkSession
    rows = df.withColumn("month", T.month_key(column))
    settled = _months(spark, path)
    again = [m for m in settled if m in (overwrite_months or [])]
    keep = [m for m in settled if m not in again]
    if keep:
        rows = rows.filter(~F.col("month").isin(keep))
    before = {m: _files(spark, f"{path}/month={m}") for m in again}
    (rows.hint("rebalance", "month").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("month").parquet(path))
    redone = [m for m in again if _files(spark, f"{path}/month={m}") != before[m]]
    return sorted({*redone, *_months(spark, path)} - set(keep) - (set(again) - set(redone)))


def recent_months(today, n: int = 2) -> list[str]:
    """Labels of the current and earlier months that may still grow."""
    total = today.year * 12 + today.month - 1
    return [f"{(total - i) // 12:04d}-{(total - i) % 12 + 1:02d}" for i in range(n)]


def restore_table(spark: SparkSession, path: str) -> bool:
    """Put the replaced table back where a run ended between the two renames of `build_table`; true if there was one to put back."""
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path
    here, old = jvm_path(path), jvm_path(path.rstrip("/") + "__replaced")
    fs = here.getFileSystem(spark._jsc.hadoopConfiguration())
    return not fs.exists(here) and fs.exists(old) and fs.rename(old, here)


def build_table(df: DataFrame, path: str, sort_keys: list[str], partitions: int | None = None) -> None:
    """Typed table clustered by (entity, time): range partitions, sorted files, swapped in when complete."""
    spark = df.sparkSession
    restore_table(spark, path)
    ranged = df.repartitionByRange(partitions, *sort_keys) if partitions else df.repartitionByRange(*sort_keys)
    staging = path.rstrip("/") + "__building"
    ranged.sortWithinPartitions(*sort_keys).write.mode("overwrite").parquet(staging)
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path
    fs = jvm_path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    here, old = jvm_path(path), jvm_path(path.rstrip("/") + "__replaced")
    fs.delete(old, True)
    held = fs.exists(here)
    if held and not fs.rename(here, old):
        raise OSError(f"could not set {path} aside")
    if not fs.rename(jvm_path(staging), here):
        if held:
            fs.rename(old, here)
        raise OSError(f"could not move {staging} to {path}")
    fs.delete(old, True)


def write_json_lines(df: DataFrame, path: str, by: list[str], order: str) -> None:
    """JSON lines in one folder per partition value, ordered by id within each file."""
    payload = F.to_json(F.struct(*[c for c in df.columns if c not in by]))
    rows = df.select(*by, order, payload.alias("value")).repartitionByRange(*by, order).sortWithinPartitions(*by, order)
    rows.select(*by, "value").write.mode("overwrite").partitionBy(*by).text(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def markdown(report: DataFrame, title: str, limit: int = 1000) -> str:
    """Small finished report as a table; refuses anything longer than a report."""
    rows = report.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"{title}: more than {limit} rows is not a report")
    show = lambda v: "-" if v is None else f"{v:.3f}" if isinstance(v, float) else str(v)
    cols = report.columns
    lines = [f"### {title}", "", "| " + " | ".join(cols) + " |", "|" + "---|" * len(cols)]
    lines += ["| " + " | ".join(show(r[c]) for c in cols) + " |" for r in rows]
    return "\n".join(lines) + "\n"


def remaining(wanted: DataFrame, done: DataFrame, key: list[str]) -> DataFrame:
    """Work not yet in the output (resume)."""
    return wanted.join(done.select(*key).distinct(), key, "left_anti")
