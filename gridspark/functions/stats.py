"""Small numeric Column expressions shared by several jobs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridspark.constants import MIN_BASELINE_LOSS, QUANTILES
from gridspark.functions.timeconv import col


def nan_to_null(c: Column | str) -> Column:
    c = col(c)
    return F.when(~F.isnan(c), c)


def weighted_mean(value: Column | str, weight: Column | str) -> Column:
    """Null values are skipped and the remaining weights rescaled; all null gives null."""
    value, weight = col(value), col(weight)
    live = F.when(value.isNotNull(), weight)
    return F.try_divide(F.sum(value * weight), F.nullif(F.sum(live), F.lit(0.0)))


def pinball(y: Column | str, q: Column | str, tau: float) -> Column:
    d = col(y) - col(q)
    return F.greatest(tau * d, (tau - 1.0) * d)


def quantile_loss(y: Column | str, prefix: str = "") -> Column:
    """Mean pinball loss over the three standard quantiles of one row."""
    parts = [pinball(y, F.col(prefix + k), tau) for k, tau in QUANTILES.items()]
    return reduce(lambda a, b: a + b, parts) / len(parts)


def covered(y: Column | str, p10: Column | str = "p10", p90: Column | str = "p90") -> Column:
    y = col(y)
    return ((y >= col(p10)) & (y <= col(p90))).cast("double")


def clip(c: Column, lo: float, hi: float) -> Column:
    return F.least(F.greatest(c, F.lit(lo)), F.lit(hi))


def relative_skill(model_loss: Column, base_loss: Column) -> Column:
    return clip((base_loss - model_loss) / F.greatest(base_loss, F.lit(MIN_BASELINE_LOSS)), -1.0, 1.0)


def scaled_skill(model_loss: Column, base_loss: Column, scale: Column) -> Column:
    return clip((base_loss - model_loss) / scale, -1.0, 1.0)


def sorted_quantiles(*cols: str) -> dict[str, Column]:
    """Row-wise non-crossing quantiles."""
    ordered = F.array_sort(F.array(*[F.col(c) for c in cols]))
    return {c: ordered[i] for i, c in enumerate(cols)}


def quantile_at(value: Column | str, q) -> Column:
    """Exact linear-interpolated quantile; groups must be bounded by the calendar grain."""
    return F.percentile(col(value), q)


def pass_at_k(n: Column, c: Column, k: int) -> Column:
    """Unbiased estimate 1 - C(n-c, k) / C(n, k) as a short product, without factorials."""
    miss = F.aggregate(F.sequence(F.lit(0), F.lit(k - 1)), F.lit(1.0),
                       lambda acc, i: acc * F.try_divide(F.greatest(n - c - i, F.lit(0)).cast("double"), n - i))
    return F.when(n - c < k, F.lit(1.0)).otherwise(1.0 - miss)


def hash_uniform(*parts: Column) -> Column:
    """Deterministic uniform in (0, 1) from the first 8 hex digits of an md5."""
    text = F.concat_ws("-", *[p.cast("string") for p in parts])
    return (F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0


def hash_normal(*parts: Column) -> Column:
    """Deterministic standard normal (Box-Muller on two hashed uniforms)."""
    u1 = hash_uniform(*parts, F.lit("u"))
    u2 = hash_uniform(*parts, F.lit("v"))
    return F.sqrt(-2.0 * F.log(u1)) * F.cos(2.0 * F.pi() * u2)
