"""A keyed permutation of 0..n-1 as a column expression: a Feistel network over a grid a x b >= n, with cycle walking."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ROUNDS = 4


def _draw(key: str, j: Column, v: Column) -> Column:
    text = F.concat(F.lit(key), F.lit(":"), j.cast("string"), F.lit(":"), v.cast("string"))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")


def permuted(x: Column, n: Column, key: str) -> Column:
    """Where position x of 0..n-1 goes. Bijective for every n >= 1.

    Sides: a = ceil(sqrt(n)), b = ceil(n / a), so fewer than a points of the grid lie outside 0..n-1. A point that lands
    outside is sent on until it is inside; such a walk visits only outside points, so it ends within a * b - n more steps.
    Only rows that land outside pay for it, fewer than a of n.
    """
    a = F.greatest(F.ceil(F.sqrt(n.cast("double"))).cast("long"), F.lit(1).cast("long"))
    b = F.floor((n + a - 1) / a).cast("long")

    def step(y: Column) -> Column:
        start = F.struct((y % a).alias("l"), F.floor(y / a).cast("long").alias("r"))
        return F.aggregate(
            F.sequence(F.lit(1), F.lit(ROUNDS)), start,
            lambda s, j: F.when(j % 2 == 1, F.struct(((s["l"] + _draw(key, j, s["r"])) % a).alias("l"), s["r"].alias("r")))
            .otherwise(F.struct(s["l"].alias("l"), ((s["r"] + _draw(key, j, s["l"])) % b).alias("r"))),
            lambda s: s["l"] + a * s["r"])

    def walk(y: Column) -> Column:
        return F.aggregate(F.sequence(F.lit(1).cast("long"), F.greatest(a * b - n, F.lit(1).cast("long"))), y,
                           lambda y, _: F.when(y < n, y).otherwise(step(y)))

    return F.transform(F.array(step(x)), lambda y: F.when(y < n, y).otherwise(walk(y)))[0]
