"""SimHash near-duplicates by meet-in-the-middle ball hashing.

1. A text's fingerprint has a bit set where more than half of its shingles' XXH64 values have it (repeats count).
   Equal fingerprints collapse to one class, its smallest id.
2. Two fingerprints within `distance` bits share a value that lies within half of it from both. So every class emits all
   variants within that radius and classes that meet at one variant are linked. Variants are not shuffled one by one: a row
   says "this fingerprint, seen from this prefix, with so many flips left", one for every prefix that its variants have
   (79 rows stand for 2,081 variants at twelve bits), and the task that owns the prefix lists the variants there.
3. The prefix has `FIRST_BITS` bits (79 rows a fingerprint) or as many more as the number of classes asks for, and a prefix
   with more than `GROUP` variants is cut four bits deeper, again and again, so a dense cluster is spread too; at full length
   a group is one variant, which only 2,081 fingerprints can share. A class never emits more rows than it has variants.
4. Inside a group equal variants are found by sorting, each pair is verified by its differing bits, and a forest of the
   links leaves the task. Components of the forest give the result. Nothing is capped.

Defined cases: null, empty or wordless texts have the fingerprint zero, which links like any other; fewer words than a
shingle make one shingle of the whole text; a null id is never linked and has a null component; rows repeated in full stay
rows; rows that repeat an id with another text are judged by their own text, and the id joins both components; other columns
are ignored; empty tables work.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache, reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridspark.llm.common import components, labelled, written
from gridspark.llm.textvec import SPACE_WORDS, Texts, slices

SHINGLE, DISTANCE, SEED = 4, 4, 42
GROUP = 1 << 22        # variants of one prefix that a task lists at once
FIRST_BITS, MEAN = 12, 1 << 19     # shortest first prefix; it is longer where the mean group would pass MEAN variants
DEEPER = 4
PARTS = 64
_STEP = 1 << 16


def fingerprints_of(texts: Texts, k: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """One 64-bit fingerprint per text."""
    words = texts.words(SPACE_WORDS, lower=True)
    joined, start, end = words.joined()
    n = words.per_row
    shingles = np.where(n >= k, n - k + 1, np.minimum(n, 1))
    before = np.cumsum(shingles) - shingles
    row = np.repeat(np.arange(len(texts)), shingles)
    first = words.first[row] + np.arange(len(row)) - before[row]
    a, b = start[first], end[first + np.minimum(n[row], k) - 1]
    ones = np.zeros((len(texts), 64), np.int64)
    digest = xxhash.xxh64_intdigest
    for lo in range(0, len(row), _STEP):
        r = row[lo:lo + _STEP]
        h = np.array([digest(joined[x:y], seed) for x, y in zip(a[lo:lo + _STEP].tolist(), b[lo:lo + _STEP].tolist(), strict=True)], "<u8")
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        cuts = np.append(np.flatnonzero(np.diff(r, prepend=-1)), len(r))
        for x, y in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            ones[r[x]] += bits[x:y].sum(0, dtype=np.int32)
    return np.packbits(2 * ones > shingles[:, None], axis=1, bitorder="little").reshape(-1).view("<u8")


def fingerprints(docs: DataFrame, k: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """i, fp (signed) and the part that deals rows with equal fingerprints."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "t"):
                yield pa.RecordBatch.from_pydict({"i": part.column("i"), "fp": fingerprints_of(Texts.of(part.column("t")), k).view(np.int64)})

    part = docs.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).cast("string").alias("t"))
    return part.mapInArrow(rows, "i long, fp long").withColumn("part", (F.monotonically_increasing_id() % PARTS).cast("int"))


def flips(bits: int, most: int, shift: int = 0) -> list[tuple[int, int]]:
    """(mask, number of flipped bits) of every way to flip up to `most` of the `bits` bits that lie above `shift`."""
    return [(sum(1 << (shift + b) for b in at), n) for n in range(most + 1) for at in combinations(range(bits), n)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _deeper(rows: DataFrame, bits: int, more: int, radius: int) -> DataFrame:
    """Rows (rep, fp, seen, flips left) seen from prefixes that are `more` bits longer; `seen` is the fingerprint with the prefix's flips done."""
    ways = F.array(*(F.struct(F.lit(_signed(m)).alias("mask"), F.lit(n).alias("n")) for m, n in flips(more, radius, 64 - bits - more)))
    out = rows.select("rep", "fp", "seen", "left", F.explode(F.filter(ways, lambda w: w["n"] <= F.col("left"))).alias("way"))
    return out.select("rep", "fp", F.col("seen").bitwiseXOR(F.col("way.mask")).alias("seen"), (F.col("left") - F.col("way.n")).alias("left"))


def _variants(bits: int, left: int) -> int:
    return sum(math.comb(64 - bits, n) for n in range(left + 1))


def _spanning(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The least member of each node's component."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


@cache
def _masks(bits: int, most: int) -> np.ndarray:
    return np.array([m for m, _ in flips(bits, most)], np.uint64)


def _ones(x: np.ndarray) -> np.ndarray:
    return np.unpackbits(x.view(np.uint8).reshape(-1, 8), axis=1).sum(1)


def meet(fp: np.ndarray, rep: np.ndarray, key: int, bits: int, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """A forest (a, b of rep) of the links between fingerprints whose variants meet under the prefix `key`."""
    values, owners = [], []
    below = np.uint64((1 << (64 - bits)) - 1)
    seen = (fp & below) | np.uint64(key)
    left = distance // 2 - _ones(seen ^ fp)
    for r in np.unique(left):
        at = np.flatnonzero(left == r)
        masks = _masks(64 - bits, int(r))
        values.append((seen[at, None] ^ masks).reshape(-1))
        owners.append(np.repeat(at, len(masks)))
    value, owner = np.concatenate(values), np.concatenate(owners)
    ordered = np.sort(value)
    again = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    if not len(again):
        return rep[:0], rep[:0]
    place = np.minimum(np.searchsorted(again, value), len(again) - 1)
    hit = np.flatnonzero(again[place] == value)
    hit = hit[np.lexsort((owner[hit], place[hit]))]
    group, who = place[hit], owner[hit]
    first = np.flatnonzero(np.diff(group, prepend=-1))
    head = np.repeat(who[first], np.diff(np.append(first, len(who))))
    near = _ones(fp[head] ^ fp[who]) <= distance
    label = _spanning(head[near], who[near], len(fp))
    b = np.flatnonzero(label != np.arange(len(fp)))
    return rep[label[b]], rep[b]


def links(classes: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """a, b: links that span every group of classes (rep, fp) whose variants meet."""
    radius = distance // 2
    n = classes.count()
    bits = min(max(math.ceil(math.log2(max(n, 1) * _variants(0, radius) / MEAN)), FIRST_BITS), 24)
    rows = _deeper(classes.select("rep", "fp", F.col("fp").alias("seen"), F.lit(radius).alias("left")), 0, bits, radius)
    done = []
    while True:
        key = F.col("seen").bitwiseAND(F.lit(_signed(((1 << bits) - 1) << (64 - bits) if bits else 0)))
        keyed = rows.withColumn("key", key).withColumn("bits", F.lit(bits))
        weight = F.element_at(F.array(*(F.lit(_variants(bits, r)) for r in range(radius + 1))), F.col("left") + 1)
        dense = written(keyed.groupBy("key").agg(F.sum(weight).alias("w")).filter(F.col("w") > GROUP).select("key", F.lit(True).alias("dense")), "dense")
        if bits >= 64 or dense.isEmpty():
            done.append(keyed)
            break
        judged = written(labelled(keyed.withColumn("part", F.pmod(F.xxhash64("fp"), F.lit(PARTS))), dense, ["key"], "part"), "prefixes")
        done.append(judged.filter("dense is null").select(*keyed.columns))
        more = min(DEEPER, 64 - bits)
        rows = _deeper(judged.filter("dense"), bits, more, radius)
        bits += more
    every = reduce(DataFrame.unionByName, (x.select("bits", "key", "fp", "rep") for x in done))

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None

        def close(x: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            bits, key, fp, rep = x
            cuts = np.append(np.flatnonzero(np.append(True, (bits[1:] != bits[:-1]) | (key[1:] != key[:-1]))), len(key))
            for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                if hi - lo > 1:
                    a, b = meet(fp[lo:hi].view(np.uint64), rep[lo:hi], int(key[lo]) & (1 << 64) - 1, int(bits[lo]), distance)
                    if len(a):
                        yield pa.RecordBatch.from_pydict({"a": a, "b": b})

        for batch in batches:
            if not batch.num_rows:
                continue
            now = [batch.column(c).to_numpy() for c in ("bits", "key", "fp", "rep")]
            held = now if held is None else [np.concatenate(x) for x in zip(held, now, strict=True)]
            last = (held[0] == held[0][-1]) & (held[1] == held[1][-1])
            if not last.all():          # the last group may go on in the next batch
                cut = int(len(last) - np.argmin(last[::-1]))
                yield from close([x[:cut] for x in held])
                held = [x[cut:] for x in held]
        if held is not None:
            yield from close(held)

    grouped = every.repartition("bits", "key").sortWithinPartitions("bits", "key")
    return grouped.mapInArrow(found, "a long, b long")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, distance: int = DISTANCE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, fingerprint (hex) and component_id of every row; `distance` must be even, half of it on either side."""
    if distance % 2 or distance < 0:
        raise ValueError("distance must be even: both fingerprints of a pair flip half of it")
    rows = written(fingerprints(docs, shingle, id_col, text_col), "fingerprints")
    known = rows.filter("i is not null")
    classes = written(known.groupBy("fp").agg(F.min("i").alias("rep")), "classes")
    # one id on several fingerprints ties their classes together
    pairs = known.select("i", "fp").distinct()
    several = pairs.groupBy("i").agg(F.count("*").alias("n")).filter("n > 1").select("i")
    tied = pairs.join(several, "i", "left_semi").join(classes, "fp").select(F.col("i").alias("a"), F.col("rep").alias("b"))
    named = components(links(classes, distance).unionByName(tied), name="links")
    label = classes.join(named, F.col("rep") == F.col("node"), "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    out = labelled(rows, label, ["fp"], "part")
    return out.select(F.col("i").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
                      F.when(F.col("i").isNotNull(), F.col("component_id")).alias("component_id"))
