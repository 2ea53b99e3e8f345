"""MinHash near-duplicates by an LSH forest: sorted signature orders, prefix neighbours, depth that follows the density.

1. Every text becomes its set of distinct word shingles, a digest of the set, and `TREES * DEPTH` one-byte MinHash values.
   Equal sets collapse to one class (its smallest id), so exact copies cost one row from here on.
2. Each tree sorts the classes by its own run of the signature (range partitions, so a dense stretch is split). Neighbours
   that share the first `MIN_DEPTH` values form a region; a region of more than `REGION` rows is cut one value deeper,
   again and again, so depth adapts to density. Inside a region signatures are compared and rows whose estimate is within
   five standard deviations of the threshold are chained into blocks; rows equal over the whole depth are chained at once.
3. Blocks (components of the chains) are large enough to hold every link; their texts are read again and links are
   confirmed on full sets by an in-block prefix filter, rarest shingles first. Only a spanning forest of confirmed links
   leaves a task. A block above `TILE` rows or `TILE_SHINGLES` shingles is split into tiles and every pair of tiles is a
   task, so no group is collected whole.
4. Components of the confirmed links give the result.

A pair at the threshold shares MIN_DEPTH values in none of the trees with probability (1 - 0.85**3)**16 = 2e-7; deeper
regions lean on the many other paths inside a dense group. Nothing is capped: every region, block and pair is handled.

Defined cases: null or wordless texts have empty sets, link with nothing and are their own component; fewer words than a
shingle make one shingle; a null id is never linked, has a null component and is kept; rows repeated in full are one
document; rows that repeat an id with another text are judged by their own text; other columns are ignored; empty tables work.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridspark.llm.common import components, fresh, labelled, row_key, written
from gridspark.llm.textvec import SPACE_WORDS, Texts, mix, slices

SHINGLE = 5
PERCENT = 85
TREES, DEPTH, MIN_DEPTH = 16, 8, 3
VALUES = TREES * DEPTH
REGION = 1024
TILE, TILE_SHINGLES = 4096, 1_000_000
SPREAD, SPREAD_ROWS = 16, 128   # smaller blocks are spread over up to SPREAD tiles, none below SPREAD_ROWS rows
SEED = 20_240_607
PARTS = 64


def shingle_sets(texts: Texts, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Rows and hashes of the distinct shingles, sorted by row, then hash."""
    words = texts.words(SPACE_WORDS, lower=True)
    at, h = words.grams(k)
    rows = [words.row[at]]
    hashes = [h]
    for n in range(1, k):
        at, h = words.grams(n)
        whole = words.per_row[words.row[at]] == n
        rows.append(words.row[at[whole]])
        hashes.append(mix(h[whole] + np.uint64(n)))
    row, h = np.concatenate(rows), np.concatenate(hashes)
    order = np.lexsort((h, row))
    row, h = row[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    return row[new], h[new]


def _permutations() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.RandomState(SEED)
    return (rng.randint(0, 1 << 32, VALUES, dtype=np.uint32) | np.uint32(1)), rng.randint(0, 1 << 32, VALUES, dtype=np.uint32)


def sketch(texts: Texts, k: int = SHINGLE) -> dict[str, np.ndarray]:
    """Per row: set size, two halves of an order-free digest of the set, and the one-byte MinHash values."""
    row, h = shingle_sets(texts, k)
    n = np.bincount(row, minlength=len(texts)).astype(np.int64)
    full = n > 0
    first = (np.cumsum(n) - n)[full]
    d1, d2 = np.zeros(len(texts), np.uint64), np.zeros(len(texts), np.uint64)
    values = np.zeros((len(texts), VALUES), np.uint8)
    if len(h):
        d1[full] = np.add.reduceat(h, first)
        d2[full] = np.add.reduceat(mix(h ^ np.uint64(0x5851F42D4C957F2D)), first)
        short = (h >> np.uint64(32)).astype(np.uint32)
        for v, (a, c) in enumerate(zip(*_permutations(), strict=True)):
            values[full, v] = np.minimum.reduceat((short ^ c) * a, first) & 0xFF
    return {"n": n, "d1": d1.view(np.int64), "d2": d2.view(np.int64), "sig": values}


def sketches(docs: DataFrame, k: int, id_col: str, text_col: str) -> DataFrame:
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "t"):
                out = sketch(Texts.of(part.column("t")), k)
                sig = pa.FixedSizeBinaryArray.from_buffers(pa.binary(VALUES), part.num_rows, [None, pa.py_buffer(np.ascontiguousarray(out["sig"]))])
                yield pa.RecordBatch.from_pydict({"i": part.column("i"), "tkey": part.column("tkey"), "n": out["n"], "d1": out["d1"],
                                                  "d2": out["d2"], "sig": sig.cast(pa.binary())})

    part = docs.select(F.col(id_col).cast("long").alias("i"), row_key(text_col).alias("tkey"), F.col(text_col).cast("string").alias("t"))
    return part.mapInArrow(rows, "i long, tkey string, n long, d1 long, d2 long, sig binary")


def _chains(labels: np.ndarray, sig: np.ndarray, n: np.ndarray, depth: int, percent: int, least: int) -> Iterator[tuple[int, int]]:
    """Pairs of positions that chain one region into blocks, cutting it deeper while it is large."""
    m = len(n)
    if m < 2:
        return
    if m > REGION:
        if depth < DEPTH:
            cuts = [0, *(np.flatnonzero(np.diff(labels[:, depth].astype(np.int16))) + 1).tolist(), m]
            for a, b in zip(cuts, cuts[1:], strict=False):
                for x, y in _chains(labels[a:b], sig[a:b], n[a:b], depth + 1, percent, least):
                    yield a + x, a + y
        else:
            for y in range(1, m):
                yield 0, y
        return
    left = np.arange(m)
    while len(left) > 1:
        root, left = left[0], left[1:]
        queue = [root]
        while queue and len(left):
            x = queue.pop()
            alike = (sig[left] == sig[x]).sum(1) >= least
            alike &= 100 * np.minimum(n[left], n[x]) >= percent * np.maximum(n[left], n[x])
            for y in left[alike].tolist():
                yield root, y
                queue.append(y)
            left = left[~alike]


def chains(classes: DataFrame, percent: int) -> DataFrame:
    """a, b: classes that belong to one block."""
    share = percent / 100
    lowest = share - 5 * (share * (1 - share) / VALUES) ** 0.5
    least = int(VALUES * (lowest + (1 - lowest) / 256))

    def scan(t: np.ndarray, rep: np.ndarray, n: np.ndarray, sig: np.ndarray) -> pa.RecordBatch:
        a, b = [], []
        trees = sig.reshape(len(t), TREES, DEPTH)[np.arange(len(t)), t]
        new = np.ones(len(t), bool)
        new[1:] = (t[1:] != t[:-1]) | (trees[1:, :MIN_DEPTH] != trees[:-1, :MIN_DEPTH]).any(1)
        cuts = np.append(np.flatnonzero(new), len(t))
        for k in np.flatnonzero(np.diff(cuts) > 1):
            lo, hi = cuts[k], cuts[k + 1]
            for x, y in _chains(trees[lo:hi], sig[lo:hi], n[lo:hi], MIN_DEPTH, percent, least):
                a.append(rep[lo + x])
                b.append(rep[lo + y])
        return pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            sig = np.frombuffer(b"".join(batch.column("sig").to_pylist()), np.uint8).reshape(-1, VALUES)
            now = [batch.column("t").to_numpy(), batch.column("rep").to_numpy(), batch.column("n").to_numpy(), sig]
            held = now if held is None else [np.concatenate(x) for x in zip(held, now, strict=True)]
            t, sigs = held[0], held[3]
            start = DEPTH * int(t[-1])
            same = (t == t[-1]) & (sigs[:, start:start + MIN_DEPTH] == sigs[-1, start:start + MIN_DEPTH]).all(1)
            cut = int(len(t) - np.argmin(same[::-1])) if not same.all() else 0   # the last region may go on in the next batch
            if cut:
                yield scan(*(x[:cut] for x in held))
                held = [x[cut:] for x in held]
        if held is not None and len(held[0]):
            yield scan(*held)

    trees = classes.select(F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("t"), "rep", "n", "sig") \
        .withColumn("label", F.substring("sig", F.col("t") * DEPTH + 1, F.lit(DEPTH)))
    ordered = trees.repartitionByRange("t", "label", "rep").sortWithinPartitions("t", "label", "rep").select("t", "rep", "n", "sig")
    return ordered.mapInArrow(rows, "a long, b long")


def confirm(ids: list[int], sets: list[np.ndarray], side: list[int] | None, percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the pairs with intersection * 100 >= percent * union; between the two sides only, if sides are given."""
    m = len(ids)
    sizes = np.array([len(s) for s in sets], np.int64)
    owner = np.repeat(np.arange(m), sizes)
    unique, token, seen = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rank = np.empty(len(unique), np.int64)
    rank[np.lexsort((unique, seen))] = np.arange(len(unique))
    order = np.lexsort((rank[token], owner))
    token, first = token[order], np.cumsum(sizes) - sizes
    place = np.arange(len(token)) - first[owner]
    prefix = sizes - (-(-percent * sizes // 100)) + 1
    use = (place < prefix[owner]) & (seen[token] > 1)
    t, d, p = rank[token[use]], owner[use], place[use]
    by = np.lexsort((d, t))
    t, d, p = t[by], d[by], p[by]
    cuts = np.append(np.flatnonzero(np.append(True, t[1:] != t[:-1])), len(t)) if len(t) else np.zeros(1, np.int64)
    group = np.arange(m)
    sides = np.zeros(m, np.int64) if side is None else np.array(side)
    checked = np.zeros((m, m), bool)
    mark = np.zeros(len(unique), bool)
    out = []
    for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        if hi - lo < 2:
            continue
        docs, places = d[lo:hi], p[lo:hi]
        for k in range(len(docs) - 1):
            x, others = docs[k], docs[k + 1:]
            need = -(-percent * (sizes[x] + sizes[others]) // (100 + percent))
            room = 1 + np.minimum(sizes[x] - places[k], sizes[others] - places[k + 1:]) - 1 + np.minimum(places[k], places[k + 1:])
            todo = others[(group[others] != group[x]) & ~checked[x, others] & (room >= need)]
            if side is not None:
                todo = todo[sides[todo] != sides[x]]
            if not len(todo):
                continue
            checked[x, todo] = checked[todo, x] = True
            mine = token[first[x]:first[x] + sizes[x]]
            mark[mine] = True
            where = np.concatenate([token[first[y]:first[y] + sizes[y]] for y in todo])
            common = np.add.reduceat(mark[where].astype(np.int64), np.cumsum(sizes[todo]) - sizes[todo])
            mark[mine] = False
            for y in todo[100 * common >= percent * (sizes[x] + sizes[todo] - common)]:
                if group[y] != group[x]:
                    group[group == group[y]] = group[x]
                    out.append((ids[x], ids[y]))
    return out


def links(docs: DataFrame, classes: DataFrame, blocks: DataFrame, k: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """a, b: confirmed links that span every component of every block."""
    inside = classes.join(blocks.select("node", F.col("component").alias("block")), "node").select("node", "rep", "tkey", "n", "block")
    sums = inside.groupBy("block").agg(F.greatest(
        F.ceil(F.count("*") / TILE), F.ceil(F.sum("n") / TILE_SHINGLES), F.least(F.lit(SPREAD), F.ceil(F.count("*") / SPREAD_ROWS))).cast("int").alias("tiles"))
    tile = F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int")
    members = inside.join(sums, "block").withColumn("tile", tile).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))) \
        .select("node", "rep", "tkey", "block", "tile", F.least("tile", "other").alias("ta"), F.greatest("tile", "other").alias("tb"))
    texts = docs.select(F.col(id_col).cast("long").alias("rep"), row_key(text_col).alias("tkey"), F.col(text_col).cast("string").alias("t"))
    grouped = members.join(texts, ["rep", "tkey"]).repartition("block", "ta", "tb").sortWithinPartitions("block", "ta", "tb", "node") \
        .select("block", "ta", "tb", F.col("node").alias("rep"), "tile", "t")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, ids, sets, side = None, [], [], []

        def close() -> pa.RecordBatch:
            found = confirm(ids, sets, side if at[1] != at[2] else None, percent) if len(ids) > 1 else []
            return pa.RecordBatch.from_pydict({"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())})

        for batch in batches:
            for part in slices(batch, "t"):
                row, h = shingle_sets(Texts.of(part.column("t")), k)
                bounds = np.searchsorted(row, np.arange(part.num_rows + 1))
                keys = zip(*(part.column(c).to_pylist() for c in ("block", "ta", "tb", "rep", "tile")), strict=True)
                for r, (block, ta, tb, rep, tile) in enumerate(keys):
                    if (block, ta, tb) != at:
                        if at is not None:
                            yield close()
                        at, ids, sets, side = (block, ta, tb), [], [], []
                    if not ids or ids[-1] != rep:   # rows repeated in full
                        ids.append(rep)
                        sets.append(h[bounds[r]:bounds[r + 1]].copy())
                        side.append(tile)
        if at is not None:
            yield close()

    return grouped.mapInArrow(rows, "a long, b long")


def judged(docs: DataFrame, shingle: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """i, tkey, n of every row, and `first`, the smallest (i, tkey) of its component (null for empty sets and null ids).

    A class of equal sets is a node of its own, so texts under one id stay apart. Rows and classes that share a key with many
    others meet their label by key and part."""
    rows = written(sketches(docs, shingle, id_col, text_col).withColumn("part", (F.monotonically_increasing_id() % PARTS).cast("int")), "sketches")
    classes = written(rows.filter("n > 0 and i is not null").groupBy("n", "d1", "d2").agg(
        F.min(F.struct("i", "tkey")).alias("rep"), F.first("sig").alias("sig"))
        .select("n", "d1", "d2", F.col("rep.i").alias("rep"), F.col("rep.tkey").alias("tkey"), "sig", F.monotonically_increasing_id().alias("node")), "classes")
    blocks = components(chains(classes.select(F.col("node").alias("rep"), "n", "sig"), percent), name="blocks")
    found = components(links(docs, classes, blocks, shingle, percent, id_col, text_col), name="links")
    named = classes.join(found, "node", "left").select("n", "d1", "d2", "rep", "tkey", F.coalesce("component", "node").alias("component"),
                                                       F.pmod(F.xxhash64("node"), F.lit(PARTS)).cast("int").alias("part"))
    least = named.groupBy("component").agg(F.min(F.struct(F.col("rep").alias("i"), "tkey")).alias("first"))
    label = labelled(named, least, ["component"], "part").select("n", "d1", "d2", "first")
    out = labelled(rows.select("i", "tkey", "n", "d1", "d2", "part"), label, ["n", "d1", "d2"], "part")
    return out.select("i", "tkey", "n", F.when(F.col("i").isNotNull(), F.col("first")).alias("first"))


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_shingles, component_id, kept of every row."""
    component = F.coalesce("first.i", "i")
    return judged(docs, shingle, percent, id_col, text_col).select(
        F.col("i").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), component.eqNullSafe(F.col("i")).alias("kept"))


def keep_one(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component with all its columns. A document is an id with a text: another text under the same id is
    another document, and rows alike in both are one, the first by content."""
    names = fresh(docs, "i", "tkey", "k")
    found = judged(docs, shingle, percent, id_col, text_col).filter("first <> struct(i, tkey)")
    gone = found.select(F.col("i").alias(names["i"]), F.col("tkey").alias(names["tkey"])).distinct()
    keyed = docs.withColumn(names["i"], F.col(id_col).cast("long")).withColumn(names["tkey"], row_key(text_col))
    left = keyed.join(gone, [names["i"], names["tkey"]], "left_anti")
    first = Window.partitionBy(names["i"], names["tkey"]).orderBy(row_key(*docs.columns))
    known = left.filter(F.col(names["i"]).isNotNull()).withColumn(names["k"], F.row_number().over(first)).filter(F.col(names["k"]) == 1)
    return known.select(*docs.columns).unionByName(left.filter(F.col(names["i"]).isNull()).select(*docs.columns))
