"""Decontamination, near-duplicates, mixing, shards and components against plain Python."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from conftest import SF
from llm.brute import SPACE, contamination, gapless, near_components
from pyspark.sql import functions as F

from gridspark.llm import decontam, lsh_forest, mixing, sharding
from gridspark.llm.common import components
from gridspark.llm.permute import permuted

ODD = ["", None, " \n\t ", "a", "A b", "a B c d", "one two three four five", "One TWO three four five"]


def words(n, seed):
    r = random.Random(seed)
    return [f"w{r.randrange(400)}" for _ in range(n)]


def variants(base, count, seed, edits=2):
    r = random.Random(seed)
    for k in range(count):
        w = list(base)
        for _ in range(r.randrange(edits + 1)):
            w[r.randrange(len(w))] = f"new{k}x{r.randrange(10**6)}"
        yield " ".join(w)


def near_rows():
    rows = list(enumerate(ODD))
    rows += [(100 + k, t) for k, t in enumerate(variants(words(150, 1), 300, 2, 4))]
    rows += [(500 + k, t) for k, t in enumerate(variants(words(60, 3), 60, 4, 3))]
    rows += [(700 + k, " ".join(words(80, 5) + words(60, 100 + k))) for k in range(60)]       # a shared passage only
    rows += [(900 + k, " ".join(words(40, 7)).upper() if k % 2 else " ".join(words(40, 7))) for k in range(40)]
    rows += [(1000 + k, " ".join(words(3, 200 + k % 3))) for k in range(9)]
    return rows


def check_near(got, rows):
    want, sizes = near_components(rows)
    for r in got:
        assert (r.n_shingles, r.component_id, r.kept) == (sizes[r.doc_id], want[r.doc_id], want[r.doc_id] == r.doc_id), r.doc_id


def test_near_duplicates(docs_of, sample):
    rows = near_rows() + [(5000 + i, t) for i, t, _ in sample]
    got = lsh_forest.near_duplicates(docs_of(rows)).collect()
    assert len(got) == len(rows)
    check_near(got, rows)


def test_near_duplicates_in_small_regions_and_tiles(docs_of, monkeypatch):
    for name, value in (("REGION", 8), ("TILE", 16), ("SPREAD_ROWS", 4)):
        monkeypatch.setattr(lsh_forest, name, value)
    rows = near_rows()
    check_near(lsh_forest.near_duplicates(docs_of(rows)).collect(), rows)


def test_near_duplicates_special_rows(docs_of, bare_docs):
    t = " ".join(words(50, 9))
    rows = [(3, t), (3, t), (5, t), (None, t), (None, None), (7, None), (8, None)]
    got = sorted((str(r.doc_id), r.component_id, r.kept) for r in lsh_forest.near_duplicates(docs_of(rows)).collect())
    assert got == sorted([("3", 3, True), ("3", 3, True), ("5", 3, False), ("None", None, True), ("None", None, True), ("7", 7, True), ("8", 8, True)])
    assert lsh_forest.near_duplicates(docs_of([])).collect() == []
    kept = lsh_forest.keep_one(bare_docs(rows)).collect()
    assert sorted(str(r.doc_id) for r in kept) == ["3", "7", "8", "None", "None"]


def test_keep_one_loses_no_text_of_a_repeated_id(bare_docs):
    a, b, c = (" ".join(words(50, k)) for k in (21, 22, 23))
    for rows, want in (([(1, a), (2, a), (2, b), (3, b)], [(1, a), (2, b)]),
                       ([(1, a), (1, b), (1, a)], [(1, a), (1, b)]),
                       ([(5, a), (5, b), (4, b), (6, c), (7, a), (7, c)], [(4, b), (5, a), (6, c)])):
        kept = lsh_forest.keep_one(bare_docs(rows).withColumnsRenamed({"source": "__i", "lang": "__tkey"}))
        assert sorted((r.doc_id, r.text) for r in kept.collect()) == sorted(want)


def test_components(spark):
    r = random.Random(1)
    pairs = [(k, k + 1) for k in range(40)] + [(100, 100 + k) for k in range(1, 60)] + [(r.randrange(300, 400), r.randrange(300, 400)) for _ in range(70)]
    got = {x.node: x.component for x in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    parent = {x: x for p in pairs for x in p}
    for _ in range(60):
        for a, b in pairs:
            parent[a] = parent[b] = min(parent[a], parent[b])
    linked = {x for a, b in pairs if a != b for x in (a, b)}
    assert got == {x: parent[x] for x in linked}


ITEMS = [("i1", " ".join(f"b{k}" for k in range(30))), ("i2", "Short item, six words in it"), ("i3", "two words"), ("i4", ""), ("i5", None), ("i1", "again b0 b1 b2"),
         ("i6", "rep rep rep rep rep rep rep rep rep rep rep rep"), ("i7", "x")]


def test_contamination(spark, docs_of, sample):
    benchmark = spark.createDataFrame(ITEMS, "item_id string, text string")
    b = [f"b{k}" for k in range(30)]
    rows = list(enumerate(ODD)) + [(20, "Z " + " ".join(b[3:13]) + " q"), (21, " ".join(b[3:12])), (22, " ".join(b).upper() + ". two, words"), (23, "short ITEM six words in it"),
                                   (24, "rep " * 25), (25, "rep " * 9), (26, " ".join(b[:15] + ["no"] + b[15:])), (27, "again b0 b1 b2"), (27, "again b0 b1 b2"), (None, "two words")]
    want = contamination(rows, ITEMS)
    got = decontam.contamination(docs_of(rows), benchmark).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == want[r.doc_id], r.doc_id
    clean = decontam.keep_clean(docs_of(rows), benchmark)
    assert Counter(r.doc_id for r in clean.collect()) == Counter(i for i, _ in rows if not want[i][4])
    assert decontam.contamination(docs_of([]), benchmark).collect() == []
    nothing = spark.createDataFrame([], "item_id string, text string")
    assert not any(r.contaminated for r in decontam.contamination(docs_of(rows), nothing).collect())
    real = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    docs = [(i, t) for i, t, _ in sample]
    want = contamination(docs, real)
    got = decontam.contamination(docs_of(docs), spark.createDataFrame(real, "item_id long, text string")).collect()
    assert {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got} == want and any(r.contaminated for r in got)


def test_contamination_with_a_full_bitmap(spark, docs_of):
    rows = [(1, " ".join(words(200, 1))), (2, " ".join(words(50, 2) + words(200, 1)[20:40]))]
    items = [("a", " ".join(words(200, 1)[20:40]))]
    got = decontam.contamination(docs_of(rows), spark.createDataFrame(items, "item_id string, text string"), bits=8).collect()
    assert {r.doc_id: r.n_hit for r in got} == {k: v[1] for k, v in contamination(rows, items).items()}


@pytest.mark.parametrize("n", [1, 2, 3, 5, 7, 16, 97, 1000])
def test_permutation_is_bijective(spark, n):
    from pyspark.sql import functions as F
    rows = spark.range(n).select(permuted(F.col("id"), F.lit(n).cast("long"), "k").alias("p")).collect()
    assert sorted(r.p for r in rows) == list(range(n))
    assert n < 90 or [r.p for r in rows] != list(range(n))


def test_shards(docs_of, sample):
    rows = [(i, t) for i, t, _ in sample] + [(None, None), (None, ""), (7, None), (7, "é"), (7, "é"), (7, "é")]
    got = sharding.shards(docs_of(rows)).collect()
    want = Counter((i, len((t or "").encode()) + 1, None if t is None else zlib.crc32(t.encode())) for i, t in rows)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == want
    per = defaultdict(list)
    for r in got:
        per[r.shard].append(r.slot)
        assert r.law == "rows" and r.grown_shard is None
    assert all(map(gapless, per.values())) and max(map(len, per.values())) - min(map(len, per.values())) <= 1
    again = sharding.shards(docs_of(rows[::-1])).collect()
    assert Counter(map(tuple, again)) == Counter(map(tuple, got))
    assert sharding.shards(docs_of([])).collect() == []


def test_runs_of_numbers_and_slots(docs_of, sample, monkeypatch):
    whole = mixing.mix(docs_of(sample)).collect()
    rows = [(7, "é")] * 50 + [(i, t) for i, t, _ in sample]
    want = Counter(map(tuple, sharding.shards(docs_of(rows)).collect()))
    monkeypatch.setattr(sharding, "RUN", 4)
    monkeypatch.setattr(mixing, "RUN", 4)
    assert Counter(map(tuple, sharding.shards(docs_of(rows)).collect())) == want
    assert Counter(map(tuple, mixing.mix(docs_of(sample)).collect())) == Counter(map(tuple, whole))


def water(sizes, weights=(3, 1, 2), share=1.5, most=2):
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    w = {s: weights[k % 3] for k, s in enumerate(order)}
    total, fixed = share * sum(sizes.values()), {}
    while True:
        free = [s for s in order if s not in fixed]
        left = total - sum(fixed.values())
        now = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        above = [s for s in free if now[s] > most * sizes[s]]
        if not above:
            return now | fixed
        fixed |= {s: most * sizes[s] for s in above}


def test_mix(docs_of, sample):
    rows = list(sample) + [(900 + k, t, s) for k, (t, s) in enumerate([(None, "src0"), ("a b c", None), ("", None), ("x y", ""), ("é x", "ä"), ("q", "a")])]
    rows += [(990, "same row twice", "src1")] * 2 + [(None, "no id here", "src2")]
    got = mixing.mix(docs_of(rows)).collect()
    assert len(got) == len(rows)
    sizes, taken = defaultdict(int), defaultdict(int)
    for i, t, s in rows:
        sizes[s] += len(SPACE.findall(t or ""))
    want = water(sizes)
    source = {i: s for i, _, s in rows}
    for r in got:
        s = source[r.doc_id]
        assert r.source_size == sizes[s] and abs(r.target - want[s]) < 1e-6 and 0 <= r.taken <= 2 * r.size
        taken[s] += r.taken
    assert all(taken[s] == int(want[s] + 0.5) for s in sizes)
    again = {(r.doc_id, r.size): r.taken for r in mixing.mix(docs_of(rows[::-1])).collect()}
    assert all(again[r.doc_id, r.size] == r.taken for r in got)
    assert mixing.mix(docs_of([])).collect() == []


@pytest.mark.parametrize(("block", "output_shards"), [(128, 64), (16, 5)])
def test_mix_by_output_shard_has_the_drawn_counts(docs_of, sample, block, output_shards):
    rows = [*sample, (900, None, "src0"), (901, "a b c", None)]
    got = mixing.mix(docs_of(rows), block=block, output_shards=output_shards).collect()
    source, sizes = {i: s for i, _, s in rows}, defaultdict(int)
    for _, t, s in rows:
        sizes[s] += len(SPACE.findall(t or ""))
    slots = defaultdict(Counter)
    for r in got:
        reads = [tuple(map(int, x.split(":"))) for x in r.reads.split(",") if x]
        assert sum(n for *_, n in reads) == r.taken and [x[1] for x in reads] == sorted({x[1] for x in reads})
        for shard, slot, n in reads:
            slots[source[r.doc_id]][shard, slot] += n
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None]
    for rank, s in enumerate(order):
        take = int(water(sizes)[s] + 0.5)
        passes, rest = divmod(take, sizes[s])
        n = passes * -(-sizes[s] // block) + -(-rest // block)
        drawn = np.random.Generator(np.random.PCG64([int.from_bytes(b"mix-1", "big"), rank])).multinomial(n, [1 / output_shards] * output_shards)
        shards = [shard for shard, _ in sorted(slots[s], key=lambda x: x[1])]
        assert shards == [k for k in range(output_shards) for _ in range(drawn[k])] and gapless([x[1] for x in slots[s]])
        assert sum(slots[s].values()) == take and max(slots[s].values()) <= block


def test_mixed_documents_hold_the_words_taken(bare_docs, sample):
    rows = [*sample, (900, None, "src0"), (901, "a b c", None)]
    docs = bare_docs(rows)
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    got = defaultdict(int)
    texts = {i: t for i, t, _ in rows}
    for r in out.collect():
        own = SPACE.findall(r.text)
        got[r.source] += len(own)
        assert own and not Counter(own) - Counter(SPACE.findall(texts[r.doc_id]))
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += len(SPACE.findall(t or ""))
    assert dict(got) == {s: int(v + 0.5) for s, v in water(sizes).items()}


def test_columns_may_have_the_names_of_helpers(spark, bare_docs, sample):
    from gridspark.llm import quality
    rows = [*sample[:60], (900, None, None), (901, "a b c", None), (902, "", "src0"), sample[0], (None, "x y", "src1")]
    docs, clash = bare_docs(rows), {"read": 1, "turn": 2, "uid": 3, "__uid": 4, "__read": 5, "__salt": 6, "__key": 7, "key": 8, "first": 9, "i": 10, "__i": 11, "part": 12}
    wide = docs.select("*", *(F.lit(v).alias(c) for c, v in clash.items()))
    benchmark = spark.read.parquet(f"{SF}/benchmark.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    for stage in (lambda d: quality.keep_good(d, labels), lambda d: lsh_forest.keep_one(d, percent=80), lambda d: decontam.keep_clean(d, benchmark),
                  mixing.mixed_documents):
        out = stage(wide)
        assert out.columns == wide.columns
        got = out.collect()
        assert all(r[c] == v for r in got for c, v in clash.items())
        assert Counter(tuple(r[c] for c in docs.columns) for r in got) == Counter(map(tuple, stage(docs).collect()))
