"""Conversation repair, collocations and SimHash groups against plain Python."""

import random
import zlib
from functools import reduce

import numpy as np
import pytest
from conftest import SF
from llm.brute_new import collocations, fingerprint, repaired, simhash_groups

from gridspark.llm import conversations, phrases, simhash

TURNS = "conv_id long, turn long, role string, text string, ckey string, chunk int"
ODD = ["", None, " \n\t ", "a.", "a", "what?\n", "x" * 40_000 + "!", "Same text.", "Same text.", "é!", "...", "\x1c"]


def turns(spark, rows, parts=3):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], TURNS).repartition(parts)


def check_repair(df, rows):
    got = conversations.assess(df).collect()
    want = repaired(rows)
    assert {r.conv_id: tuple(r)[1:] for r in got} == want and len(got) == len(want)


def test_repair_given_table(spark):
    df = spark.read.parquet(f"{SF}/conversations.parquet")
    check_repair(df, [(r.conv_id, r.turn, r.role, r.text) for r in df.collect()])


@pytest.mark.parametrize("chunk", [1, 2, 7, 1024])
def test_repair_in_chunks(spark, monkeypatch, chunk):
    monkeypatch.setattr(conversations, "CHUNK", chunk)
    r = random.Random(chunk)
    roles = ["user", "assistant", "system", "tool", "", None, "User"]
    rows = [(c, t, r.choices(roles, (9, 9, 2, 1, 1, 1, 1))[0], r.choice(ODD) if r.random() < .3 else f"t{r.randrange(30)}.")
            for c in range(12) for t in range(r.randrange(1, 9))]
    rows += [(99, t, r.choices(roles, (9, 9, 1, 1, 1, 1, 1))[0], f"t{r.randrange(200)}" + r.choice([".", "", "?"])) for t in range(150)]
    rows += [(98, t, ("user", "assistant")[t % 2], f"line {t}.") for t in range(60)] + [(97, t, "user", "Again.") for t in range(40)]
    rows += [(None, None, None, None), (None, 4, "user", "hi."), (5, None, "assistant", "first."), (96, 10**12, "user", "far."), (96, -5, "user", "near.")]
    check_repair(turns(spark, rows), rows)


def test_repair_nothing_left(spark):
    dropped = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    rows = [(dropped, 0, "user", "x.")]
    check_repair(turns(spark, rows), rows)
    assert conversations.assess(turns(spark, [])).collect() == []


def test_repair_keeps_repeated_rows_apart(spark):
    rows = [(3, 1, "user", "Same.")] * 9 + [(3, 2, "assistant", "Same.")] * 4
    check_repair(turns(spark, rows), rows)


def test_stitching_reaches_the_true_vectors(spark):
    r = random.Random(5)
    codes = [bytes(r.choice([0, 1, 2, 3, 9, 10, 17]) for _ in range(r.choice([1, 2, 5]))) for _ in range(40)]
    rows = [(k, k + 1 if k < 39 else None, bytearray(c)) for k, c in enumerate(codes)]
    got = {x.chunk: tuple(x.after) for x in conversations.stitched(spark.createDataFrame(rows, "chunk long, next long, codes binary")).collect()}
    after = conversations._ENDS
    for k in range(39, -1, -1):
        assert got[k] == tuple(after), k
        after = conversations.backward(codes[k], tuple(after))[0]


def test_repaired_letters_and_lines(spark):
    rows = [(1, t, role, text) for t, (role, text) in enumerate([("user", "a."), ("user", "b."), ("assistant", "c.")])]
    out = conversations.repair(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    assert [x.letters for x in out["traced"].collect()] == [["K", "IK", "K", ""]]
    assert out["report"].first().cost == 3


def docs(spark, rows, parts=3):
    return spark.createDataFrame([(i, t, lang, "x", 1) for i, t, lang in rows], "doc_id long, text string, lang string, phrase string, n int").repartition(parts)


def phrase_rows(seed=1, n=200):
    r = random.Random(seed)
    words = [f"W{k}" if k % 3 else f"é{k}" for k in range(25)]
    rows = [(k, "".join(r.choice(words) + r.choice([" ", " ", "  ", "\t", ". ", ",", "\n"]) for _ in range(r.randrange(120))), r.choice(["a", "b", None, "und"]))
            for k in range(n)]
    return rows + [(900, "", "a"), (901, None, "a"), (902, " .\n", "empty"), (903, "one two three four. " * 500, "c"), (904, "x" * 50_000, None)] + [(905, "New York City", "d")] * 30


def got_phrases(df, **kw):
    return sorted((x.lang, x["rank"], x.phrase, x.a, x.l, x.r, x.n, x.score) for x in phrases.collocations(df, **kw).collect())


@pytest.mark.parametrize("shard", [1, 4000, 1 << 24])
def test_collocations(spark, monkeypatch, shard):
    monkeypatch.setattr(phrases, "SHARD_BYTES", shard)
    monkeypatch.setattr(phrases, "slices", lambda b, c: __import__("gridspark.llm.textvec", fromlist=["slices"]).slices(b, c, 3000))
    rows = phrase_rows()
    assert got_phrases(docs(spark, rows)) == collocations([(lang, t) for _, t, lang in rows])


def test_collocations_other_lengths_and_support(spark, monkeypatch):
    monkeypatch.setattr(phrases, "MIN_BITS", 7)      # a full bitmap only costs time
    monkeypatch.setattr(phrases, "MAX_BITS", 8)
    monkeypatch.setattr(phrases, "MAX_LANGS", 2)
    rows = phrase_rows(2, 80)
    want = collocations([(lang, t) for _, t, lang in rows], support=3, top=40, longest=4)
    assert got_phrases(docs(spark, rows), support=3, top=40, max_words=4) == want
    assert got_phrases(docs(spark, [])) == []


def test_scores_past_64_bits(spark, monkeypatch):
    big = 9 * 10**11
    freq = spark.createDataFrame([("a", "x", 1, big), ("a", "y", 1, big + 7), ("a", "x y", 2, big - 1)], "lang string, phrase string, k int, f long")
    n = spark.createDataFrame([("a", 10**13)], "lang string, n long")
    monkeypatch.setattr(phrases, "frequent", lambda *a: (freq, n))
    r = phrases.collocations(docs(spark, [])).first()
    assert r.score == 1_000_000 * (big - 1) ** 2 // (big * (big + 7))


def check_simhash(got, rows):
    prints = {i: fingerprint(t) for i, t, _ in rows}
    want = simhash_groups(prints)
    for r in got:
        assert (int(r.fingerprint, 16), r.component_id) == (prints[r.doc_id], want[r.doc_id]) and len(r.fingerprint) == 16
    assert len(got) == len(rows)


def near_rows():
    r = random.Random(3)
    base = [f"w{r.randrange(300)}" for _ in range(400)]
    rows = [(k, t, "en") for k, t in enumerate(["", None, " \n ", "a", "A b", "a B c d", "a b c d e", "é " * 4000])]
    for k in range(150):
        w = list(base)
        for _ in range(r.randrange(6)):
            w[r.randrange(len(w))] = f"n{r.randrange(10**6)}"
        rows.append((100 + k, " ".join(w), "en"))
    return rows + [(300 + k, "Copy  of A text\nhere", "en") for k in range(40)] + [(400 + k, " ".join(f"u{r.randrange(9**6)}" for _ in range(60)), "en") for k in range(60)]


@pytest.mark.parametrize(("group", "bits"), [(1 << 22, 12), (30_000, 3), (400, 0)])
def test_simhash(spark, monkeypatch, group, bits):
    monkeypatch.setattr(simhash, "GROUP", group)
    monkeypatch.setattr(simhash, "FIRST_BITS", bits)
    monkeypatch.setattr(simhash, "MEAN", 1 << 40)
    rows = near_rows()[::1 if group > 400 else 6]
    check_simhash(simhash.near_duplicates(docs(spark, rows)).collect(), rows)


def test_balls_find_every_pair_within_the_distance(spark):
    r = random.Random(8)
    prints, k = {}, 0
    for _ in range(25):
        x = r.getrandbits(64)
        for d in range(7):
            prints[k] = reduce(lambda v, b: v ^ (1 << b), r.sample(range(64), d), x)
            k += 1
    want = simhash_groups(prints)
    rows = [(i, int(np.uint64(p).view(np.int64))) for i, p in prints.items()]
    found = simhash.links(spark.createDataFrame(rows, "rep long, fp long")).collect()
    parent = {i: i for i in prints}
    for _ in range(20):
        for a, b in found:
            assert (prints[a] ^ prints[b]).bit_count() <= 8 and want[a] == want[b]
            parent[a] = parent[b] = min(parent[a], parent[b])
    assert parent == want


def test_simhash_special_rows(spark):
    t = " ".join(f"v{k}" for k in range(90))
    rows = [(3, t, "en"), (3, t, "en"), (5, t, "en"), (None, t, "en"), (7, None, "en"), (8, "", "en"), (8, t, "en")]
    got = sorted((str(r.doc_id), r.component_id) for r in simhash.near_duplicates(docs(spark, rows)).collect())
    assert got == sorted([("3", 3), ("3", 3), ("5", 3), ("None", None), ("7", 3), ("8", 3), ("8", 3)])
    assert simhash.near_duplicates(docs(spark, [])).collect() == []
    with pytest.raises(ValueError):
        simhash.near_duplicates(docs(spark, rows), distance=3)


def test_shard_reports_take_little_memory(spark):
    import tracemalloc

    import numpy as np

    from gridspark.llm.textvec import mix
    n = 1 << 20
    shard = phrases.Shard()
    h = mix(np.arange(n, dtype=np.uint64))
    shard.hash, shard.lang, shard.words = [h, h[: n // 4]], [np.zeros(n, np.int32), np.zeros(n // 4, np.int32)], {"a": n}
    tracemalloc.start()
    found = 0
    for r in shard.reports({"a": 100 * n}, 10, 16):
        ones, many = np.frombuffer(r["ones"], np.uint64), np.frombuffer(r["many"], np.uint64)
        assert set(r["counts"]) <= {0, 2} and len(r["counts"]) == 4 * len(many)
        found += len(ones) + 2 * len(many)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found == n + n // 4 and peak < 6 * 8 * n


def test_shard_reports_above_one_take_little_memory():
    import tracemalloc

    from gridspark.llm.textvec import mix
    n = 1 << 20
    shard = phrases.Shard()
    h = mix(np.arange(n, dtype=np.uint64))
    shard.hash, shard.lang, shard.words = [h, h[: n // 4]], [np.zeros(n, np.int32), np.zeros(n // 4, np.int32)], {"a": n}
    tracemalloc.start()
    ones, many, counts = 0, [], []
    for r in shard.reports({"a": 5 * n}, 10, 16):       # two occurrences are enough, and are as good as ten
        ones += len(r["ones"])
        many.append(np.frombuffer(r["many"], np.uint64))
        counts.append(np.frombuffer(r["counts"], "<u4"))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert ones == 0 and np.array_equal(np.concatenate(many), np.sort(h[: n // 4])) and set(np.concatenate(counts)) == {10}
    assert peak < 4 * 8 * n, peak / n
    code = np.zeros(n, np.int32)
    code[: n // 4] = 1
    shard.hash, shard.lang, shard.words = [h, h[: n // 4]], [code, code[: n // 4]], {"a": n, "b": n // 4}
    assert list(shard.reports({"a": 5 * n, "b": n}, 10, 16)) == []      # three of b are needed


def test_phrase_words_are_hashed_in_little_memory():
    import tracemalloc

    import pyarrow as pa

    from gridspark.llm.textvec import Texts
    batch = pa.RecordBatch.from_pydict({"t": [f"some words {k} " * 60 for k in range(6000)]})
    tracemalloc.start()
    rows = 0
    for part in phrases.slices(batch, "t"):
        rows += len(Texts.of(part.column("t")).words(phrases._WORD, lower=True).hash) // 180
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows == 6000 and peak < 60 << 20, peak


def test_a_task_merges_the_reports_of_one_bucket(spark):
    from pyspark.sql import functions as F
    texts = docs(spark, [(k, f"w{k % 700} x{k % 90} y{k % 41}", "a") for k in range(3000)]).select("lang", F.col("text").alias("t"))
    got = phrases.mine(texts, 1, None, {"a": 9000}, 10, 24).select("h", F.spark_partition_id().alias("p")).collect()
    assert len(got) >= 90 + 41 and len({r.p for r in got}) > 20
    assert all((r.h % (1 << 64)) * 24 >> 64 == r.p for r in got)


def test_phrases_are_counted_in_parts(spark, monkeypatch):
    rows = phrase_rows(4, 60)
    want = collocations([(lang, t) for _, t, lang in rows])
    monkeypatch.setattr(phrases, "HELD_BYTES", 500)
    assert got_phrases(docs(spark, rows)) == want
