"""WARC round trips, damage and the pipeline."""

import base64
import gzip
import hashlib
import random
import time

from conftest import SF
from llm.brute import contamination, gapless, near_components

from gridspark.llm import warc


def sha(payload):
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def test_round_trip(spark):
    rows = [(k, "http://x/ é\n", t, "u") for k, t in enumerate(["a", "b", "a", "", None, "WARC/1.1\r\nx: y\r\n\r\n", "\r\n\r\n", "é" * 3000, "z" * 300_000, "a\0b"])]
    rows += [(2, None, "a", "u"), (0, None, "a", "u"), (None, "http://y", "a", "u"), (None, "http://y", "only", "u"), (50, None, "\x1f\x8b\x08 WARC/1.0\r\n", "u")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest string")
    got = sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.round_trip(pages).collect()), key=str)
    first = {}
    for i, _, t, _ in rows:
        if i is not None:
            first[t or ""] = min(first.get(t or "", i), i)
    want = []
    for i, _, t, _ in rows:
        f = first.get(t or "")
        payload = (t or "").encode()
        want.append((i, len(payload), sha(payload), *(("response", None) if f is None or i == f else ("revisit", f))))
    assert got == sorted(want, key=str)
    assert warc.round_trip(pages.filter("false")).collect() == []
    long_ones = {r.record_type for r in warc.round_trip(pages.filter("html = 'a' and page_id is not null"), least=2).collect()}
    assert long_ones == {"response"}


def test_reading_many_records_takes_time_in_proportion():
    def seconds(n, spoil):
        parts = [warc.gzip_member(warc.record(k, f"http://x/{k}", b"page %d" % k * 9, None, sha(b"page %d" % k * 9))) for k in range(n)]
        for k in range(5, n, 50) if spoil else ():
            parts[k] = parts[k][:40] + b"\0" * 20 + parts[k][60:]
        data = b"".join(parts)
        t = time.process_time()
        found = list(warc.salvage(data))
        t = time.process_time() - t
        records = sum(kind == "record" for kind, *_ in found)
        assert records == n - len(range(5, n, 50)) * spoil and sum(b - a for _, a, b, _ in found) == len(data)
        return t

    for spoil in (False, True):
        assert seconds(50_000, spoil) < 12 * seconds(10_000, spoil) + 1


def test_files_are_standard_gzip(spark, tmp_path):
    pages = spark.createDataFrame([(k, f"http://x/{k}", "page %d " % k * 50) for k in range(30)], "page_id long, url string, html string").coalesce(1)
    warc.write_archive(pages, str(tmp_path / "a"), records=10)
    files = [f for f in (tmp_path / "a").iterdir() if f.name.startswith("part-")]
    assert len(files) == 3 and sum(gzip.decompress(f.read_bytes()).count(b"WARC/1.1\r\n") for f in files) == 30
    got = warc.read_archive(spark, str(tmp_path / "a")).collect()
    assert {r.kind for r in got} == {"record"} and len(got) == 30
    damaged = bytearray(files[0].read_bytes())
    damaged[damaged.find(warc.MAGIC, 1) + 40] ^= 0xFF
    files[0].write_bytes(damaged)
    for f in files[0].parent.glob(".*.crc"):
        f.unlink()
    got = warc.read_archive(spark, str(tmp_path / "a")).collect()
    assert sum(r.kind == "record" for r in got) == 29 and sum(r.kind == "gap" for r in got) == 1


def members(n=12):
    out = []
    for k in range(n):
        payload = (f"payload {k} " * (k + 1)).encode()
        out.append(warc.record(k, f"http://h/{k}", payload, None, sha(payload)))
    return out


def read(data):
    found = list(warc.salvage(data))
    return [warc._page(w[0]["warc-record-id"]) for kind, _, _, w in found if kind == "record"], [x[1:] for x in found if x[0] == "gap"]


def test_salvage_of_every_single_damage():
    plain = members()
    packed = [warc.gzip_member(m) for m in plain]
    for parts in (packed, plain):
        whole = b"".join(parts)
        starts = [sum(map(len, parts[:k])) for k in range(len(parts))]
        assert read(whole) == (list(range(len(parts))), [])
        rng = random.Random(4)
        for at in rng.sample(range(len(whole)), 150):
            hurt = bytearray(whole)
            hurt[at] ^= 1 << rng.randrange(8)
            owner = max(k for k, s in enumerate(starts) if s <= at)
            ids, gaps = read(bytes(hurt))
            assert set(range(len(parts))) - set(ids) <= {owner}, at
            if len(ids) < len(parts):   # a changed header value outside a gzip member cannot be noticed
                assert len(gaps) == 1 and gaps[0][0] == starts[owner] and gaps[0][1] <= (starts + [len(whole)])[owner + 1]
        ids, gaps = read(parts[0] + b"noise" * 9 + parts[1] + parts[2][:-20] + parts[3] + parts[4][:30])
        assert ids == [0, 1, 3] and len(gaps) == 3
    assert read(b"") == ([], []) and read(b"junk") == ([], [(0, 4, "no version line")])
    mixed = packed[0] + plain[1] + b"\x1f\x8b\x08" + packed[2]
    assert read(mixed)[0] == [0, 1, 2]


def test_salvage_inside_members_of_several_records():
    plain = members()
    n = len(plain)
    starts = [sum(map(len, plain[:k])) for k in range(n)]
    hurt = bytearray(b"".join(plain))
    hurt[starts[5] + len(plain[5]) - 8] ^= 1   # in the block of record 5, before packing
    ids, gaps = read(warc.gzip_member(bytes(hurt)))
    assert ids == [0, 1, 2, 3, 4, *range(6, n)] and len(gaps) == 1 and f"inflated bytes {starts[5]} to {starts[6]}" in gaps[0][2]
    rng = random.Random(9)
    long = [warc.record(k, "u", p, None, sha(p)) for k, p in ((k, rng.randbytes(3000)) for k in range(8))]
    packed, after = warc.gzip_member(b"".join(long)), warc.gzip_member(plain[9])
    for at in (len(packed) * 9 // 16, len(packed) * 13 // 16, len(packed) - 20):   # inside records 4, 6 and 7
        for rest in (b"", after):
            ids, gaps = read(packed[:at] + rest)
            assert ids == [*range(at // (len(packed) // 8)), *([9] if rest else [])] and gaps, at
    for at in range(3000, len(packed), 2500):
        flipped = bytearray(packed)
        flipped[at] ^= 0x10
        ids, gaps = read(bytes(flipped) + after)
        assert len(gaps) >= 1 and len(ids) == len(set(ids)) and ids[-1] == 9 and set(range(at // (len(packed) // 8) - 1)) <= set(ids), at
    ids, gaps = read(packed[:-1] + bytes([packed[-1] ^ 1]))   # a wrong length in the trailer
    assert ids == list(range(8)) and len(gaps) == 1
    ids, gaps = read(warc.gzip_member(plain[0] + plain[1]) + warc.gzip_member(plain[2] + plain[3][:-9]) + after)
    assert ids == [0, 1, 2, 9] and len(gaps) == 1


def test_pipeline_stage_by_stage(spark):
    import corpus_pipeline as cp
    from gridspark.llm.common import written
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = {}
    for name, stage in cp.STAGES[:-1]:
        docs = written(stage(spark, docs, SF), name)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        seen[name] = docs.collect()
    good = seen["quality"]
    want, _ = near_components([(r.doc_id, r.text) for r in good], 80)
    assert sorted(r.doc_id for r in seen["near_duplicates"]) == sorted(i for i, c in want.items() if i == c)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    dirty = contamination([(r.doc_id, r.text) for r in seen["near_duplicates"]], items)
    assert sorted(r.doc_id for r in seen["decontamination"]) == sorted(i for i, c in dirty.items() if not c[4])
    shards = cp.run(spark, SF).collect()
    assert len(shards) == len(seen["mixing"]) > 0
    assert all(gapless([r.slot for r in shards if r.shard == k]) for k in range(8))


def test_pipeline_of_an_empty_table(spark):
    import corpus_pipeline as cp
    docs = spark.read.parquet(f"{SF}/documents.parquet").filter("false")
    for _, stage in cp.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.count() == 0
