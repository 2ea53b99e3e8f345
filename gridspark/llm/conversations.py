"""Conversation structure repair by a rank-convergence parallel Viterbi.

A conversation's turns are edited at least cost so that its roles read: perhaps system, then user, assistant in turn, ended by
assistant; or nothing. Among the cheapest edit strings the ASCII-least wins. The search has four states (nothing yet, after
system, after user, after assistant); the cost to go from each is a vector of four, a turn is a min-plus step on it.

1. Turns are put in order by a range sort over (conversation, turn, role, digest of text), so a long conversation lies over many
   tasks, and are written as chunks of at most `CHUNK` turns. A turn is a duplicate unless its position is the least of its
   (conversation, role, text), found by an aggregate and joined back by chunk; from here on a turn is one byte.
2. Every chunk runs backward at once. The last chunk of a conversation starts from the true vector, the others from a
   speculative one. Where a chunk's start vector differs from what its predecessor assumed by more than a constant, the
   predecessor runs again with it; fix-up passes repeat until nothing differs. Vectors are kept less their least entry.
3. Stitched vectors drive the tracing: in each state the first letter whose cost is the cost to go. Chunks are traced from every
   entry state at once to see where they lead; the entry states follow along the chunks of a conversation, four small numbers
   each; then each chunk is traced once.
4. Repaired lines are made per chunk, next to its texts, and hashed. A conversation in one chunk is hashed there; the lines of
   a longer one are hashed in order, as SHA-256 wants, by one task that streams finished lines and holds one chunk.

Since the vectors less their least entry are few, steps and choices are looked up in a worker's table.

Defined cases: a null role or text counts as one space, a null id is a conversation of its own and a null turn comes first; equal
turns are ordered by role, then by the text's digest, copies side by side; other roles than system, user and assistant
are told by their first letter; empty and very long texts are turns like any other; repeated rows are duplicates; no
rows after the damage: zeros, an empty audit; other columns are ignored; empty tables give no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from gridspark.llm.common import drop_written, row_key, written

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
CHUNK, CHUNK_BYTES = 1024, 1 << 20
#: Where a letter leads from (nothing, after system, after user, after assistant); -1: not allowed.
_AFTER = {"s": (1, -1, -1, -1), "u": (2, 2, -1, 2), "a": (-1, -1, 3, -1)}
_NEXT = (2, 2, 3, 2)                     # an inserted or reroled turn is what the state asks for
_ENDS = (0, 2 * INSERT, INSERT, 0)       # cost to go when no turn is left
_BLANK = re.compile(r"[\x20\x09-\x0D]*\Z")
_BROKEN = re.compile(r"[^.!?\x20\x09-\x0D][\x20\x09-\x0D]*\Z")
_MUST_GO, _BROKEN_FLAG = 16, 8


def damaged(rows: DataFrame) -> DataFrame:
    """The turns after the planted damage, which the crc32 of `conv_id:turn` decides."""
    def text(c: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), F.lit(" "))

    kind = F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn")).cast("binary")) % 20
    t = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(text("text"), "[.!?]", "")).otherwise(text("text"))
    role = F.when(kind == 4, "user").otherwise(text("role"))
    out = rows.select("conv_id", "turn", role.alias("role"), t.alias("text"), kind.alias("kind")).filter("kind <> 0")
    return out.withColumn("copy", F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))) \
        .select("conv_id", "turn", "role", "text")


# --- the search: one byte a turn, vectors of four

def codes(roles: list[str], blank: list[bool], again: np.ndarray, broken: list[bool]) -> bytes:
    """0 system, 1 user, 2 assistant, 3 other; with flags."""
    return bytes(("sua".find(r[0]) & 3 if r else 3) | (_MUST_GO if b or d else _BROKEN_FLAG if t else 0)
                 for r, b, d, t in zip(roles, blank, again, broken, strict=True))


@cache
def step(after: tuple[int, ...], code: int) -> tuple[tuple[int, ...], int]:
    """Cost to go before a turn from that after it, less its least entry, and that entry."""
    v = []
    for q in range(4):
        best = DELETE + after[q]
        if not code & _MUST_GO:
            extra = TRUNCATED if code & _BROKEN_FLAG else 0
            best = min(best, extra + REROLE + after[_NEXT[q]])
            to = _AFTER["sua"[code & 3]][q] if code & 3 < 3 else -1
            if to >= 0:
                best = min(best, extra + KEEP + after[to])
        v.append(best)
    v[2], v[3] = min(v[2], INSERT + v[3]), min(v[3], INSERT + v[2])
    v[0], v[1] = min(v[0], INSERT + v[2]), min(v[1], INSERT + v[2])
    least = min(v)
    return tuple(x - least for x in v), least


@cache
def choice(after: tuple[int, ...], code: int, q: int) -> tuple[str, int, int]:
    """The ASCII-least letters that stay cheapest over one turn from state q, where they lead and what they cost."""
    v, base = step(after, code)
    letters, cost = "", 0
    extra = TRUNCATED if code & _BROKEN_FLAG else 0
    while True:
        rest = v[q] + base
        if DELETE + after[q] == rest:
            return letters + "D", q, cost + DELETE
        if INSERT + v[_NEXT[q]] + base == rest:
            letters, q, cost = letters + "I", _NEXT[q], cost + INSERT
            continue
        to = _AFTER["sua"[code & 3]][q] if code & 3 < 3 else -1
        if to >= 0 and extra + KEEP + after[to] == rest:
            return letters + "K", to, cost + extra + KEEP
        return letters + "R", _NEXT[q], cost + extra + REROLE


def backward(turns: bytes, after: tuple[int, ...]) -> list[tuple[int, ...]]:
    """Vectors before each turn and, last, after all."""
    out = [after]
    for code in reversed(turns):
        after = step(after, code)[0]
        out.append(after)
    return out[::-1]


def trace(turns: bytes, after: tuple[int, ...], q: int, last: bool) -> tuple[list[str], int, int]:
    """Letters per turn (inserts stand before their turn's own letter; the last piece holds those after all), cost and exit state."""
    vectors, out, cost = backward(turns, after), [], 0
    for code, v in zip(turns, vectors[1:], strict=True):
        letters, q, c = choice(v, code, q)
        out.append(letters)
        cost += c
    if last:
        out.append("I" * (_ENDS[q] // INSERT))
        cost += _ENDS[q]
        q = 3 if out[-1] else q
    return out, cost, q


def lines(roles: list[str], texts: list[str], letters: list[str], q: int) -> list[str]:
    """The repaired `role:text` lines of a chunk entered in state q."""
    out = []
    for k, piece in enumerate(letters):
        for x in piece:
            if x == "D":
                continue
            if x == "K":
                q = _AFTER[roles[k][0]][q]
                out.append(f"{roles[k]}:{texts[k]}")
            else:
                q = _NEXT[q]
                out.append(("user:" if q == 2 else "assistant:") + (texts[k] if x == "R" else ""))
    return out


# --- the jobs

_CHUNK = ("ckey string, conv_id {0}, chunk long, roles array<string>, texts array<string>, digests array<binary>, blank array<boolean>, "
          "broken array<boolean>, first_turn long, last_turn long, turns long")


def chunks(rows: DataFrame) -> DataFrame:
    """Turns in order, in runs of one conversation; chunk numbers rise along the order."""
    kind = rows.schema["conv_id"].dataType.simpleString()
    keyed = rows.select(row_key("conv_id").alias("ckey"), "conv_id", F.col("turn").cast("long").alias("turn"), "role", "text",
                        F.md5(F.concat("role", F.lit("\0"), "text").cast("binary")).alias("digest"), F.monotonically_increasing_id().alias("row"))
    order = ["ckey", "turn", "role", "digest", "row"]
    ordered = keyed.repartitionByRange(*order).sortWithinPartitions(*order)
    schema = _CHUNK.format(kind)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 33
        target = None

        def fresh() -> dict[str, list]:
            return {c: [] for c in ("roles", "texts", "digests", "blank", "broken", "turn")}

        held, key, size, done = fresh(), None, 0, []

        def close() -> None:
            nonlocal number
            turns = [t for t in held["turn"] if t is not None]
            done.append({"ckey": key[0], "conv_id": key[1], "chunk": number, **{c: held[c] for c in ("roles", "texts", "digests", "blank", "broken")},
                         "first_turn": turns[0] if turns else None, "last_turn": turns[-1] if turns else None, "turns": len(set(turns))})
            number += 1

        def flush() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_pylist(done, target)
            done.clear()
            return batch

        total = 0
        for batch in batches:
            if target is None:
                target = pa.schema([("ckey", pa.string()), ("conv_id", batch.schema.field("conv_id").type), ("chunk", pa.int64()),
                                    ("roles", pa.list_(pa.string())), ("texts", pa.list_(pa.string())), ("digests", pa.list_(pa.binary())),
                                    ("blank", pa.list_(pa.bool_())), ("broken", pa.list_(pa.bool_())), ("first_turn", pa.int64()),
                                    ("last_turn", pa.int64()), ("turns", pa.int64())])
            for ckey, conv, turn, role, text, digest in zip(*(batch.column(c).to_pylist() for c in ("ckey", "conv_id", "turn", "role", "text", "digest")),
                                                            strict=True):
                if key is not None and (ckey != key[0] or len(held["turn"]) >= CHUNK or size >= CHUNK_BYTES):
                    close()
                    total += size
                    held, size = fresh(), 0
                    if total >= CHUNK_BYTES:
                        yield flush()
                        total = 0
                key = (ckey, conv)
                held["roles"].append(role)
                held["texts"].append(text)
                held["digests"].append(bytes.fromhex(digest))
                held["blank"].append(_BLANK.match(text) is not None)
                held["broken"].append(_BROKEN.search(text) is not None)
                held["turn"].append(turn)
                size += len(text)
        if key is not None:
            close()
        if done:
            yield flush()

    return ordered.select("ckey", "conv_id", "turn", "role", "text", "digest").mapInArrow(cut, schema)


def coded(whole: DataFrame) -> DataFrame:
    """ckey, chunk, codes and the chunk's counts; a turn is a duplicate unless it is the first of its role and text."""
    place = whole.select("ckey", "chunk", F.posexplode("digests").alias("at", "digest"))
    first = place.groupBy("ckey", "digest").agg(F.min(F.struct("chunk", "at")).alias("p"))
    firsts = first.groupBy(F.col("p.chunk").alias("chunk")).agg(F.collect_list("p.at").alias("firsts"))
    narrow = whole.select("ckey", "chunk", "roles", "blank", "broken", "first_turn", "last_turn", "turns").join(firsts, "chunk", "left")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                again = np.ones(len(r["roles"]), bool)
                again[r["firsts"] or []] = False
                again &= ~np.array(r["blank"], bool)
                broken = [t and not (b or d) for t, b, d in zip(r["broken"], r["blank"], again, strict=True)]
                code = codes(r["roles"], r["blank"], again, broken)
                pairs = sum((x & 3, y & 3) not in ((0, 1), (1, 2), (2, 1)) for x, y in zip(code, code[1:], strict=False))
                out.append({"ckey": r["ckey"], "chunk": r["chunk"], "codes": code, "blank": sum(r["blank"]), "duplicate": int(again.sum()),
                            "truncated": sum(broken), "illegal": pairs, "head": code[0] & 3, "tail": code[-1] & 3,
                            "first_turn": r["first_turn"], "last_turn": r["last_turn"], "turns": r["turns"]})
            if out:
                yield pa.RecordBatch.from_pylist(out, pa.schema([(c, pa.string() if c == "ckey" else pa.binary() if c == "codes" else pa.int64()) for c in out[0]]))

    return narrow.mapInArrow(rows, "ckey string, chunk long, codes binary, blank long, duplicate long, truncated long, illegal long, head long, tail long, "
                                   "first_turn long, last_turn long, turns long")


_FOUR = "array<int>"


def _start_vectors(rows: DataFrame) -> DataFrame:
    """start: the vector before the chunk, from `after`, the one behind it."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            start = [list(backward(c, tuple(v))[0]) for c, v in zip(batch.column("codes").to_pylist(), batch.column("after").to_pylist(), strict=True)]
            yield batch.drop_columns(["start"]).append_column("start", pa.array(start, pa.list_(pa.int32())))

    return rows.withColumn("start", F.lit(None).cast(_FOUR)).mapInArrow(run, "chunk long, next long, codes binary, after array<int>, start array<int>")


def stitched(rows: DataFrame) -> DataFrame:
    """chunk, after: every chunk's true vector behind it, less its least entry. `rows`: chunk, next (null: the last), codes."""
    ends = F.array(*map(F.lit, _ENDS)).cast(_FOUR)
    now = written(_start_vectors(rows.withColumn("after", ends)), "vectors")
    while True:
        behind = now.select(F.col("chunk").alias("next"), F.col("start").alias("true"))
        joined = now.join(behind, "next", "left")
        stale = F.col("true").isNotNull() & ~F.col("after").eqNullSafe(F.col("true"))
        seen = Observation()
        marked = joined.observe(seen, F.count(F.when(stale, 1)).alias("n")).withColumn("again", stale)
        part = written(marked.select("chunk", "next", "codes", F.when(F.col("again"), F.col("true")).otherwise(F.col("after")).alias("after"), "start", "again"),
                       "vectors")
        n = seen.get["n"]
        if not n:
            drop_written(now)
            return part.select("chunk", "after")
        fixed = _start_vectors(part.filter("again").select("chunk", "next", "codes", "after"))
        after = written(part.filter("not again").select("chunk", "next", "codes", "after", "start").unionByName(fixed), "vectors")
        drop_written(now)
        drop_written(part)
        now = after


def _exits(rows: DataFrame) -> DataFrame:
    """Where each chunk leads from each of the four states."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for code, v in zip(batch.column("codes").to_pylist(), batch.column("after").to_pylist(), strict=True):
                vectors, to = backward(code, tuple(v)), [0, 1, 2, 3]
                for c, x in zip(code, vectors[1:], strict=True):
                    to = [choice(x, c, q)[1] for q in to]
                out.append(to)
            yield pa.RecordBatch.from_arrays([batch.column("ckey"), batch.column("chunk"), pa.array(out, pa.list_(pa.int32()))], ["ckey", "chunk", "exits"])

    return rows.select("ckey", "chunk", "codes", "after").mapInArrow(run, "ckey string, chunk long, exits array<int>")


def _entries(exits: DataFrame) -> DataFrame:
    """chunk, entry: the state in which each chunk of a conversation is entered."""
    ordered = exits.groupBy("ckey").agg(F.sort_array(F.collect_list(F.struct("chunk", "exits"))).alias("x"))
    walk = F.aggregate("x", F.struct(F.lit(0).alias("q"), F.array().cast("array<struct<chunk:bigint,entry:int>>").alias("out")),
                       lambda s, c: F.struct(F.element_at(c["exits"], s["q"] + 1).alias("q"),
                                             F.concat(s["out"], F.array(F.struct(c["chunk"].alias("chunk"), s["q"].alias("entry")))).alias("out")),
                       lambda s: s["out"])
    return ordered.select(F.explode(walk).alias("e")).select("e.*")


def _traced(rows: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            letters, cost = [], []
            for code, v, q, last in zip(*(batch.column(c).to_pylist() for c in ("codes", "after", "entry", "last")), strict=True):
                found, c, _ = trace(code, tuple(v), q, last)
                letters.append(found)
                cost.append(c)
            yield pa.RecordBatch.from_arrays([batch.column("ckey"), batch.column("chunk"), pa.array(letters, pa.list_(pa.string())), pa.array(cost, pa.int64()),
                                              batch.column("entry"), batch.column("alone")], ["ckey", "chunk", "letters", "cost", "entry", "alone"])

    return rows.select("ckey", "chunk", "codes", "after", "entry", "last", "alone").mapInArrow(
        run, "ckey string, chunk long, letters array<string>, cost long, entry int, alone boolean")


def repaired_lines(whole: DataFrame, traced: DataFrame) -> DataFrame:
    """ckey, chunk and the repaired lines of every chunk, each line ended by a newline, and the hash of a conversation in one chunk."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blob, sha = [], []
            for roles, texts, letters, q, alone in zip(*(batch.column(c).to_pylist() for c in ("roles", "texts", "letters", "entry", "alone")), strict=True):
                raw = "".join(x + "\n" for x in lines(roles, texts, letters, q)).encode()
                blob.append(None if alone else raw)
                sha.append(hashlib.sha256(raw[:-1]).hexdigest() if alone else None)
            yield pa.RecordBatch.from_arrays([batch.column("ckey"), batch.column("chunk"), pa.array(blob, pa.binary()), pa.array(sha, pa.string())],
                                             ["ckey", "chunk", "lines", "sha"])

    both = whole.select("chunk", "roles", "texts").join(traced.select("ckey", "chunk", "letters", "entry", "alone"), "chunk")
    return both.select("ckey", "chunk", "roles", "texts", "letters", "entry", "alone").mapInArrow(run, "ckey string, chunk long, lines binary, sha string")


def _hashed(pieces: DataFrame) -> DataFrame:
    """ckey, sha of conversations over several chunks: their lines streamed in order."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state, ended = None, hashlib.sha256(), False

        def one() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"ckey": [at], "sha": [state.hexdigest()]})

        for batch in batches:
            for key, raw in zip(batch.column("ckey").to_pylist(), batch.column("lines").to_pylist(), strict=True):
                if key != at:
                    if at is not None:
                        yield one()
                    at, state, ended = key, hashlib.sha256(), False
                if raw:
                    if ended:
                        state.update(b"\n")
                    state.update(raw[:-1])
                    ended = True
        if at is not None:
            yield one()

    return pieces.repartition("ckey").sortWithinPartitions("ckey", "chunk").select("ckey", "lines").mapInArrow(run, "ckey string, sha string")


def repair(rows: DataFrame) -> dict[str, DataFrame]:
    """The repaired turns and what was done: `chunks` (texts), `traced` (letters, cost per chunk) and `report` (a row per conversation with turns)."""
    whole = written(chunks(rows), "chunks")
    code = written(coded(whole), "codes")
    order = Window.partitionBy("ckey").orderBy("chunk")     # a row per chunk, not per turn
    linked = written(code.withColumn("next", F.lead("chunk").over(order)).withColumn("before", F.lag(F.struct("tail", "last_turn")).over(order))
                     .withColumn("last", F.col("next").isNull())
                     .withColumn("alone", F.col("last") & F.col("before").isNull()), "linked")
    ends = F.array(*map(F.lit, _ENDS)).cast(_FOUR)
    long = linked.filter("not alone")
    vectors = stitched(long.select("chunk", "next", "codes"))
    known = long.join(vectors, "chunk")
    entered = known.join(_entries(_exits(known)), "chunk").select("ckey", "chunk", "codes", "after", "entry", "last", "alone")
    single = linked.filter("alone").select("ckey", "chunk", "codes", ends.alias("after"), F.lit(0).alias("entry"), "last", "alone")
    ready = single.unionByName(entered)
    traced = written(_traced(ready), "traced")
    pieces = written(repaired_lines(whole, traced), "lines")
    sha = pieces.filter("sha is not null").select("ckey", "sha").unionByName(_hashed(pieces.filter("sha is null")))

    pair = F.array(F.col("before.tail"), F.col("head"))
    legal = F.array_contains(F.array(*(F.array(F.lit(x).cast("long"), F.lit(y).cast("long")) for x, y in ((0, 1), (1, 2), (2, 1)))), pair)
    same = (F.col("before.last_turn") == F.col("first_turn")).cast("long")
    sums = linked.groupBy("ckey").agg(
        F.coalesce(F.max("last_turn") - F.min("first_turn") + 1 - (F.sum("turns") - F.coalesce(F.sum(same), F.lit(0))), F.lit(0)).alias("gaps"),
        *(F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated")),
        (F.sum("illegal") + F.sum(F.when(F.col("before").isNotNull() & ~legal, 1).otherwise(0))).alias("illegal"))
    audits = traced.groupBy("ckey").agg(F.sum("cost").alias("cost"), F.concat_ws("", F.transform(
        F.sort_array(F.collect_list(F.struct("chunk", F.array_join("letters", "").alias("part")))), lambda x: x["part"])).alias("audit"))
    return {"chunks": whole, "traced": traced, "report": sums.join(audits, "ckey").join(sha, "ckey")}


def assess(conversations: DataFrame) -> DataFrame:
    """A row per conversation id of the given table: what the damage did to it and its cheapest repair."""
    given = conversations.select("conv_id").distinct().withColumn("ckey", row_key("conv_id"))
    report = repair(damaged(conversations))["report"]
    out = given.join(report, "ckey", "left")
    zero = [F.coalesce(F.col(c), F.lit(0).cast("long")).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select("conv_id", *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha", F.sha2(F.lit(b""), 256)).alias("repaired_sha256"))
