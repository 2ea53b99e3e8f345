"""Secret scans with multipart linking: weak parts are reported only where complementary parts stand nearby.

Strong kinds (`assign`, `access`, `hex`) are always reported. Weak kinds are parts of a credential that mean little alone: an
identifier (`id`), a secret value (`key`) or an endpoint (`host`). Every span is an interval with a role and lies in all scope
cells (positions divided by the scope's width) from its start to its end. A weak part is joined by (text, role, cell) to the
cells that its interval, widened by the scope on both sides, reaches, and kept if a part of a role that completes it has at
most `SCOPE` characters between them, whatever the length of either. Cells are reduced to their first start and last end
before the join, so many parts in one place never make pairs; that is exact, as only the outermost two cells can hold parts
out of reach, and each of them on one side alone.

Only built-in functions run: matches and the text between them (`regexp_extract_all`, `split`) give the positions, in code
points. A cheap `rlike` guards each pattern. The spans are written once to the shared folder; texts are not shuffled.

Defined cases: a null or empty text has no spans; repeated rows are each reported, alike; nulls in the id are kept; spans
are ordered by start, then kind; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridspark.llm.common import join_spread, row_key, written

SCOPE = 256


def _any_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


def _named(*names: str) -> str:
    return "(?:" + "|".join(_any_case(n) for n in names) + ")"


_IS = "[\"']?\\x20*[:=]\\x20*[\"']?"
#: kind, role, pattern, least length of its group 1 (0: no group)
KINDS = [
    ("assign", "secret", _named("password", "passwd", "secret", "token", "api_?key") + _IS + "([A-Za-z0-9+/_.=-]+)", 6),
    ("access", "id", "AKIA[A-Z0-9]{16,}", 0),
    ("hex", "secret", "[0-9a-f]{24,}", 0),
    ("id", "id", _named("user_?name", "user_?id", "login", "client_?id", "account_?id", "access_?key_?id") + _IS + "([A-Za-z0-9@_.-]+)", 3),
    ("key", "secret", _named("pwd", "passphrase", "auth", "credentials?", "private_?key", "access_?key") + _IS + "([A-Za-z0-9+/_.=-]+)", 6),
    ("host", "endpoint", "[A-Za-z][A-Za-z0-9+.-]*://[A-Za-z0-9@_.:-]+", 0),
]
STRONG = ["assign", "access", "hex"]
#: what completes a weak kind
NEEDS = {"id": ["secret"], "key": ["id", "endpoint"], "host": ["secret"]}


def _spans(text: Column, pattern: str, least: int) -> Column:
    """array<struct<s, e>> of the matches, leftmost and without overlap."""
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    inner = F.regexp_extract_all(text, F.lit(pattern), F.lit(1)) if least else matches
    gaps = F.split(text, pattern, -1)
    steps = F.zip_with(F.arrays_zip(matches.alias("m"), inner.alias("g")), F.slice(gaps, F.lit(1), F.size(matches)),
                       lambda x, gap: F.struct(F.length(gap).alias("gap"), F.length(x["m"]).alias("n"),
                                               (F.length(x["g"]) >= least).alias("ok")))
    none = F.array().cast("array<struct<s:int,e:int>>")
    start = F.struct(F.lit(0).alias("at"), none.alias("out"))

    def step(acc: Column, x: Column) -> Column:
        s = acc["at"] + x["gap"]
        e = s + x["n"]
        span = F.array(F.struct(s.alias("s"), e.alias("e")))
        return F.struct(e.alias("at"), F.when(x["ok"], F.concat(acc["out"], span)).otherwise(acc["out"]).alias("out"))

    return F.when(text.rlike(pattern), F.aggregate(steps, start, step, lambda acc: acc["out"])).otherwise(none)


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(F.array_sort(spans), lambda x: F.concat_ws(":", x["kind"], x["s"], x["e"])), ",")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scope: int = SCOPE) -> DataFrame:
    """id, n_assign, n_access, n_hex, base_sha256, spans of every row."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    found = {f"k_{kind}": _spans(text, pattern, least) for kind, _, pattern, least in KINDS}
    rows = written(docs.select(F.col(id_col).alias("i"), row_key(text_col).alias("key"), *(c.alias(k) for k, c in found.items())), "spans")

    def tagged(kinds: list[str]) -> Column:
        rank = {kind: n for n, (kind, *_) in enumerate(KINDS)}
        role = {kind: r for kind, r, *_ in KINDS}

        def of(kind: str) -> Column:
            return F.transform(f"k_{kind}", lambda x: F.struct(x["s"].alias("s"), F.lit(rank[kind]).alias("rank"), x["e"].alias("e"),
                                                               F.lit(kind).alias("kind"), F.lit(role[kind]).alias("role")))

        return F.concat(*map(of, kinds))

    weak = [k for k in found if k.removeprefix("k_") in NEEDS]
    some_weak = F.greatest(*(F.size(k) for k in weak)) > 0
    parts = rows.filter(some_weak).select("key", F.explode(tagged([k for k, *_ in KINDS])).alias("x")).select("key", "x.*")
    def reached(low: Column, high: Column) -> Column:
        return F.explode(F.sequence(F.floor(low / scope), F.floor(high / scope)))

    cells = parts.distinct().withColumn("cell", reached(F.col("s"), F.col("e"))).groupBy("key", "role", "cell").agg(
        F.min("s").alias("low"), F.max("e").alias("high"))
    needs = F.create_map(*(y for k, roles in NEEDS.items() for y in (F.lit(k), F.array(*map(F.lit, roles)))))
    probes = parts.filter(F.col("kind").isin(*NEEDS)).distinct().select("key", "s", "rank", "e", "kind", F.explode(needs[F.col("kind")]).alias("role")) \
        .withColumn("cell", reached(F.col("s") - scope, F.col("e") + scope))
    near = (F.col("low") <= F.col("e") + scope) & (F.col("high") >= F.col("s") - scope)
    linked = probes.join(cells, ["key", "role", "cell"]).filter(near).select("key", "s", "rank", "e", "kind").distinct()
    linked = linked.groupBy("key").agg(F.collect_list(F.struct("s", "rank", "e", "kind")).alias("weak"))
    strong = F.transform(tagged(STRONG), lambda x: F.struct(x["s"], x["rank"], x["e"], x["kind"]))
    out = rows.select("i", "key", *(F.size(f"k_{k}").cast("long").alias(f"n_{k}") for k in STRONG), strong.alias("strong"))
    return join_spread(out, linked, "key").select(
        F.col("i").alias(id_col), "n_assign", "n_access", "n_hex", F.sha2(_listed(F.col("strong")).cast("binary"), 256).alias("base_sha256"),
        _listed(F.when(F.col("weak").isNull(), F.col("strong")).otherwise(F.concat("strong", "weak"))).alias("spans"))
