"""Text of model answers: query blocks, quantile and width answers, last replies, reworded questions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridspark.constants import MAX_ABS_VALUE, QUANTILES, SCALE_RANGE
from gridspark.functions.stats import clip
from gridspark.functions.timeconv import col, let
from gridspark.plans.bulletins import strip

# --- fixed values: patterns of answer text ---------------------------------------------------
THINK_BLOCK = r"(?is)<think>.*?</think>"
THINK_CLOSE = r"(?i)</(?:ifm\|)?think[a-z_]*>"
SQL_BLOCK = r"(?is)```[ \t]*sql[ \t]*\n(.*?)```"
FENCE = r"(?s)^\s*```(?:json)?\s*(.*?)\s*```\s*$"
LEADING_PLUS = r"([:\[,]\s*)\+(?=\d|\.\d)"
FORMAT_START = r"(?<=[.?] )(?:If tied|Answer|Give|Return|List)\b"
KEY_TOKENS = r"[A-Z]{2}_[A-Z]+|\$?\d[\d,.:\-]*"
NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
Q = list(QUANTILES)


# ---------------------------------------------------------------- query text
def extract_query(text: Column | str) -> Column:
    """Last non-empty fenced query after the last closed reasoning block; NULL without one, or when reasoning never ends."""
    t = F.coalesce(col(text), F.lit(""))
    after = F.element_at(F.split(t, THINK_CLOSE), -1)

    def last_block(body: Column) -> Column:
        blocks = F.filter(F.transform(F.regexp_extract_all(body, F.lit(SQL_BLOCK), 1), strip), lambda b: F.length(b) > 0)
        return F.when(~F.lower(body).contains("<think>"), F.try_element_at(blocks, F.lit(-1)))

    return let(F.regexp_replace(after, THINK_BLOCK, ""), last_block)


def normalize_query(sql: Column | str) -> Column:
    """Whitespace, case and closing semicolons do not make a query different."""
    return F.lower(F.regexp_replace(F.regexp_replace(strip(col(sql)), r";+$", ""), r"\s+", " "))


# ---------------------------------------------------------------- reworded questions
def question_parts(question: Column | str) -> tuple[Column, Column]:
    """Body and answer-format tail; the tail starts at the first format sentence."""
    q = col(question)
    body = F.element_at(F.split(q, FORMAT_START, 2), 1)
    has_tail = F.length(body) < F.length(q)
    tail = F.when(has_tail, F.substring(q, F.length(body) + 1, F.length(q))).otherwise("")
    return F.when(has_tail, F.regexp_replace(body, r"\s+$", "")).otherwise(q), tail


def tokens_kept(before: Column | str, after: Column | str) -> Column:
    """Every number, date and point name survives, as a multiset."""
    tokens = lambda c: F.array_sort(F.regexp_extract_all(col(c), F.lit(KEY_TOKENS), F.lit(0)))
    return tokens(before) == tokens(after)


# ---------------------------------------------------------------- quantile answers
def json_text(text: Column | str) -> Column:
    """The object of an answer: without fence or surrounding prose, and without plus signs before numbers."""
    def unfenced(t: Column) -> Column:
        inner = F.when(t.rlike(FENCE), F.regexp_extract(t, FENCE, 1)).otherwise(t)
        return F.regexp_replace(inner, LEADING_PLUS, "$1")

    def cut(plain: Column) -> Column:
        start, last = F.instr(plain, "{"), F.length(plain) - F.instr(F.reverse(plain), "}") + 1
        inner = F.when((start > 0) & plain.contains("}") & (last > start), F.substring(plain, start, last - start + 1))
        whole = plain.startswith("{") & plain.endswith("}")
        return F.when(whole, plain).when(~plain.startswith("["), inner)

    return let(let(strip(F.coalesce(col(text), F.lit(""))), unfenced), cut)


def balanced(json: Column) -> Column:
    """JSON readers accept a trailing brace; a strict reader does not. Braces inside strings do not count."""
    bare = F.regexp_replace(json, r'"(?:\\.|[^"\\])*+"', '""')
    count = lambda ch: F.length(bare) - F.length(F.replace(bare, F.lit(ch), F.lit("")))
    return (count("{") == count("}")) & (count("[") == count("]"))


def _finite(v: Column) -> Column:
    plain = F.trim(v)
    x = F.when(plain.rlike(NUMBER), plain.try_cast("double"))
    return F.when(F.abs(x) <= MAX_ABS_VALUE, x)


def parse_quantiles(df: DataFrame, text: str, hours: str) -> DataFrame:
    """Adds parse_ok, reordered and hours_map (he -> p10, p50, p90) for the hours listed in column `hours`.

    Leaves are read as strings, so quoted numbers count and everything else is checked here. Any bad row makes the
    whole answer invalid; hours not asked for are ignored."""
    js = json_text(text)
    schema = "struct<hours: array<struct<he: string, p10: string, p50: string, p90: string>>>"
    rows = F.from_json("_js", schema)["hours"]

    def numbers(r: Column) -> Column:
        he = _finite(r["he"]).cast("int")
        return let(F.array(*[_finite(r[q]) for q in Q]), lambda vals: F.struct(
            he.alias("he"), vals.alias("given"), F.array_sort(vals).alias("sorted")))

    out = df.withColumn("_js", js).withColumn("_rows", F.transform(rows, numbers))
    r = F.col("_rows")
    hes = F.transform(r, lambda x: x["he"])
    clean = ~F.exists(r, lambda x: x["he"].isNull() | F.exists(x["given"], lambda y: y.isNull()))
    no_bool = ~F.coalesce(F.col("_js").rlike(r":\s*(true|false)"), F.lit(True))
    ok = (F.col("_js").isNotNull() & balanced(F.col("_js")) & no_bool & r.isNotNull() & clean
          & (F.size(F.array_distinct(hes)) == F.size(hes)) & (F.size(F.array_except(F.col(hours).cast("array<int>"), hes)) == 0))
    ok = F.coalesce(ok, F.lit(False))
    swapped = F.exists(r, lambda x: x["given"] != x["sorted"])
    wanted = F.filter(r, lambda x: F.array_contains(F.col(hours).cast("array<int>"), x["he"]))
    entries = F.transform(wanted, lambda x: F.struct(x["he"].alias("he"), F.struct(
        *[x["sorted"][i].alias(q) for i, q in enumerate(Q)]).alias("q")))
    return out.withColumns({"parse_ok": ok, "reordered": ok & swapped}).withColumn(
        "hours_map", F.when(F.col("parse_ok"), F.map_from_entries(entries))).drop("_js", "_rows")


def parse_scale(text: Column | str) -> Column:
    """Width factor of an answer clipped to its range; NULL when it is not a positive number."""
    def factor(js: Column) -> Column:
        s = F.when(~js.rlike(r":\s*(true|false)") & balanced(js), _finite(F.get_json_object(js, "$.scale")))
        return let(s, lambda x: F.when(x > 0, clip(x, *SCALE_RANGE)))

    return let(json_text(text), factor)


# ---------------------------------------------------------------- replies
EPISODE = ("struct<traces: array<struct<id: string, reward: double, nodes: array<struct<sampled: boolean, "
           "message: struct<role: string, content: string>>>>>>")


def message_text(content: Column) -> Column:
    """A message's text, given as a string or as a list of parts."""
    parts = F.from_json(content, "array<struct<text: string>>")
    joined = F.array_join(F.transform(parts, lambda p: F.coalesce(p["text"], F.lit(""))), "")
    return F.when(F.ltrim(content).startswith("["), F.coalesce(joined, content)).otherwise(content)


def last_replies(episodes: DataFrame, json: str) -> DataFrame:
    """One row per trace with the text of its last sampled assistant message (empty when there is none)."""
    traces = episodes.select("*", F.explode(F.from_json(F.col(json), EPISODE)["traces"]).alias("_t")).drop(json)
    replies = F.filter(F.col("_t.nodes"), lambda n: n["sampled"] & (n["message"]["role"] == "assistant"))
    last = F.try_element_at(replies, F.lit(-1))["message"]["content"]
    return traces.select("*", F.col("_t.id").alias("trace_id"), F.col("_t.reward").alias("logged_reward"),
                         F.coalesce(strip(message_text(last)), F.lit("")).alias("reply")).drop("_t")


def last_turns(turns: DataFrame, role: str = "assistant") -> DataFrame:
    """Last turn of a role per conversation in flat form."""
    from gridspark.operators.ranking import latest_per_key
    return latest_per_key(turns.filter(F.col("role") == role), ["conv_id"], ["turn"]).select("conv_id", "turn", strip(F.col("text")).alias("reply"))
