"""Registered text and dataset jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridspark.catalog.registry import job
from gridspark.constants import THEMES
from gridspark.functions import timeconv as T
from gridspark.operators import sampling
from gridspark.plans import answers as A
from gridspark.plans import bulletins as N
from gridspark.plans import datasets as D
from gridspark.plans import prices as P

# ---------------------------------------------------------------- bulletins
# The SQL side reads bulletins line by line with a running section number; the library splits whole texts at marks.
_SECTION = r"^\.([A-Za-z][A-Za-z0-9 /&,''()+-]{1,70}?)\.\.\.(.*)$"
_LINES = f"""
    lines AS (SELECT doc_id, i, line, regexp_matches(line, '{_SECTION}') AS is_head, trim(line, ' \t\r\f') IN ('&&', '$$') AS is_end
              FROM (SELECT doc_id, unnest(string_split(raw_text, chr(10))) AS line, generate_subscripts(string_split(raw_text, chr(10)), 1) AS i FROM bulletins)),
    num AS (SELECT *, sum((is_head OR is_end)::INT) OVER (PARTITION BY doc_id ORDER BY i) AS sec FROM lines),
    heads AS (SELECT doc_id, sec, upper(trim(regexp_replace(regexp_replace(regexp_replace(regexp_extract(line, '{_SECTION}', 1), '\\(.*?\\)', ' ', 'g'), '/.*$', ' '), '\\s+', ' ', 'g'), ' .-')) AS name,
                     regexp_extract(line, '{_SECTION}', 2) AS rest FROM num WHERE is_head),
    bodies AS (SELECT h.doc_id, h.sec, h.name, regexp_replace(h.rest || chr(10) || coalesce(string_agg(regexp_replace(n.line, '\\s+$', ''), chr(10) ORDER BY n.i), ''), '^\\s+|\\s+$', '', 'g') AS body
               FROM heads h LEFT JOIN num n ON n.doc_id = h.doc_id AND n.sec = h.sec AND NOT n.is_head GROUP BY h.doc_id, h.sec, h.name, h.rest),
    secs AS (SELECT doc_id, name, min(sec) AS first_sec, string_agg(body, chr(10) || chr(10) ORDER BY sec) AS body FROM bodies WHERE length(body) > 0 GROUP BY 1, 2)"""


@job("x01_split_sections", "doc_id:l name digest",
     f"WITH {_LINES} SELECT doc_id, name, md5(body) AS digest FROM secs")
def _(v):
    s = F.explode(N.sections("raw_text")).alias("s")
    return v.bulletins.select("doc_id", s).select("doc_id", "s.name", F.md5("s.body").alias("digest"))


@job("x02_reasoning_text", "doc_id:l digest",
     f"""WITH {_LINES}, k AS (SELECT *, regexp_matches(name, '^(PREAMBLE|KEY MESSAGE|UPDATE|SYNOPSIS|OVERVIEW|NEAR TERM|SHORT TERM|DISCUSSION|MESOSCALE)')
                AND NOT regexp_matches(name, 'AVIATION|MARINE|FIRE|POINT TEMPS|WATCHES|CLIMATE') AS kept FROM secs),
         u AS (SELECT *, bool_or(kept) OVER (PARTITION BY doc_id) AS any_kept FROM k)
         SELECT doc_id, md5(string_agg('.' || name || '...' || chr(10) || body, chr(10) || chr(10) ORDER BY first_sec)) AS digest
         FROM u WHERE CASE WHEN any_kept THEN kept ELSE name LIKE 'LONG TERM%' END GROUP BY 1""")
def _(v):
    return v.bulletins.select("doc_id", F.md5(N.reasoning_text(N.sections("raw_text"))).alias("digest"))


def _parsed(v):
    rows = v.bulletins.select("doc_id", F.col("raw_text").alias("raw"), F.trunc("issued_utc", "MM").cast("timestamp_ntz").alias("win_start"),
                              F.add_months(F.trunc("issued_utc", "MM"), 1).cast("timestamp_ntz").alias("win_end"), F.col("issued_utc").alias("true_issued"))
    return N.parse_products(N.split_products(rows))


@job("x03_preamble", "doc_id:l preamble",
     "SELECT doc_id, 'Quiet weather with little change.' AS preamble FROM bulletins")
def _(v):
    first = F.get("sections", F.lit(0))
    return _parsed(v).select("doc_id", F.when(first["name"] == "PREAMBLE", first["body"]).alias("preamble"))


@job("x04_product_records", "doc_id:l office wmo_header issued_utc:t issue_line_utc:t n_sections:i raw_digest",
     f"""WITH {_LINES}, n AS (SELECT doc_id, count(*) AS n FROM secs GROUP BY 1)
         SELECT doc_id, substr(split_part(raw_text, chr(10), 1), 9, 3) AS office, split_part(raw_text, chr(10), 1) AS wmo_header, issued_utc,
                issued_utc AS issue_line_utc, n + 1 AS n_sections, md5(raw_text) AS raw_digest FROM bulletins JOIN n USING (doc_id)""")
def _(v):
    out = N.build_archive(_parsed(v), "doc_id")
    return out.withColumns({"n_sections": F.size("sections"), "raw_digest": F.md5("raw_text")})


_CLEAN = r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace({t},
    '(?m)^\s*\d{{3,4}}\s+[AP]M\s+[A-Z]{{3,4}}\s+\w{{3}}\s+\w{{3}}\s+\d{{1,2}}\s+\d{{4}}\s*$', '', 'g'),
    '(?im)/\s*Issued[^/]*/|^\s*(Issued|Updated) at .*$', '', 'g'),
    '\b\d{{3,4}}\s+[AP]M\s+[A-Z]{{3,4}}\s+(Mon|Tue|Wed|Thu|Fri|Sat|Sun)\s+[A-Z][a-z]{{2}}\s+\d{{1,2}}(\s+\d{{4}})?', '', 'g'),
    '\b20[12]\d\b', '', 'g')"""
SQL_CLEANED = "regexp_replace(regexp_replace(regexp_replace(" + _CLEAN.format(t="raw_text") + r", '[ \t]+', ' ', 'g'), '\n\s*\n+', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')"


@job("x05_clean_text_cut", "doc_id:l chars:i digest",
     f"""WITH c AS (SELECT doc_id, {SQL_CLEANED} AS t FROM bulletins),
         d AS (SELECT doc_id, CASE WHEN length(t) > 1800 THEN regexp_replace(substr(t, 1, 1800), '(?s) [^ ]*$', '') || ' [...]' ELSE t END AS t FROM c)
         SELECT doc_id, length(t) AS chars, md5(t) AS digest FROM d""")
def _(v):
    t = N.clean_text("raw_text", 1800)
    return v.bulletins.select("doc_id", F.length(t).alias("chars"), F.md5(t).alias("digest"))


@job("x05_clean_text", "doc_id:l chars:i digest",
     f"WITH c AS (SELECT doc_id, {SQL_CLEANED} AS t FROM bulletins) SELECT doc_id, length(t) AS chars, md5(t) AS digest FROM c")
def _(v):
    t = N.clean_text("raw_text")
    return v.bulletins.select("doc_id", F.length(t).alias("chars"), F.md5(t).alias("digest"))


@job("x06_prompt_text", "doc_id:l office chars:i has_long:b")
def _(v):
    shown = T.let(N.prompt_text("reasoning_text", "sections"), lambda t: F.struct(
        F.length(t).alias("chars"), t.contains(".LONG TERM...").alias("has_long")))
    return _parsed(v).select("doc_id", "office", shown.alias("t")).select("doc_id", "office", "t.chars", "t.has_long")


_theme_cols = " ".join(f"theme_{k}:b" for k in THEMES)


@job("x07_theme_flags", f"doc_id:l {_theme_cols}",
     "SELECT doc_id, " + ", ".join(f"regexp_matches(lower(raw_text), '{p}') AS theme_{k}" for k, p in THEMES.items()) + " FROM bulletins")
def _(v):
    return v.bulletins.select("doc_id", *[c.alias(n) for n, c in N.theme_flags("raw_text").items()])


# ---------------------------------------------------------------- answers
def _completions(v):
    """One completion per sample: reasoning, drafts, the query, sometimes unfinished or untagged."""
    e = F.col("event_id")
    query = F.concat(F.lit("SELECT "), F.floor("value").cast("string"), F.when(e % 2 == 0, "  FROM\n t").otherwise(" from t"),
                     F.col("user_id").cast("string"), F.when(e % 3 == 0, ";").otherwise(""))
    block = F.concat(F.lit("```sql\n"), query, F.lit("\n```"))
    text = (F.when(e % 7 == 0, F.concat(F.lit("<think>```sql\nSELECT 0\n```</think>Here:\n"), block))
            .when(e % 7 == 1, F.concat(F.lit("draft\n```sql\nSELECT 0\n```\n</think_fast>Answer\n"), block))
            .when(e % 7 == 2, F.concat(F.lit("<think>never closed "), block)).when(e % 7 == 3, F.concat(F.lit("```\n"), query, F.lit("\n```")))
            .when(e % 7 == 4, F.concat(F.lit("```sql\nSELECT 1\n```\nand\n"), F.replace(block, F.lit("```sql"), F.lit("``` SQL"))))
            .otherwise(block))
    return v.events.select(e.alias("sample_idx"), text.alias("completion"))


_QUERY = """SELECT event_id AS sample_idx, CASE WHEN event_id % 7 IN (2, 3) THEN NULL ELSE 'SELECT ' || CAST(floor(value) AS BIGINT)
    || CASE WHEN event_id % 2 = 0 THEN '  FROM' || chr(10) || ' t' ELSE ' from t' END || user_id || CASE WHEN event_id % 3 = 0 THEN ';' ELSE '' END END AS query FROM events"""


@job("x08_extract_query", "sample_idx:l query", _QUERY)
def _(v):
    return _completions(v).select("sample_idx", A.extract_query("completion").alias("query"))


@job("x09_normalized_queries", "query_key copies:l",
     f"SELECT lower(regexp_replace(regexp_replace(query, ';+$', ''), '\\s+', ' ', 'g')) AS query_key, count(*) AS copies FROM ({_QUERY}) WHERE query IS NOT NULL GROUP BY 1")
def _(v):
    q = _completions(v).select(A.extract_query("completion").alias("query")).filter("query IS NOT NULL")
    return q.groupBy(A.normalize_query("query").alias("query_key")).agg(F.count("*").alias("copies"))


@job("x10_reworded_questions", "event_id:l body tail kept:b",
     """SELECT event_id, 'What was the price of HB_' || upper(event_type) || ' on 2024-01-' || lpad(CAST(event_id % 28 + 1 AS VARCHAR), 2, '0') || ' above $' || user_id || '?' AS body,
               'Answer in $/MWh, rounded to 2 decimals.' AS tail, event_id % 4 <> 0 AS kept FROM events""")
def _(v):
    e = F.col("event_id")
    point = F.concat(F.lit("HB_"), F.upper("event_type"))
    date = F.concat(F.lit("2024-01-"), F.lpad((e % 28 + 1).cast("string"), 2, "0"))
    q = F.concat(F.lit("What was the price of "), point, F.lit(" on "), date, F.lit(" above $"), F.col("user_id").cast("string"),
                 F.lit("? Answer in $/MWh, rounded to 2 decimals."))
    again = F.concat(F.lit("Beyond $"), F.when(e % 4 == 0, F.col("user_id") + 1).otherwise(F.col("user_id")).cast("string"),
                     F.lit("? tell me what "), point, F.lit(" cost on "), date)
    body, tail = A.question_parts("q")
    return (v.events.select("event_id", q.alias("q"), again.alias("again")).withColumns({"body": body, "tail": tail})
            .withColumn("kept", A.tokens_kept("body", "again")))


@job("x12_parse_scale", "event_id:l scale:4",
     """SELECT event_id, CASE WHEN event_id % 6 IN (0, 1, 2) AND value - 5 > 0 THEN least(greatest(round(value - 5, 2), 0.25), 4.0) END AS scale FROM events""")
def _(v):
    e, n = F.col("event_id"), F.format_string("%.2f", F.col("value") - 5)
    text = (F.when(e % 6 == 0, F.concat(F.lit('{"scale": '), n, F.lit("}")))
            .when(e % 6 == 1, F.concat(F.lit('```json\n{"scale": "'), n, F.lit('"}\n```')))
            .when(e % 6 == 2, F.concat(F.lit('I think {"scale": '), F.when(F.col("value") > 5, "+").otherwise(""), n, F.lit("} fits")))
            .when(e % 6 == 3, F.concat(F.lit('{"scale": '), n, F.lit("}}"))).when(e % 6 == 4, '{"scale": true}').otherwise("nope"))
    return v.events.select("event_id", A.parse_scale(text).alias("scale"))


@job("x13_last_replies", "conv_id:l turn:l trace_id logged_reward:2 digest",
     """SELECT conv_id, turn, 't' || turn AS trace_id, conv_id % 3 AS logged_reward,
               md5(CASE WHEN role = 'assistant' THEN regexp_replace(coalesce(text, ''), '^\\s+|\\s+$', '', 'g') ELSE 'before' END) AS digest
        FROM conversations""")
def _(v):
    # one small episode per turn: an earlier reply, the turn itself, and a reply that was not sampled
    def node(role, content, sampled=True):
        role = F.lit(role) if isinstance(role, str) else role
        return F.struct(F.lit(sampled).alias("sampled"), F.struct(role.alias("role"), content.alias("content")).alias("message"))

    nodes = F.array(node("assistant", F.lit("before")), node(F.col("role"), F.col("text")), node("assistant", F.lit("later"), False))
    trace = F.struct(F.concat(F.lit("t"), "turn").alias("id"), (F.col("conv_id") % 3).cast("double").alias("reward"), nodes.alias("nodes"))
    rows = v.table("conversations").select("conv_id", "turn", F.to_json(F.struct(F.array(trace).alias("traces"))).alias("episode"))
    return A.last_replies(rows, "episode").withColumn("digest", F.md5("reply"))


@job("x13_last_turns", "conv_id:l turn:l digest",
     """SELECT conv_id, max(turn) AS turn, md5(regexp_replace(arg_max(text, turn), '^\\s+|\\s+$', '', 'g')) AS digest FROM conversations WHERE role = 'assistant' GROUP BY 1""")
def _(v):
    return A.last_turns(v.table("conversations")).withColumn("digest", F.md5("reply"))


# ---------------------------------------------------------------- task sets
_TASKS = """SELECT template_id || '-' || substr(sha1(params), 1, 10) AS task_id, template_id, params, answer, CASE WHEN y = 2023 THEN 'train' ELSE 'test_in_template' END AS split, difficulty FROM (
    SELECT 'rt_avg_day' AS template_id, '{"operating_date":"' || strftime(operating_date, '%Y-%m-%d') || '","point":"' || point || '"}' AS params,
           count(*)::VARCHAR AS answer, year(operating_date) AS y, 1 AS difficulty FROM iv15 GROUP BY point, operating_date
    UNION ALL SELECT 'count_da_negative_month', '{"month":"' || month || '","point":"' || point || '"}', count(*)::VARCHAR, min(year(operating_date)), 2
    FROM iv60 WHERE price < 0 GROUP BY point, month)"""


def _tasks(v):
    from gridspark.operators.reshape import stack_all
    day = P.interval_counts(v.iv15).withColumn("y", F.year("operating_date"))
    a = D.task_rows(day, "rt_avg_day", ["point", "operating_date"], "intervals").withColumn("difficulty", F.lit(1))
    b = D.task_rows(P.negative_hours(v.iv60), "count_da_negative_month", ["point", "month"], "hours").withColumn("difficulty", F.lit(2))
    split = F.when(F.get_json_object("params", "$.operating_date").startswith("2023") | F.get_json_object("params", "$.month").startswith("2023"), "train")
    return stack_all([a, b]).withColumn("split", F.coalesce(split, F.lit("test_in_template")))


@job("c05_task_ids", "task_id template_id params answer split", _TASKS)
def _(v):
    return _tasks(v)


@job("c05_picked_tasks", "task_id template_id split",
     f"SELECT * FROM ({_TASKS}) QUALIFY row_number() OVER (PARTITION BY template_id, split ORDER BY md5('s1-' || task_id)) <= 7")
def _(v):
    return D.pick_tasks(_tasks(v), 7, "s1", by=["template_id", "split"])


@job("c06_held_out_ids", "template_id",
     """WITH t AS (SELECT DISTINCT template_id FROM samples) SELECT template_id FROM t
        QUALIFY row_number() OVER (ORDER BY md5('h-' || template_id)) <= (SELECT greatest(1, round(0.2 * count(*))) FROM t)""")
def _(v):
    return sampling.hold_out(v.samples, "template_id", 0.2, "h")


@job("c07_task_summary", "split tasks:l templates:l difficulty_1:l difficulty_2:l difficulty_3:l",
     f"""SELECT split, count(*) AS tasks, count(DISTINCT template_id) AS templates, count(*) FILTER (WHERE difficulty = 1) AS difficulty_1,
            count(*) FILTER (WHERE difficulty = 2) AS difficulty_2, count(*) FILTER (WHERE difficulty = 3) AS difficulty_3 FROM ({_TASKS}) GROUP BY 1""")
def _(v):
    return D.summarize_tasks(_tasks(v))


@job("w11_round_robin", "task_id template_id",
     """WITH t AS (SELECT DISTINCT task_id, template_id FROM samples), r AS (SELECT *, row_number() OVER (PARTITION BY template_id ORDER BY task_id) AS rn FROM t)
        SELECT task_id, template_id FROM r ORDER BY rn, template_id LIMIT 55""")
def _(v):
    return sampling.round_robin(v.samples.select("task_id", "template_id").distinct(), "template_id", "task_id", 55)


_RES = f"SELECT s.*, q.query FROM samples s JOIN ({_QUERY}) q USING (sample_idx)"
_N1 = f"""SELECT task_id, sample_idx, query FROM (
    SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY sample_idx) AS rn FROM (
        SELECT *, row_number() OVER (PARTITION BY task_id, lower(regexp_replace(regexp_replace(query, ';+$', ''), '\\s+', ' ', 'g')) ORDER BY sample_idx) AS dup
        FROM ({_RES}) WHERE outcome = 'correct' AND query IS NOT NULL) WHERE dup = 1) WHERE rn <= 2"""


def _results(v):
    return v.samples.join(_completions(v), "sample_idx")


def _task_list(v):
    return v.samples.groupBy("task_id").agg(F.min("template_id").alias("template_id"), F.lit("How much?").alias("question"))


@job("n01_chat_rows", "task_id sample_idx:l query", _N1)
def _(v):
    return D.correct_examples(_results(v), _task_list(v))


@job("w12_capped_per_key", "task_id n:l", f"SELECT task_id, count(*) AS n FROM ({_N1}) GROUP BY 1")
def _(v):
    rows = D.correct_examples(_results(v), _task_list(v))
    return D.chat_rows(rows, _task_list(v), "Answer with one query.").groupBy("task_id").agg(F.count("*").alias("n"))


@job("n01_coverage", "task_id covered:b",
     f"SELECT DISTINCT s.task_id, s.task_id IN (SELECT task_id FROM ({_N1})) AS covered FROM samples s")
def _(v):
    r = _results(v)
    return D.coverage(r, D.correct_examples(r, _task_list(v)))


_N2 = """WITH t AS (SELECT DISTINCT task_id FROM samples), r AS (SELECT task_id, avg((outcome = 'correct')::INT) AS p FROM samples GROUP BY 1),
    k AS (SELECT t.task_id, CASE WHEN p IS NULL THEN 'unseen' WHEN p = 0 THEN 'never' WHEN p < 1 THEN 'mixed'
              WHEN CAST('0x' || substr(md5('keep-' || t.task_id), 1, 8) AS BIGINT) / 4294967296.0 < 0.5 THEN 'always_kept' ELSE 'always_dropped' END AS kind
          FROM t LEFT JOIN r USING (task_id))
    SELECT task_id, kind, CASE kind WHEN 'mixed' THEN 3 WHEN 'always_dropped' THEN 0 ELSE 1 END AS copies FROM k"""


def _weights(v):
    return D.prompt_weights(v.samples.select("task_id").distinct(), v.samples, keep_fraction=0.5)


@job("n02_prompt_weights", "task_id kind copies:i", _N2)
def _(v):
    return _weights(v)


@job("n02_weighted_prompts", "kind rows:l", f"SELECT kind, sum(copies) AS rows FROM ({_N2}) WHERE copies > 0 GROUP BY 1")
def _(v):
    return D.weighted_prompts(_weights(v)).groupBy("kind").agg(F.count("*").alias("rows"))


@job("n03_anchored_targets", "id target",
     """SELECT id, '{"hours":[' || string_agg('{"he":' || hour_ending || ',"p10":' || CAST(round_even(p10, 0) AS BIGINT) || ',"p50":' || CAST(round_even(p50, 0) AS BIGINT)
               || ',"p90":' || CAST(round_even(p90, 0) AS BIGINT) || '}', ',' ORDER BY hour_ending) || ']}' AS target FROM quant WHERE run = 'clim' GROUP BY 1""")
def _(v):
    return D.anchored_targets(v.clim_run)


@job("n03_jittered_targets", "id width_factor:4 median_shift:3 target")
def _(v):
    return D.anchored_targets(v.clim_run, width_sd=0.2, shift_sd=0.1)


@job("n04_example_tasks", "id zone hours:a labels:i",
     """SELECT id, zone, list(CAST(hour_ending AS VARCHAR) ORDER BY hour_ending) FILTER (WHERE hour_ending < 20) AS hours, count(*) FILTER (WHERE hour_ending < 20) AS labels
        FROM quant WHERE run = 'clim' AND zone IN ('A', 'R') GROUP BY 1, 2 HAVING count(*) FILTER (WHERE hour_ending < 20) > 0""")
def _(v):
    he = F.col("hour_ending").cast("string")
    rows = v.clim_run.groupBy("id", "zone").agg(
        F.map_from_entries(F.collect_list(F.struct(he, F.struct("p10", "p50", "p90")))).alias("baseline"),
        F.map_from_entries(F.collect_list(F.struct(he, "y"))).alias("actual_error"),
        F.array_sort(F.collect_list(F.when(F.col("hour_ending") < 20, F.col("hour_ending")))).alias("hours")).filter(F.size("hours") > 0)
    return D.example_tasks(rows, zones=["A", "R"]).withColumn("labels", F.size("actual_error"))
