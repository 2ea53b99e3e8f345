import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from gridspark.plans import answers as A
from gridspark.plans import bulletins as N
from gridspark.plans import datasets as D

HOURS = [16, 17, 18]


def texts(spark, *ts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(ts)], "i int, t string")


def value(spark, text, fn):
    return texts(spark, text).select(fn(F.col("t"))).first()[0]


PRODUCT = ("FXUS64 KHGX 092059\nAFDHGX\n\nArea Forecast Discussion\nOffice line\n359 PM CDT Tue Jul 9 2024\n\n"
           "...New FORECAST, MARINE...\n\nHigh pressure is in control tonight.\n\n&&\n\n.AVIATION...\nVFR.\n\n&&\n\n$$\n")


def parse(spark, raw, ws, we):
    df = spark.createDataFrame([(raw, ws, we)], "raw string, a string, b string").select(
        "raw", F.col("a").cast("timestamp_ntz").alias("win_start"), F.col("b").cast("timestamp_ntz").alias("win_end"))
    return N.parse_products(N.split_products(df)).orderBy("product_no").collect()


def test_preamble_product(spark):
    (r,) = parse(spark, PRODUCT, "2024-07-01", "2024-08-01")
    assert r.office == "HGX" and r.issued_utc == dt.datetime(2024, 7, 9, 20, 59) and r.issue_line_utc == dt.datetime(2024, 7, 9, 20, 59)
    assert r.reasoning_text == ".PREAMBLE...\nHigh pressure is in control tonight."
    assert [s.name for s in r.sections] == ["PREAMBLE", "AVIATION"]


def test_framing_order_and_rollover(spark):
    one = "FXUS64 KFWD {} \nAFDFWD\n\n239 PM CDT Sat Jul 1 2023\n\n.SHORT TERM... /NEW/\nStorms.\n\n.LONG TERM...\nHot.\n&&\n\n.PRELIMINARY POINT TEMPS...\nDFW\n$$\n"
    raw = "".join("\x01" + one.format(s) + "\x03" for s in ("011939", "011758", "011656 AAB"))
    rows = parse(spark, raw, "2023-07-01", "2023-07-02")
    assert [r.wmo_header[-6:] if r.bbb is None else r.bbb for r in rows] == ["011939", "011758", "AAB"]
    assert rows[0].reasoning_text == ".SHORT TERM...\n/NEW/\nStorms." and "\x01" not in rows[0].raw_text
    (late,) = parse(spark, one.format("312342"), "2025-09-01", "2025-10-01")
    assert late.issued_utc == dt.datetime(2025, 8, 31, 23, 42)
    assert len(parse(spark, one.format("011200") + one.format("011300"), "2023-07-01", "2023-07-02")) == 2
    assert parse(spark, "no header here", "2023-07-01", "2023-07-02") == []


@pytest.mark.parametrize("line,expected", [
    ("239 PM CDT Sat Jul 1 2023", dt.datetime(2023, 7, 1, 19, 39)), ("1156 AM CST Sun Jan 1 2023", dt.datetime(2023, 1, 1, 17, 56)),
    ("1205 AM CDT Sat Jul 1 2023", dt.datetime(2023, 7, 1, 5, 5)), ("9 PM UTC Sat Jul 1 2023", dt.datetime(2023, 7, 1, 21, 0)),
    ("National Weather Service", None), ("239 PM XXX Sat Jul 1 2023", None)])
def test_issue_lines(spark, line, expected):
    assert value(spark, line, N.issue_line_time) == expected


def test_sections_joined_and_filtered(spark):
    text = ".SHORT TERM (TONIGHT)...\na\n&&\n.AVIATION UPDATE...\nx\n.Short Term /Today/...rest\nb\n.KEY MESSAGE...\n\n$$\n.DISCUSSION...\nc"
    got = value(spark, text, N.sections)
    assert [(s.name, s.body) for s in got] == [("SHORT TERM", "a\n\nrest\nb"), ("AVIATION UPDATE", "x"), ("DISCUSSION", "c")]
    assert value(spark, ".LONG TERM...\nlt\n.AVIATION...\nx", lambda t: N.reasoning_text(N.sections(t))) == ".LONG TERM...\nlt"


def test_clean_text(spark):
    dirty = "Issued at 1205 PM CDT Sat Jul 1 2023\n239 PM CDT Sat Jul 1 2023\nHot   in 2023.\n\n\n\nUpdated at 5 PM\nBody kept."
    out = value(spark, dirty, N.clean_text)
    assert "2023" not in out and "Updated" not in out and "Body kept." in out and "\n\n\n" not in out
    assert value(spark, "word " * 100, lambda t: N.clean_text(t, 22)) == "word word word word [...]"
    assert value(spark, None, N.clean_text) == ""


@pytest.mark.parametrize("text,query", [
    ("<think>```sql\nSELECT 0\n```</think>Here:\n```sql\nSELECT 1\n```\nand\n```SQL\nSELECT 2;\n```", "SELECT 2;"),
    ("no code", None), ("<think>never closed ```sql\nSELECT 1\n```", None), ("```\nSELECT 1\n```", None),
    ("draft:\n```sql\nSELECT 0\n```\n</ifm|think_faster>Answer:\n```sql\nSELECT 3\n```", "SELECT 3"), ("r</ifm|think>no sql", None)])
def test_extract_query(spark, text, query):
    assert value(spark, text, A.extract_query) == query


def as_json(rows):
    return json.dumps({"hours": rows})


GOOD = [{"he": h, "p10": -1, "p50": 0, "p90": 1} for h in HOURS]
BODY = as_json(GOOD)


def verdicts(spark, cases):
    df = texts(spark, *cases).withColumn("hours", F.array(*[F.lit(h) for h in HOURS]))
    return A.parse_quantiles(df, "t", "hours").orderBy("i").collect()


def test_invalid_quantile_answers(spark):
    bad = ["", "not json", "{}", '{"hours": {}}', as_json([{"he": 16, "p10": 1, "p50": 2}]), as_json([{**GOOD[0], "p10": "a"}] + GOOD[1:]),
           BODY.replace("-1", "NaN", 1), as_json([{**GOOD[0], "p90": 1e12}] + GOOD[1:]), as_json([{**GOOD[0], "p10": True}] + GOOD[1:]),
           "[1, 2, 3]", as_json(GOOD[:2]), as_json(GOOD + [GOOD[0]]), BODY + "}", "```json\n" + BODY[:-1] + "\n```"]
    assert [r.parse_ok for r in verdicts(spark, bad)] == [False] * len(bad)


def test_accepted_quantile_answers(spark):
    rows = ",".join(f'{{"he":{h},"p10":-120,"p50":+35,"p90": +180.5}}' for h in HOURS)
    good = [BODY, f"```json\n{BODY}\n```", f"Here you go:\n{BODY}\nThanks", as_json(GOOD + [{"he": 19, "p10": 0, "p50": 0, "p90": 0}]),
            '{"hours":[' + ",".join(f'{{"he":"{h}","p10":"-5","p50":0,"p90":5.5}}' for h in HOURS) + "]}", '{"hours":[' + rows + "]}",
            as_json([{"he": h, "p10": 800, "p50": 0, "p90": -800} for h in HOURS])]
    out = verdicts(spark, good)
    assert [r.parse_ok for r in out] == [True] * len(good)
    assert [r.reordered for r in out] == [False] * 6 + [True]
    assert sorted(out[3].hours_map) == HOURS and out[5].hours_map[16].asDict() == {"p10": -120, "p50": 35, "p90": 180.5}
    assert out[6].hours_map[16].asDict() == {"p10": -800, "p50": 0, "p90": 800}


@pytest.mark.parametrize("text,scale", [('{"scale": 1.5}', 1.5), ('{"scale": 99}', 4.0), ('{"scale": 0.01}', 0.25), ('{"scale": 0}', None),
                                        ('{"scale": -1}', None), ("nope", None), ('{"scale": 1.5}}', None), ('{"scale": true}', None)])
def test_scale(spark, text, scale):
    assert value(spark, text, A.parse_scale) == scale


def test_questions(spark):
    q = "What was the price at HB_WEST on 2024-08-20? Answer in $/MWh, rounded to 2 decimals."
    body, tail = texts(spark, q).select(*A.question_parts("t")).first()
    assert body == "What was the price at HB_WEST on 2024-08-20?" and tail.startswith("Answer in")
    assert texts(spark, "No tail here").select(*A.question_parts("t")).first()[1] == ""
    same = lambda a, b: spark.range(1).select(A.tokens_kept(F.lit(a), F.lit(b))).first()[0]
    assert same("HB_WEST above $50", "Over $50 at HB_WEST") and not same("HB_WEST above $50", "HB_WEST above $51")


def test_last_reply_with_parts(spark):
    node = lambda role, content, sampled=True: {"sampled": sampled, "message": {"role": role, "content": content}}
    ep = {"traces": [{"id": "a", "reward": 1.0, "nodes": [node("assistant", "first"), node("user", "q"), node("assistant", " last ")]},
                     {"id": "b", "reward": 0.0, "nodes": [node("user", "q")]},
                     {"id": "c", "reward": 0.5, "nodes": [node("assistant", json.dumps([{"text": "x"}, {"text": "y"}])), node("assistant", "not sampled", False)]}]}
    rows = A.last_replies(texts(spark, json.dumps(ep)), "t").collect()
    assert {r.trace_id: r.reply for r in rows} == {"a": "last", "b": "", "c": "xy"}


def test_targets_echo_and_jitter(spark):
    base = spark.createDataFrame([("d", h, -10.4, 1.5, 12.0) for h in HOURS], "id string, hour_ending int, p10 double, p50 double, p90 double")
    plain = D.anchored_targets(base).first()
    assert plain.target == '{"hours":[' + ",".join(f'{{"he":{h},"p10":-10,"p50":2,"p90":12}}' for h in HOURS) + "]}"
    a, b = D.anchored_targets(base, 0.3, 0.2).first(), D.anchored_targets(base, 0.3, 0.2).first()
    assert a.target == b.target and a.width_factor != 1.0


def test_example_tasks_keep_listed_hours(spark):
    schema = "id string, zone string, hours array<int>, baseline map<string, struct<p10: double, p50: double, p90: double>>, actual_error map<string, double>"
    q = (0.0, 0.0, 0.0)
    rows = [("a", "z", [16, 17], {"16": q, "17": q, "18": q}, {"16": 1.0, "17": 2.0, "18": 3.0})]
    out = D.example_tasks(spark.createDataFrame(rows, schema)).first()
    assert out.actual_error == {16: 1.0, 17: 2.0}
    with pytest.raises(Exception, match="lack a label"):
        D.example_tasks(spark.createDataFrame([("a", "z", [16, 19], {"16": q}, {"16": 1.0})], schema)).collect()


def test_nothing_is_cut_by_length(spark):
    long_head = "FXUS64 KHGX 161134" + " " * 210
    late = "\n".join(f"note {k}" for k in range(8)) + "\nFXUS64 KEWX 161200\nbody two"
    raw = "\u0001" + long_head + "\nbody one\u0003\u0001" + late + "\u0003"
    got = [(r.wmo_header, r.body.splitlines()[-1]) for r in N.split_products(spark.createDataFrame([(raw,)], "raw string")).collect()]
    assert got == [("FXUS64 KHGX 161134", "body one"), ("FXUS64 KEWX 161200", "body two")]
    text = "word " * 1000
    assert value(spark, text, N.clean_text) == text.strip()


def test_rejected_pieces_are_rows_with_a_reason(spark):
    raw = "\u0001" + PRODUCT + "\u0003\u0001no header here\nbut text\u0003\u0001\n\u0003\u0001FXUS64 KHGX 251200\nbody\u0003"
    df = spark.createDataFrame([(raw, "2024-07-01", "2024-07-12")], "raw string, a string, b string").select(
        "raw", F.col("a").cast("timestamp_ntz").alias("win_start"), F.col("b").cast("timestamp_ntz").alias("win_end"))
    gone = [(r.wmo_header, r.reason) for r in N.rejected_products(df).orderBy("product_no").collect()]
    assert gone == [(None, "no header line"), ("FXUS64 KHGX 251200", "stamp outside the window")]
    assert [r.wmo_header for r in N.parse_products(N.split_products(df)).collect()] == ["FXUS64 KHGX 092059"]


def test_braces_inside_strings(spark):
    from gridspark.plans.answers import balanced
    rows = spark.createDataFrame([('{"a": "}{{", "b": [1]}',), ('{"a": "\\"}"}',), ('{"a": 1}}',), ('{"a": [1}',)], "j string")
    assert [r.ok for r in rows.select(balanced(F.col("j")).alias("ok")).collect()] == [True, True, False, False]


def test_texts_are_framed_and_cleaned_once(spark):
    from conftest import SF

    from gridspark.catalog.all_jobs import JOBS
    rows = spark.createDataFrame([("\n\nA\u0002FD\r\n FXUS64 KEWX 051200 \r\n.UPDATE...x\u0003\n",)], "raw string")
    framed = N.framed(rows)
    assert [tuple(r) for r in framed.select("wmo_header", "body").collect()] == [("FXUS64 KEWX 051200", " FXUS64 KEWX 051200 \n.UPDATE...x")]
    plan = framed._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(r"\r\n?") == 1 and plan.count(r"^\n+|\n+$") == 1
    prompts = JOBS["x06_prompt_text"].run(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert prompts.count(r"\b20[12]\d\b") == 2  # the reasoning and the long section
