"""Bulletin text: framing, header times, sections, reasoning text, cleaning and as-of selection.

Everything about one product is an expression over its own row, so parsing a table of bulletins needs no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridspark.constants import THEMES, ZONE_ABBREV_OFFSET_HOURS
from gridspark.functions import timeconv as T
from gridspark.functions.timeconv import col, let
from gridspark.operators.asof import latest_before_cutoff
from gridspark.operators.reshape import distinct_content

# --- fixed values: line patterns of the bulletin format --------------------------------------
HEADER_LINE = r"^([A-Z]{4}\d{2}) (K[A-Z]{3}) (\d{2})(\d{2})(\d{2})(?: ([A-Z]{3}))?\s*$"
ISSUE_LINE = r"^(\d{1,4}) (AM|PM) ([A-Z]{3}) [A-Za-z]{3} ([A-Za-z]{3}) +(\d{1,2}) (\d{4})\s*$"
SECTION_LINE = r"^\.([A-Za-z][A-Za-z0-9 /&,'()+-]{1,70}?)\.\.\.(.*)$"
END_LINE = r"^[ \t\r\f]*(?:&&|\$\$)[ \t\r\f]*$"
HEADLINE = r"^\s*\.\.\..*\.\.\.\s*$"
REASONING = r"^(PREAMBLE|KEY MESSAGE|UPDATE|SYNOPSIS|OVERVIEW|NEAR TERM|SHORT TERM|DISCUSSION|MESOSCALE)"
NOT_REASONING = r"AVIATION|MARINE|FIRE|POINT TEMPS|WATCHES|CLIMATE"
DATE_LINE = r"(?m)^\s*\d{3,4}\s+[AP]M\s+[A-Z]{3,4}\s+\w{3}\s+\w{3}\s+\d{1,2}\s+\d{4}\s*$"
ISSUED_LINE = r"(?im)/\s*Issued[^/]*/|^\s*(Issued|Updated) at .*$"
STAMP = r"\b\d{3,4}\s+[AP]M\s+[A-Z]{3,4}\s+(Mon|Tue|Wed|Thu|Fri|Sat|Sun)\s+[A-Z][a-z]{2}\s+\d{1,2}(\s+\d{4})?"
YEAR = r"\b20[12]\d\b"

LINES = "(?md)"  # line anchors at \n only
FRAME, NAME_END = "\u0001", "\u0002"


BLANKS = " \t\n\r\f\u000b"


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(BLANKS))


# ---------------------------------------------------------------- framing
def framed(files: DataFrame, raw: str = "raw", is_piece: str | None = None) -> DataFrame:
    """One row per piece of a response file, framed by control characters or, without them, by header lines; a piece without
    a header line has a null `wmo_header` and its whole text as body. Rows where the column `is_piece` is true hold one piece
    of a framed file already.

    Header line and body are cut out before the explode, so later filters on the header never touch the text again. The text, its
    lines and the header's place are bound once: inside a generator nothing else keeps an expression from running once per use."""
    def marked(text: Column) -> Column:
        starts = F.regexp_replace(text, LINES + r"^(?=[A-Z]{4}\d{2} K[A-Z]{3} \d{6})", FRAME)
        whole = text.contains(FRAME) if is_piece is None else text.contains(FRAME) | F.col(is_piece)
        return F.when(whole, text).otherwise(starts)

    def cut(top: Column) -> Column:
        flags = F.transform(top, lambda s: strip(s).rlike(HEADER_LINE))
        return let(F.array_position(flags, F.lit(True)).cast("int"), lambda at: F.struct(
            F.when(at > 0, strip(F.get(top, at - 1))).alias("wmo_header"),
            F.array_join(F.slice(top, F.greatest(at, F.lit(1)), F.size(top)), "\n").alias("body")))

    def product(chunk: Column) -> Column:
        clear = F.replace(F.replace(chunk, F.lit(NAME_END), F.lit("")), F.lit("\u0003"), F.lit(""))
        return let(F.split(F.regexp_replace(clear, r"^\n+|\n+$", ""), "\n", -1), cut)

    framed = let(F.regexp_replace(F.col(raw), r"\r\n?", "\n"), marked)
    products = F.transform(F.split(framed, FRAME), product)
    rows = files.select("*", F.posexplode(products).alias("product_no", "_p")).drop(raw)
    return rows.select("*", "_p.wmo_header", "_p.body").drop("_p")


def split_products(files: DataFrame, raw: str = "raw") -> DataFrame:
    """The pieces that are products; `rejected_products` lists the others."""
    return framed(files, raw).filter(F.col("wmo_header").isNotNull())


def stamp(win_start: str = "win_start", win_end: str = "win_end") -> Column:
    """Issue time by the header's day of month, inside or near the file's window; null if it is too far off."""
    head = header_fields(F.col("wmo_header"))
    return T.resolve_day_stamp(head["day"], head["hour"], head["minute"], F.col(win_start), F.col(win_end))


def rejected_products(files: DataFrame, raw: str = "raw", win_start: str = "win_start", win_end: str = "win_end") -> DataFrame:
    """Pieces with text that give no record, each with a reason: nothing that was landed is lost without a row."""
    return rejected_pieces(framed(files, raw), win_start, win_end)


def rejected_pieces(pieces: DataFrame, win_start: str = "win_start", win_end: str = "win_end") -> DataFrame:
    reason = F.when(F.col("wmo_header").isNull(), F.when(strip(F.col("body")) != "", "no header line")) \
        .when(stamp(win_start, win_end).isNull(), "stamp outside the window")
    return pieces.withColumn("reason", reason).filter(F.col("reason").isNotNull())


def header_fields(line: Column) -> dict[str, Column]:
    part = lambda i: F.nullif(F.regexp_extract(line, HEADER_LINE, i), F.lit(""))
    return {"ttaaii": part(1), "station": part(2), "day": part(3), "hour": part(4), "minute": part(5), "bbb": part(6)}


def issue_line_time(line: Column) -> Column:
    """'239 PM CDT Sat Jul 1 2023' as an instant; NULL when the line is something else."""
    part = lambda i: F.regexp_extract(line, ISSUE_LINE, i)
    hhmm = part(1)
    long = F.length(hhmm) > 2
    hh = F.when(long, F.expr("0")).otherwise(F.lit(0))
    hh = F.when(long, F.left(hhmm, F.length(hhmm) - 2)).otherwise(hhmm).try_cast("int")
    mm = F.when(long, F.right(hhmm, F.lit(2))).otherwise("0").try_cast("int")
    offset = F.element_at(F.create_map(*[F.lit(x) for kv in ZONE_ABBREV_OFFSET_HOURS.items() for x in kv]),
                          F.nullif(part(3), F.lit("")))
    months = F.array(*[F.lit(m) for m in "JAN FEB MAR APR MAY JUN JUL AUG SEP OCT NOV DEC".split()])
    month = F.nullif(F.array_position(months, F.upper(part(4))), F.lit(0)).cast("int")
    local = F.try_make_timestamp_ntz(part(6).try_cast("int"), month, part(5).try_cast("int"),
                                     hh % 12 + F.when(part(2) == "PM", 12).otherwise(0), mm, F.lit(0))
    ok = line.rlike(ISSUE_LINE) & hh.between(1, 12) & mm.between(0, 59)
    return F.when(ok, local - T.hours(offset))


# ---------------------------------------------------------------- sections
def normalize_section_name(name: Column) -> Column:
    plain = F.regexp_replace(F.regexp_replace(name, r"\(.*?\)", " "), r"/.*$", " ")
    return F.upper(F.regexp_replace(F.regexp_replace(plain, r"\s+", " "), r"^[ .\-]+|[ .\-]+$", ""))


def sections(text: Column | str) -> Column:
    """array<struct<name, body>> in order of first appearance, repeated names joined by a blank line.

    Header and end lines are replaced by marks and the text is split at the marks: linear in its length."""
    marked = F.regexp_replace(col(text), LINES + SECTION_LINE, FRAME + "$1" + NAME_END + "$2")
    marked = F.regexp_replace(marked, LINES + END_LINE, FRAME)

    def part(p: Column) -> Column:
        body = F.regexp_replace(F.substring_index(p, NAME_END, -1), LINES + r"[ \t\r\f]+$", "")
        return F.struct(normalize_section_name(F.substring_index(p, NAME_END, 1)).alias("name"), strip(body).alias("body"))

    parts = F.transform(F.filter(F.split(marked, FRAME), lambda p: p.contains(NAME_END)), part)

    def add(done: Column, p: Column) -> Column:
        longer = F.transform(done, lambda d: F.struct(d["name"].alias("name"), F.when(
            d["name"] == p["name"], F.concat(d["body"], F.lit("\n\n"), p["body"])).otherwise(d["body"]).alias("body")))
        return (F.when(F.length(p["body"]) == 0, done).when(F.exists(done, lambda d: d["name"] == p["name"]), longer)
                .otherwise(F.concat(done, F.array(p))))

    empty = F.array().cast("array<struct<name: string, body: string>>")
    return F.aggregate(parts, empty, add)


def preamble(text: Column | str) -> Column:
    """Untitled text before the first section or end line, headline lines left out."""
    head = F.regexp_replace(col(text), LINES + r"(?:" + SECTION_LINE + "|" + END_LINE + ")", FRAME)
    lines = F.filter(F.split(F.substring_index(head, FRAME, 1), "\n"), lambda s: ~s.rlike(HEADLINE))
    return strip(F.array_join(F.transform(lines, lambda s: F.rtrim(s, F.lit(BLANKS))), "\n"))


def reasoning_text(secs: Column | str) -> Column:
    """Kept sections as titled text; only LONG TERM ones when nothing else qualifies."""
    def titled(use: Column) -> Column:
        return F.array_join(F.transform(use, lambda s: F.concat(F.lit("."), s["name"], F.lit("...\n"), s["body"])), "\n\n")

    def text(all_secs: Column) -> Column:
        kept = F.filter(all_secs, lambda s: s["name"].rlike(REASONING) & ~s["name"].rlike(NOT_REASONING))
        spare = F.filter(all_secs, lambda s: s["name"].startswith("LONG TERM"))
        return let(kept, lambda k: titled(F.when(F.size(k) > 0, k).otherwise(spare)))

    return let(col(secs), text)


def parse_products(products: DataFrame, win_start: str = "win_start", win_end: str = "win_end") -> DataFrame:
    """Full record per product: header, resolved issue time, issue line, sections, reasoning text."""
    head = header_fields(F.col("wmo_header"))
    rows = products.withColumns({
        "issued_utc": stamp(win_start, win_end),
        "office": F.substring(head["station"], 2, 3), "bbb": head["bbb"]}).filter(F.col("issued_utc").isNotNull())
    rows = rows.withColumn("_top", F.split("body", "\n", -1))
    near = F.transform(F.slice("_top", F.lit(2), F.size("_top")), lambda s: issue_line_time(strip(s)).isNotNull())
    rows = rows.withColumn("_issue_at", F.nullif(F.array_position(near, F.lit(True)), F.lit(0)).cast("int"))
    after = F.array_join(F.slice("_top", F.col("_issue_at") + 2, F.size("_top")), "\n")
    rows = rows.withColumns({"issue_line": strip(F.get("_top", F.col("_issue_at"))),
                             "_pre": F.when(F.col("_issue_at").isNotNull(), preamble(after)), "_secs": sections("body")})
    with_pre = F.concat(F.array(F.struct(F.lit("PREAMBLE").alias("name"), F.col("_pre").alias("body"))), F.col("_secs"))
    rows = rows.withColumn("sections", F.when(F.length("_pre") > 0, with_pre).otherwise(F.col("_secs")))
    return rows.withColumns({
        "issue_line_utc": issue_line_time(F.col("issue_line")), "raw_text": strip(F.col("body")),
        "reasoning_text": reasoning_text("sections")}).drop("_top", "_issue_at", "_pre", "_secs", "body")


def build_archive(parsed: DataFrame, row_id: str) -> DataFrame:
    """Parsed products with exact copies removed."""
    return distinct_content(parsed, ["office", "wmo_header", "raw_text"], row_id)


# ---------------------------------------------------------------- cleaning
def clean_text(text: Column | str, max_chars: int | None = None) -> Column:
    """Drop date stamps, issue lines and years, collapse blanks; cut at a word end only where a length is given."""
    t = F.coalesce(col(text), F.lit(""))
    for pattern in (DATE_LINE, ISSUED_LINE, STAMP, YEAR):
        t = F.regexp_replace(t, pattern, "")
    t = F.regexp_replace(t, r"[ \t]{2,}|\t", " ")  # a lone space stays, so most matches of [ \t]+ are spared
    t = strip(F.regexp_replace(t, r"\n\s*\n+", "\n\n"))
    if max_chars is None:
        return t

    def capped(whole: Column) -> Column:
        head = let(F.substring(whole, 1, max_chars), lambda c: F.when(
            c.contains(" "), F.regexp_replace(c, r"(?s) [^ ]*$", "")).otherwise(c))
        return F.when(F.length(whole) > max_chars, F.concat(head, F.lit(" [...]"))).otherwise(whole)

    return let(t, capped)


def prompt_text(reasoning: Column | str, secs: Column | str, max_chars: int | None = None, long_chars: int | None = None) -> Column:
    """Cleaned reasoning, followed by the first LONG section unless it is already there; cut only where lengths are given."""
    reasoning = col(reasoning)
    found = F.filter(col(secs), lambda s: F.upper(s["name"]).contains("LONG"))
    body = F.coalesce(F.get(found, F.lit(0))["body"], F.lit(""))
    extra = F.concat(F.lit("\n\n.LONG TERM...\n"), clean_text(body, long_chars))
    add = (F.length(body) > 0) & ~F.coalesce(reasoning, F.lit("")).contains(strip(body))
    return F.concat(clean_text(reasoning, max_chars), F.when(add, extra).otherwise(F.lit("")))


def theme_flags(text: Column | str) -> dict[str, Column]:
    lowered = F.lower(col(text))
    return {f"theme_{k}": lowered.rlike(p) for k, p in THEMES.items()}


# ---------------------------------------------------------------- selection
def bulletins_for_days(zone_days: DataFrame, bulletins: DataFrame, keep: list[str], margin_minutes: int = 5) -> DataFrame:
    """Latest non-empty bulletin per (zone, office, day), issued strictly before the cutoff minus a margin."""
    live = bulletins.filter(F.length(F.trim("reasoning_text")) > 0)
    hit = latest_before_cutoff(zone_days.select("office", "operating_date"), live, "issued_utc", keep[:1], keep,
                               keys=["office"], lead_minutes=margin_minutes, max_age_days=None)
    return zone_days.join(hit, ["office", "operating_date"])
