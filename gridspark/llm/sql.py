"""DuckDB SQL that must return what the queries return, for those that SQL can express."""

from __future__ import annotations

from gridspark.llm.permute import ROUNDS
from gridspark.llm.secrets import KINDS, NEEDS, SCOPE, STRONG
from gridspark.llm.sharding import BUCKET_DIGITS

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _low(c: str) -> str:
    return f"translate(coalesce({c}, ''), '{_UPPER}', '{_LOWER}')"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


OP3 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages), f AS (SELECT h, min(page_id) AS m FROM p GROUP BY h),
x AS (SELECT page_id, h, m, sha1(h) AS hex FROM p JOIN f USING (h))
SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(
           1 + ((CAST('0x' || substr(hex, CAST(i // 4 * 5 + 1 AS BIGINT), 5) AS BIGINT) >> (15 - 5 * (i % 4))) & 31) AS BIGINT), 1)), '') AS payload_digest,
       CASE WHEN m IS NULL OR m = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN m <> page_id OR page_id IS NULL THEN m END AS refers_to
FROM x
"""

OP5 = f"""
WITH r(h, p, v) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'),
                           ('com', '/de/', 'block')),
u AS (SELECT row_number() OVER () AS rid, page_id, {_low("regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1)")} AS host,
             coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
m AS (SELECT rid, h || p AS rule, v, row_number() OVER (PARTITION BY rid ORDER BY length(h || p) DESC, length(h) DESC, v DESC, h || p DESC) AS k
      FROM u JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p))
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM u LEFT JOIN m ON u.rid = m.rid AND k = 1
"""


def _op6() -> str:
    parts = []
    for rank, (kind, role, pattern, least) in enumerate(KINDS):
        p = _quoted(pattern)
        parts.append(f"""
SELECT rid, {rank} AS rank, '{kind}' AS kind, '{role}' AS role, CAST(upto - length(m) AS BIGINT) AS s, CAST(upto AS BIGINT) AS e FROM (
  SELECT rid, m, g, sum(length(gap) + length(m)) OVER (PARTITION BY rid ORDER BY k) AS upto FROM (
    SELECT rid, unnest(ms) AS m, unnest(gs) AS g, unnest(gaps[1:len(ms)]) AS gap, unnest(range(1, len(ms) + 1)) AS k FROM (
      SELECT rid, regexp_extract_all(t, {p}, 0) AS ms, regexp_extract_all(t, {p}, {1 if least else 0}) AS gs, string_split_regex(t, {p}) AS gaps
      FROM d WHERE regexp_matches(t, {p})))) WHERE length(g) >= {least}""")
    needs = ", ".join(f"('{k}', '{r}')" for k, roles in NEEDS.items() for r in roles)
    strong = ", ".join(f"'{k}'" for k in STRONG)
    listed = "coalesce(string_agg({0}, ',' ORDER BY s, rank, e) FILTER ({1}), '')"
    text = "kind || ':' || s || ':' || e"
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
x AS ({" UNION ALL ".join(parts)}),
needs(kind, role) AS (VALUES {needs}),
kept AS (SELECT * FROM x WHERE kind IN ({strong}) OR EXISTS (
  SELECT 1 FROM needs n JOIN x y ON y.role = n.role WHERE n.kind = x.kind AND y.rid = x.rid AND y.s - x.e <= {SCOPE} AND x.s - y.e <= {SCOPE}))
SELECT doc_id, {", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in STRONG)},
       sha256({listed.format(text, f"kind IN ({strong})")}) AS base_sha256, {listed.format(text, "kind IS NOT NULL")} AS spans
FROM d LEFT JOIN kept USING (rid) GROUP BY rid, doc_id
"""


_ALNUM = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
OP8 = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all({_low("text")}, {_ALNUM}) AS w FROM documents),
i AS (SELECT CAST(item_id AS VARCHAR) AS item, w, least(len(w), 10) AS n FROM (
  SELECT item_id, regexp_extract_all({_low("text")}, {_ALNUM}) AS w FROM benchmark) WHERE len(w) > 0),
win AS (SELECT DISTINCT item, n, array_to_string(w[s:s + n - 1], ' ') AS k FROM (SELECT item, n, w, unnest(range(1, len(w) - n + 2)) AS s FROM i)),
dw AS (SELECT rid, n, s, array_to_string(w[s:s + n - 1], ' ') AS k FROM (
  SELECT rid, n, w, unnest(range(1, len(w) - n + 2)) AS s FROM d JOIN (SELECT DISTINCT n FROM win) ON len(w) >= n)),
hit AS (SELECT rid, s, n, item FROM dw JOIN win USING (n, k)),
words AS (SELECT rid, count(DISTINCT p) AS c FROM (SELECT rid, unnest(range(s, s + n)) AS p FROM hit) GROUP BY rid),
items AS (SELECT rid, count(DISTINCT item) AS c, string_agg(DISTINCT item, ',' ORDER BY item) AS l FROM hit GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(words.c, 0) AS n_hit, coalesce(items.c, 0) AS n_items,
       sha256(coalesce(l, '')) AS items_sha256, words.c IS NOT NULL AS contaminated
FROM d LEFT JOIN words USING (rid) LEFT JOIN items USING (rid)
"""

OP9 = f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_low("text")}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, array_to_string(w[s:s + 4], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS s FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sh a JOIN sh b ON a.k = b.k AND a.doc_id <> b.doc_id GROUP BY ALL),
link AS (SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
reach(a, b) AS (SELECT a, b FROM link UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a),
low AS (SELECT a AS doc_id, min(b) AS m FROM reach GROUP BY a)
SELECT doc_id, coalesce(n.n, 0) AS n_shingles, least(doc_id, coalesce(m, doc_id)) AS component_id, doc_id <= coalesce(m, doc_id) AS kept
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN low USING (doc_id)
"""


def _draw(key: str, j: int, v: str) -> str:
    return f"CAST('0x' || substr(md5('{key}:{j}:' || CAST({v} AS VARCHAR)), 1, 15) AS BIGINT)"


def _step(y: str, key: str) -> str:
    """A chain of subqueries from (id, n, a, b, y) to the next y of each id."""
    q = f"SELECT id, n, a, b, {y} % a AS l, {y} // a AS r"
    chain = q + " FROM {src}"
    for j in range(1, ROUNDS + 1):
        new = f"(l + {_draw(key, j, 'r')}) % a AS l, r" if j % 2 else f"l, (r + {_draw(key, j, 'l')}) % b AS r"
        chain = f"SELECT id, n, a, b, {new} FROM ({chain})"
    return f"SELECT id, n, a, b, l + a * r AS y FROM ({chain})"


OP10 = f"""
WITH RECURSIVE tab AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i, range(0, 8)),
  lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, CAST(3988292384 AS BIGINT)) ELSE c >> 1 END) AS c FROM (SELECT unnest(range(0, 256)) AS i))),
raw AS (SELECT doc_id, CAST(strlen(coalesce(text, '')) + 1 AS BIGINT) AS size, CASE WHEN text IS NOT NULL THEN
  xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(0, strlen(text)), lambda i: CAST('0x' || substr(hex(encode(text)), 2 * i + 1, 2) AS BIGINT))),
    lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1])), CAST(4294967295 AS BIGINT)) END AS crc FROM documents, tab),
keyed AS (SELECT *, CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '-') || '|' || size || '|' || coalesce(CAST(crc AS VARCHAR), '-')), 1, {BUCKET_DIGITS}) AS BIGINT) AS bucket FROM raw),
num AS (SELECT *, row_number() OVER (ORDER BY bucket, doc_id NULLS FIRST, size, crc NULLS FIRST) - 1 AS id, count(*) OVER () AS n FROM keyed),
grid AS (SELECT *, CAST((n + a - 1) // a AS BIGINT) AS b FROM (SELECT id, n, CAST(ceil(sqrt(n)) AS BIGINT) AS a, id AS y FROM num)),
walk AS ({_step("y", "shuffle-1").replace("{src}", "grid")}
  UNION ALL {_step("y", "shuffle-1").replace("{src}", "(SELECT * FROM walk WHERE y >= n)")})
SELECT doc_id, size, crc AS text_crc32, 'rows' AS law, CAST(y % 8 AS INTEGER) AS shard, CAST(y // 8 AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM num JOIN (SELECT id, y FROM walk WHERE y < n) USING (id)
"""

OP12 = f"""
WITH p AS (SELECT lang, regexp_extract_all(p, '[^\\x20\\x09]+') AS w FROM (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({_low("text")}, '[.,;:!?\\x0A-\\x0D]')) AS p FROM documents)),
n AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM p GROUP BY lang),
f AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase, count(*) AS f FROM (
  SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM p, (VALUES (1), (2), (3)) v(k)) GROUP BY ALL HAVING count(*) >= 10),
c AS (SELECT lang, k, phrase, f, string_split(phrase, ' ') AS w, unnest(range(1, k)) AS cut FROM f WHERE k > 1),
s AS (SELECT c.lang, c.k, c.phrase, c.f AS a, x.f AS l, y.f AS r, cut, CAST(1000000::HUGEINT * c.f * c.f // (x.f::HUGEINT * y.f) AS BIGINT) AS score,
             row_number() OVER (PARTITION BY c.lang, c.phrase ORDER BY 1000000::HUGEINT * c.f * c.f // (x.f::HUGEINT * y.f), cut) AS k1
      FROM c JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[1:cut], ' ')
      JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[cut + 1:c.k], ' ')),
inside AS (SELECT lang, phrase, max(f) AS f FROM (
  SELECT lang, f, unnest([array_to_string(string_split(phrase, ' ')[1:2], ' '), array_to_string(string_split(phrase, ' ')[2:3], ' ')]) AS phrase
  FROM f WHERE k = 3) GROUP BY ALL),
ranked AS (SELECT s.*, row_number() OVER (PARTITION BY s.lang ORDER BY score DESC, a DESC, s.phrase) AS rank
           FROM s LEFT JOIN inside i ON i.lang = s.lang AND i.phrase = s.phrase WHERE k1 = 1 AND coalesce(100 * i.f < 50 * a, true))
SELECT lang, rank, phrase, a, l, r, n, score, CAST(cut AS BIGINT) AS cut FROM ranked JOIN n USING (lang) WHERE rank <= 2000
"""

ORACLES: dict[str, str] = {"op3_warc": OP3, "op5_url_filter": OP5, "op6_secret_scan": _op6(), "op8_decontamination": OP8, "op9_lsh_forest": OP9,
                           "op10_feistel_shards": OP10, "op12_collocations": OP12}
