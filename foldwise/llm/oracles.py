"""DuckDB SQL of the operators whose results SQL can express."""

from __future__ import annotations

UPPER, DOWN = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def low(text: str) -> str:
    return f"translate(coalesce({text}, ''), '{UPPER}', '{DOWN}')"


ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WORD = r"[^\x20\x09-\x0D]+"

ORACLES: dict[str, str] = {}

ORACLES["op1_decontaminate"] = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all({low('text')}, '{ALNUM}') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({low('text')}, '{ALNUM}') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS k FROM (
  SELECT item_id, w, least(13, len(w)) AS n, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
dw AS (SELECT rid, i, n, array_to_string(w[i:i + n - 1], ' ') AS k FROM (
  SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)),
hit AS (SELECT DISTINCT rid, i, n, item_id FROM dw JOIN bw USING (k, n)),
hw AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS p FROM hit) GROUP BY rid),
it AS (SELECT rid, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids FROM (
  SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS s FROM hit WHERE item_id IS NOT NULL) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hw USING (rid) LEFT JOIN it USING (rid)"""

_digits = " || ".join(
    f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((CAST('0x' || substr(h, {5 * g + 1}, 5) AS INTEGER) >> {s}) & 31), 1)"
    for g in range(8) for s in (15, 10, 5, 0))
ORACLES["op3_warc"] = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS h FROM pages),
q AS (SELECT *, max(page_id) OVER (PARTITION BY body) AS last FROM p)
SELECT page_id, CAST(strlen(body) AS BIGINT) AS payload_bytes, {_digits} AS payload_digest,
  CASE WHEN page_id < last THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id < last THEN last END AS refers_to FROM q"""

ORACLES["op4_neardup"] = f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({low('text')}, '{WORD}') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + n - 1], ' ') AS k FROM (
  SELECT doc_id, w, least(5, len(w)) AS n, unnest(range(1, len(w) - least(5, len(w)) + 2)) AS i FROM d WHERE len(w) > 0)),
z AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
l AS (SELECT a.doc_id AS u, b.doc_id AS v FROM s a JOIN s b ON a.k = b.k AND a.doc_id <> b.doc_id
  JOIN z za ON za.doc_id = a.doc_id JOIN z zb ON zb.doc_id = b.doc_id GROUP BY a.doc_id, b.doc_id
  HAVING 100 * count(*) >= 75 * (any_value(za.n) + any_value(zb.n) - count(*))),
r AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, l.v FROM r JOIN l ON r.b = l.u),
c AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a)
SELECT doc_id, coalesce(z.n, 0) AS n_shingles, component_id, doc_id = component_id AS kept
FROM d JOIN c USING (doc_id) LEFT JOIN z USING (doc_id)"""

ORACLES["op7_quality"] = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t,
  regexp_extract_all(coalesce(text, ''), '{WORD}') AS w,
  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM documents),
g AS (SELECT rid, i, array_to_string(w[i:i + 4], ' ') AS k FROM (
  SELECT rid, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5)),
rep AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest(range(i, i + 5)) AS p FROM (
  SELECT *, count(*) OVER (PARTITION BY rid, k) AS often FROM g) WHERE often > 1) GROUP BY rid),
m AS (SELECT rid, doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
  CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(lines) AS BIGINT) AS n_lines,
  CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines FROM d),
x AS (SELECT m.*, coalesce(rep.n, 0) AS n_repeat_words FROM m LEFT JOIN rep USING (rid)),
f AS (SELECT *, CAST((CASE WHEN n_words < 10 THEN 1 ELSE 0 END) + (CASE WHEN 100 * n_repeat_words > 20 * n_words THEN 2 ELSE 0 END)
  + (CASE WHEN 10 * n_symbols > 3 * n_words THEN 4 ELSE 0 END) + (CASE WHEN 2 * n_dup_lines > n_lines THEN 8 ELSE 0 END)
  + (CASE WHEN word_chars > 20 * n_words THEN 16 ELSE 0 END) + (CASE WHEN word_chars < 2 * n_words THEN 32 ELSE 0 END) AS BIGINT) AS fail_bits FROM x)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (fail_bits & 3) <> 0 AS base_failed,
  fail_bits = 0 AS kept, n_lines, fail_bits FROM f"""

# (host, path, verdict), longest first
_rules = [("example.org", "/en/1", "block"), ("example.org", "/es/", "block"), ("com", "/fr/", "allow"),
          ("com", "/de/", "block"), ("org", "/", "allow")]


def _case(value) -> str:
    return "CASE " + " ".join(
        f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{value(h, p, v)}'" for h, p, v in _rules)


ORACLES["op9_urls"] = f"""
WITH p AS (SELECT page_id, {low("regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1)")} AS host,
  regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path FROM pages)
SELECT page_id, host, path, {_case(lambda h, p, v: h + p)} END AS rule, {_case(lambda h, p, v: v)}
  ELSE CASE WHEN len(list_filter(string_split(host, '.'), lambda x: list_has_any(string_split(x, '-'),
    ['ads', 'adserver', 'adult', 'bets', 'betting', 'bingo', 'casino', 'cialis', 'escort', 'gambling', 'jackpot', 'lottery', 'malware',
     'phishing', 'pills', 'poker', 'porn', 'roulette', 'sex', 'slots', 'spam', 'spyware', 'tracking', 'viagra', 'warez', 'xxx']))) > 0 THEN 'block' ELSE 'allow' END END AS verdict FROM p"""

# bytes as hex digits: two for each byte
ORACLES["op5_substrings"] = """
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, hex(encode(coalesce(text, ''))) AS x,
  CAST(strlen(coalesce(text, '')) AS BIGINT) AS n FROM documents),
w AS (SELECT rid, i, md5(substr(x, 2 * i + 1, 800)) AS k FROM (
  SELECT rid, x, unnest(range(0, n - 399)) AS i FROM d WHERE n >= 400)),
r AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY k) AS c FROM w) WHERE c > 1),
e AS (SELECT rid, i, CASE WHEN i <= lag(i) OVER (PARTITION BY rid ORDER BY i) + 400 THEN 0 ELSE 1 END AS first FROM r),
g AS (SELECT rid, i, sum(first) OVER (PARTITION BY rid ORDER BY i) AS span FROM e),
s AS (SELECT rid, min(i) AS a, max(i) + 400 AS b FROM g GROUP BY rid, span),
p AS (SELECT s.*, coalesce(lag(b) OVER (PARTITION BY rid ORDER BY a), 0) AS before FROM s),
t AS (SELECT p.rid, sum(b - a) AS gone, count(*) AS n_spans, max(b) AS last,
  string_agg(substr(d.x, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS kept FROM p JOIN d USING (rid) GROUP BY p.rid)
SELECT doc_id, n AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(coalesce(kept || substr(x, 2 * last + 1), x))) AS kept_sha256, n - CAST(coalesce(gone, 0) AS BIGINT) AS n_kept FROM d LEFT JOIN t USING (rid)"""
