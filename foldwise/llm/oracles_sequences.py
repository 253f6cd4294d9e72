"""DuckDB SQL of conversation repair and phrase collocations."""

from __future__ import annotations

from foldwise.llm.oracles import low

ORACLES: dict[str, str] = {}

# CRC-32 by its table: DuckDB has no function of that name
_CRC = """SELECT list(v ORDER BY i) AS tab FROM (SELECT i, list_reduce([i] || range(8),
  lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM (SELECT unnest(range(256)) AS i))"""
_CODE = """xor(list_reduce([4294967295] || list_transform(string_split(
    coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda x: CAST(ascii(x) AS BIGINT)),
    lambda s, b: xor(s >> 8, tab[CAST(xor(s, b) & 255 AS INTEGER) + 1])), 4294967295) % 20"""


def _state(to: int) -> str:
    """Best (cost, string) of the programme's state ``to`` after a row: all ways
    to insert up to two rows and edit the row, from every state before."""
    ways = []
    for old in range(4):
        for inserts in range(3):
            at = old
            for _ in range(inserts):
                at = 3 if at == 2 else 2
            lead = f"st{old}.s || '{'I' * inserts}"
            paid = f"st{old}.c + {3 * inserts}"
            known = f"st{old} IS NOT NULL"
            if at == to:
                ways.append(f"CASE WHEN {known} THEN {{'c': {paid} + 4, 's': {lead}D'}} END")
            alive, extra = "fault NOT IN ('blank', 'duplicate')", "CASE WHEN fault = 'truncated' THEN 3 ELSE 0 END"
            for initial, goal in (("s", 1 if at == 0 else 9), ("u", 2 if at != 2 else 9), ("a", 3 if at == 2 else 9)):
                if goal == to:
                    ways.append(f"CASE WHEN {known} AND {alive} AND ini = '{initial}' THEN {{'c': {paid} + {extra}, 's': {lead}K'}} END")
            if (3 if at == 2 else 2) == to:
                ways.append(f"CASE WHEN {known} AND {alive} THEN {{'c': {paid} + 3 + {extra}, 's': {lead}R'}} END")
    return "list_min([" + ",\n    ".join(ways) + f"]) AS st{to}"


_END = ", ".join(f"CASE WHEN st{s} IS NOT NULL THEN {{'c': st{s}.c + {3 * m}, 's': st{s}.s || '{'I' * m}'}} END"
                 for s, m in ((0, 0), (1, 2), (2, 1), (3, 0)))

ORACLES["op11_conversations"] = f"""
WITH RECURSIVE t AS ({_CRC}),
c AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {_CODE} AS code FROM conversations, t),
d AS (SELECT conv_id, turn, CASE WHEN code = 4 THEN 'user' ELSE role END AS role, CASE WHEN code = 1 THEN ''
    WHEN code = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM (SELECT *, unnest(CASE WHEN code = 3 THEN [0, 1] ELSE [0] END) FROM c WHERE code <> 0)),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS rn, substr(role, 1, 1) AS ini FROM d),
f AS (SELECT *, CASE WHEN NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') THEN 'blank'
    WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY rn) > 1 THEN 'duplicate'
    WHEN NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*$') THEN 'truncated' ELSE '' END AS fault,
    coalesce(lag(ini) OVER (PARTITION BY conv_id ORDER BY rn) || ini NOT IN ('su', 'ua', 'au'), false) AS wrong FROM o),
g AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
  count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
  count(*) FILTER (wrong) AS illegal, count(*) AS last FROM f GROUP BY conv_id),
r AS (SELECT conv_id, CAST(0 AS BIGINT) AS rn, {{'c': CAST(0 AS BIGINT), 's': ''}} AS st0, CAST(NULL AS STRUCT(c BIGINT, s VARCHAR)) AS st1,
  CAST(NULL AS STRUCT(c BIGINT, s VARCHAR)) AS st2, CAST(NULL AS STRUCT(c BIGINT, s VARCHAR)) AS st3 FROM (SELECT DISTINCT conv_id FROM conversations)
  UNION ALL SELECT r.conv_id, f.rn, {_state(0)}, {_state(1)}, {_state(2)}, {_state(3)}
  FROM r JOIN f ON f.conv_id IS NOT DISTINCT FROM r.conv_id AND f.rn = r.rn + 1),
e AS (SELECT r.conv_id, list_min([{_END}]) AS best FROM r LEFT JOIN g ON g.conv_id IS NOT DISTINCT FROM r.conv_id
  WHERE r.rn = coalesce(g.last, 0)),
x AS (SELECT conv_id, best.s AS audit, unnest(range(1, length(best.s) + 1)) AS i FROM e),
y AS (SELECT conv_id, i, audit[i] AS edit, length(replace(substr(audit, 1, i), 'I', '')) AS rn FROM x),
z AS (SELECT y.*, f.ini, f.role, f.text, row_number() OVER (PARTITION BY y.conv_id ORDER BY i) - 1 AS j,
  first_value(edit = 'K' AND f.ini = 's') OVER (PARTITION BY y.conv_id ORDER BY i) AS headed
  FROM y LEFT JOIN f ON f.conv_id IS NOT DISTINCT FROM y.conv_id AND f.rn = y.rn WHERE edit <> 'D'),
w AS (SELECT conv_id, string_agg(CASE WHEN edit = 'K' THEN role WHEN (j + CAST(headed AS INTEGER)) % 2 = 0 THEN 'user' ELSE 'assistant' END
  || ':' || CASE WHEN edit = 'I' THEN '' ELSE text END, chr(10) ORDER BY i) AS body FROM z GROUP BY conv_id)
SELECT e.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
  coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, e.best.c AS cost, e.best.s AS audit,
  sha256(coalesce(body, '')) AS repaired_sha256
FROM e LEFT JOIN g ON g.conv_id IS NOT DISTINCT FROM e.conv_id LEFT JOIN w ON w.conv_id IS NOT DISTINCT FROM e.conv_id"""

ORACLES["op12_collocations"] = f"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, {low('text')} AS t FROM documents),
p AS (SELECT lang, regexp_extract_all(unnest(regexp_split_to_array(t, '[.,;:!?\\x0A-\\x0D]')), '[^\\x20\\x09]+') AS w FROM d),
v AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM p GROUP BY lang),
s AS (SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM p, (SELECT unnest(range(1, 6)) AS m) WHERE len(w) >= m),
f AS (SELECT lang, m, array_to_string(w[i:i + m - 1], ' ') AS q, count(*) AS c FROM s GROUP BY ALL HAVING count(*) >= 100),
k AS (SELECT lang, m, q, c, string_split(q, ' ') AS w, unnest(range(1, m)) AS cut FROM f WHERE m > 1),
x AS (SELECT k.lang, k.m, k.q, k.c, min({{'score': CAST(1000 AS HUGEINT) * k.c * n // (CAST(l.c AS HUGEINT) * r.c), 'cut': cut, 'l': l.c, 'r': r.c}}) AS b, any_value(n) AS n
  FROM k JOIN v ON v.lang = k.lang JOIN f l ON l.lang = k.lang AND l.q = array_to_string(w[:cut], ' ')
  JOIN f r ON r.lang = k.lang AND r.q = array_to_string(w[cut + 1:], ' ') GROUP BY ALL),
a AS (SELECT x.* FROM x WHERE NOT EXISTS (SELECT 1 FROM f g WHERE g.lang = x.lang AND g.m > x.m AND g.c >= x.c
  AND contains(' ' || g.q || ' ', ' ' || x.q || ' ')))
SELECT lang, rank, q AS phrase, c AS a, b.l AS l, b.r AS r, n, CAST(b.score AS BIGINT) AS score FROM (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY b.score DESC, c DESC, q) AS rank FROM a) WHERE rank <= 2000"""
