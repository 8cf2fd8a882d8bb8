"""DuckDB twins of the text queries."""

from stationproof.llm import resample as R
from stationproof.llm import secrets as S

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

DECONTAMINATE = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS ws FROM documents),
i AS (SELECT cast(item_id AS varchar) AS item, {_WORDS} AS ws FROM benchmark),
iw AS (
  SELECT DISTINCT item, k, array_to_string(ws[p : p + k - 1], ' ') AS w
  FROM (SELECT item, ws, k, unnest(range(1, len(ws) - k + 2)) AS p FROM (SELECT *, least(len(ws), 10) AS k FROM i WHERE len(ws) > 0))),
ks AS (SELECT DISTINCT k FROM iw),
dw AS (
  SELECT r, k, p, array_to_string(ws[p : p + k - 1], ' ') AS w
  FROM (SELECT r, ws, k, unnest(range(1, len(ws) - k + 2)) AS p FROM d, ks WHERE len(ws) >= k)),
hit AS (SELECT r, dw.k, p, item FROM dw JOIN iw ON dw.k = iw.k AND dw.w = iw.w),
places AS (SELECT r, count(DISTINCT q) AS n_hit FROM (SELECT r, unnest(range(p, p + k)) AS q FROM hit) GROUP BY r),
named AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM hit) GROUP BY r)
SELECT d.doc_id, cast(len(d.ws) AS bigint) AS n_words, cast(coalesce(n_hit, 0) AS bigint) AS n_hit, cast(coalesce(n_items, 0) AS bigint) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN places USING (r) LEFT JOIN named USING (r)
"""

NEAR_DEDUP = r"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
  FROM documents),
s AS (
  SELECT DISTINCT r, w FROM (
    SELECT r, ws[p] || ' ' || ws[p + 1] AS w FROM (SELECT r, ws, unnest(range(1, len(ws))) AS p FROM d WHERE len(ws) > 1)
    UNION ALL SELECT r, ws[1] FROM d WHERE len(ws) = 1)),
n AS (SELECT r, count(*) AS n FROM s GROUP BY r),
-- Any pair that reaches 80 of 100 shares one of the rarest fifth (and one more) of either set.
f AS (SELECT w, count(*) AS c FROM s GROUP BY w),
prefix AS (
  SELECT r, w FROM (SELECT r, w, row_number() OVER (PARTITION BY r ORDER BY c, w) AS k, n FROM s JOIN f USING (w) JOIN n USING (r))
  WHERE k <= n - ((80 * n + 99) // 100) + 1),
maybe AS (SELECT DISTINCT a.r AS a, b.r AS b FROM prefix a JOIN prefix b ON a.w = b.w AND a.r < b.r),
links AS (
  SELECT a, b FROM (
    SELECT a, b, count(*) AS shared FROM maybe JOIN s x ON x.r = a JOIN s y ON y.r = b AND y.w = x.w GROUP BY a, b)
  JOIN n na ON na.r = a JOIN n nb ON nb.r = b WHERE 100 * shared >= 80 * (na.n + nb.n - shared)),
either AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT r AS a, r AS b FROM d UNION SELECT reach.a, either.b FROM reach JOIN either ON reach.b = either.a),
least AS (SELECT reach.a AS r, min(t.doc_id) AS component_id FROM reach JOIN d t ON t.r = reach.b GROUP BY reach.a)
SELECT d.doc_id, cast(coalesce(n.n, 0) AS bigint) AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM d JOIN least USING (r) LEFT JOIN n USING (r)
"""


def _matches(kind: int, pattern: str, group: int, least: int) -> str:
    return f"""SELECT r, {kind} AS kind, start, start + length(m) AS stop, v FROM (
    SELECT r, ms[i] AS m, vs[i] AS v, list_sum(list_transform(ps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0) AS start
    FROM (SELECT *, unnest(range(1, len(ms) + 1)) AS i FROM (
      SELECT r, regexp_extract_all(t, '{pattern}', 0) AS ms, regexp_extract_all(t, '{pattern}', {group}) AS vs, string_split_regex(t, '{pattern}') AS ps FROM d)))
  WHERE length(v) >= {least}"""


_PATTERNS = [(p.split(")", 1)[1] if p.startswith("(?<!") else p, g, n) for p, g, n in [*S.KINDS.values(), (S.RUN, 0, S.MIN_RUN)]]
_ALL = " UNION ALL ".join(_matches(k, p.replace("'", "''"), g, n) for k, (p, g, n) in enumerate(_PATTERNS))
_NAME = "CASE kind " + " ".join(f"WHEN {i} THEN '{k}'" for i, k in enumerate(S.ORDER)) + " END || ':' || start || ':' || stop"

SECRETS = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
found AS ({_ALL}),
base AS (SELECT * FROM found WHERE kind < {len(S.KINDS)}),
runs AS (
  SELECT row_number() OVER () AS id, * FROM found f WHERE kind = {len(S.KINDS)}
  AND NOT EXISTS (SELECT 1 FROM base b WHERE b.r = f.r AND b.start < f.stop AND f.start < b.stop)),
labelled AS (SELECT v, true AS random FROM base UNION ALL SELECT v, false FROM runs),
pairs AS (SELECT random, v[i : i + 1] AS pair FROM (SELECT random, v, unnest(range(1, length(v))) AS i FROM labelled)),
counted AS (SELECT random, pair, count(*) AS n FROM pairs WHERE regexp_full_match(pair, '[A-Za-z0-9+/_=-]{{2}}') GROUP BY ALL),
letters AS (SELECT unnest(string_split('{S.ALPHABET}', '')) AS c),
model AS (
  SELECT k.random, a.c AS a, b.c AS b, {S.PRIOR} + coalesce(n, 0) AS w
  FROM (SELECT unnest([true, false]) AS random) k CROSS JOIN letters a CROSS JOIN letters b LEFT JOIN counted c ON c.random = k.random AND c.pair = a.c || b.c),
logs AS (SELECT random, a, b, ln(w) - ln(sum(w) OVER (PARTITION BY random, a)) AS l FROM model),
ratios AS (
  SELECT x.a || x.b AS pair, CASE WHEN (SELECT count(DISTINCT random) FROM counted) = 2 THEN x.l - y.l ELSE 0 END AS l
  FROM logs x JOIN logs y ON x.a = y.a AND x.b = y.b WHERE x.random AND NOT y.random),
scored AS (
  SELECT id, sum(l) AS score FROM (SELECT id, v[i : i + 1] AS pair FROM (SELECT id, v, unnest(range(1, length(v))) AS i FROM runs)) JOIN ratios USING (pair) GROUP BY id),
spans AS (
  SELECT r, kind, start, stop FROM base UNION ALL
  SELECT r, kind, start, stop FROM runs JOIN scored USING (id) WHERE score >= {S.MIN_LLR} AND score >= {S.MEAN_LLR} * (length(v) - 1)),
per AS (
  SELECT r, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
         string_agg({_NAME}, ',' ORDER BY start, kind) FILTER (kind < {len(S.KINDS)}) AS base, string_agg({_NAME}, ',' ORDER BY start, kind) AS spans
  FROM spans GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN per USING (r)
"""

_DIGIT = "strpos('0123456789abcdef', substr({text}, {at}, 1)) - 1"
_HIGH, _LOW = (_DIGIT.format(text="lower(hex(w))", at=f"2 * k + {i}") for i in (1, 2))

#: crc32 goes byte by byte through a table made from its polynomial.
RESAMPLE = f"""
WITH t AS (
  SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, b: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS tab
  FROM (SELECT unnest(range(256)) AS i)),
d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS ws FROM documents),
sw AS (SELECT r, unnest(ws) AS w FROM d),
tw AS (SELECT unnest({_WORDS}) AS w FROM benchmark),
wb AS (
  SELECT w, xor(list_reduce(list_prepend(4294967295, list_transform(range(strlen(w)), lambda k: ({_HIGH}) * 16 + {_LOW})),
                            lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295) % {R.BUCKETS} AS bucket
  FROM (SELECT DISTINCT w FROM (FROM sw UNION ALL BY NAME SELECT w FROM tw)), t),
s AS (SELECT bucket, count(*) AS n FROM sw JOIN wb USING (w) GROUP BY bucket),
g AS (SELECT bucket, count(*) AS n FROM tw JOIN wb USING (w) GROUP BY bucket),
gain AS (
  SELECT bucket, cast(floor(1000 * ln((coalesce(g.n, 0) + 1.0::double) * ((SELECT count(*) FROM sw) + {R.BUCKETS})
         / ((s.n + 1.0::double) * ((SELECT count(*) FROM tw) + {R.BUCKETS})))) AS bigint) AS gain
  FROM s LEFT JOIN g USING (bucket)),
weights AS (SELECT r, sum(gain) AS weight FROM sw JOIN wb USING (w) JOIN gain USING (bucket) GROUP BY r),
h AS (SELECT r, sha256('{R.SEED}:' || coalesce(cast(doc_id AS varchar), '')) AS x FROM d),
u AS (SELECT r, list_sum(list_transform(range(8), lambda k: ({_DIGIT.format(text="x", at="k + 1")}) * cast(pow(16, 7 - k) AS bigint))) AS v FROM h),
scored AS (
  SELECT r, doc_id, len(ws) AS n, cast(coalesce(weight, 0) AS bigint) AS weight,
         cast(coalesce(weight, 0) + floor(-1000 * ln(-ln((v + 0.5::double) / 4294967296))) AS bigint) AS score
  FROM d JOIN u USING (r) LEFT JOIN weights USING (r)),
best AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id NULLS FIRST) AS rank FROM scored WHERE n >= {R.LEAST_WORDS}),
drawn AS (FROM best WHERE rank <= (SELECT count(*) * {R.PERCENT} // 100 FROM best))
SELECT doc_id, cast(n AS bigint) AS n_features, weight, score, rank FROM scored LEFT JOIN drawn USING (r)
"""
