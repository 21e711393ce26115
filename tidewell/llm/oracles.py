"""The same results in DuckDB's SQL, for the operators that SQL can express."""

from __future__ import annotations

from tidewell.llm.mixing import BITS, BLOCK_ROWS, LIFT, MOST_REPEATS, ROUNDS
from tidewell.llm.quality import FENCES, LEAST_ROWS, MANTISSA, STEP_BITS
from tidewell.llm.url_filter import RULES

_SPLIT = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"
_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _bucket(value: str) -> str:
    """The value cut to its grid step, and that to its upper bits."""
    steps = f"CAST(floor(({value}) * {1 << STEP_BITS}) AS BIGINT)"
    spare = f"greatest(length(bin({steps})) - {MANTISSA}, 0)"
    return f"(({steps} >> {spare}) << {spare}) / {float(1 << STEP_BITS)}"


def _fence(name: str) -> str:
    f = FENCES[name]
    at = lambda p: f"quantile_disc({_bucket(name)}, {p})"
    bound = lambda sign, times: f"{at(0.5)} {sign} {float(times)} * greatest({at(0.5)} - {at(0.25)}, {f.least})"
    return f"{bound('+', f.high)} AS {name}_high, {bound('-', f.low) if f.low is not None else 'CAST(NULL AS DOUBLE)'} AS {name}_low"


def _group(name: str, keys: str) -> str:
    return f"{name} AS (SELECT {keys + ', ' if keys else ''}count(*) AS n, {', '.join(map(_fence, FENCES))} FROM good {f'GROUP BY {keys}' if keys else ''})"


def _pick(side: str) -> str:
    return f"CASE WHEN o.n >= {LEAST_ROWS} THEN o.{side} WHEN l.n >= {LEAST_ROWS} THEN l.{side} ELSE a.{side} END"


_QUALITY = rf"""
WITH w AS (SELECT doc_id, lang, source, coalesce(text, '') AS t, {_SPLIT} AS w FROM documents),
tri AS (SELECT doc_id, unnest(range(1, len(w) - 1)) AS i, unnest(list_transform(range(1, len(w) - 1), lambda i: [w[i], w[i + 1], w[i + 2]])) AS x FROM w),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, x) AS c FROM tri) WHERE c > 1),
cover AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM twice) GROUP BY doc_id),
lines AS (SELECT doc_id, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM w),
b AS (SELECT w.doc_id, lang, source, CAST(len(w) AS BIGINT) AS n_words, CAST(len(array_to_string(w, '')) AS BIGINT) AS word_chars,
  CAST(len(t) - len(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(cover.n, 0) AS BIGINT) AS n_repeat_words
  FROM w JOIN lines USING (doc_id) LEFT JOIN cover USING (doc_id)),
c AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, {", ".join(f"CAST({f.value} AS DOUBLE) AS {n}" for n, f in FENCES.items())} FROM b),
good AS (SELECT * FROM c WHERE NOT base_failed),
{_group("own", "lang, source")}, {_group("by_lang", "lang")}, {_group("whole", "")}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND
  {" AND ".join(f"coalesce({n} <= {_pick(f'{n}_high')}, true) AND coalesce({n} >= {_pick(f'{n}_low')}, true)" for n in FENCES)} AS kept, c.lang AS lang, c.source AS source
FROM c LEFT JOIN own o ON o.lang IS NOT DISTINCT FROM c.lang AND o.source IS NOT DISTINCT FROM c.source
LEFT JOIN by_lang l ON l.lang IS NOT DISTINCT FROM c.lang CROSS JOIN whole a"""

_NEAREST = """
WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
d AS (SELECT q.vec_id AS query_id, c.vec_id, sqrt(list_sum(list_transform(list_zip(q.v, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id AND len(q.v) = len(c.v)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS rank FROM d)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 10"""

_NEAR = f"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce({_LOWER}, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) < 2 THEN w ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS s FROM w),
n AS (SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles FROM s),
e AS (SELECT doc_id, unnest(s) AS x FROM s),
p AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT u, v FROM p JOIN n a ON a.doc_id = u JOIN n b ON b.doc_id = v WHERE 100 * c >= 80 * (a.n_shingles + b.n_shingles - c)),
both_ways AS (SELECT u, v FROM l UNION ALL SELECT v, u FROM l),
r AS (SELECT u, v FROM both_ways UNION SELECT r.u, b.v FROM r JOIN both_ways b ON r.v = b.u),
m AS (SELECT u AS doc_id, least(u, min(v)) AS component_id FROM r GROUP BY u)
SELECT n.doc_id, n_shingles, coalesce(component_id, n.doc_id) AS component_id, n.doc_id = coalesce(component_id, n.doc_id) AS kept FROM n LEFT JOIN m USING (doc_id)"""

_MIXING = f"""
WITH RECURSIVE d AS (SELECT doc_id, source, CAST(len({_SPLIT}) AS BIGINT) AS n_tokens FROM documents),
t AS (SELECT source, CAST(sum(n_tokens) AS BIGINT) AS tokens, count(*) AS rows FROM d GROUP BY source),
s AS (SELECT CAST(sum(tokens) AS DOUBLE) AS total, count(*) FILTER (WHERE tokens > 0) AS live, min(tokens) FILTER (WHERE tokens > 0) AS least, max(tokens) AS most FROM t),
p AS (SELECT source, ln(tokens / total) AS lp FROM t, s WHERE tokens > 0),
aim AS (SELECT h + {LIFT} * (ln(live) - h) AS target FROM (SELECT ln(sum(exp(lp))) - sum(exp(lp) * lp) / sum(exp(lp)) AS h FROM p), s),
bis AS (SELECT 0 AS k, CAST(0.0 AS DOUBLE) AS lo, CAST(1.0 AS DOUBLE) AS hi
  UNION ALL SELECT k + 1, CASE WHEN fits THEN lo ELSE mid END, CASE WHEN fits THEN mid ELSE hi END FROM (
    SELECT k, lo, hi, (lo + hi) / 2 AS mid, (SELECT ln(sum(exp((lo + hi) / 2 * lp))) - (lo + hi) / 2 * sum(exp((lo + hi) / 2 * lp) * lp) / sum(exp((lo + hi) / 2 * lp)) FROM p) <= (SELECT target FROM aim) + 1e-12
      AND (SELECT pow(CAST(most AS DOUBLE) / least, 1 - (lo + hi) / 2) FROM s) <= {MOST_REPEATS} + 1e-12 AS fits FROM bis WHERE k < {ROUNDS * BITS})),
z0 AS (SELECT (SELECT ln(sum(1.0)) FROM p) <= (SELECT target FROM aim) + 1e-12 AND (SELECT CAST(most AS DOUBLE) / least FROM s) <= {MOST_REPEATS} + 1e-12 AS zero_fits),
e AS (SELECT CASE WHEN zero_fits THEN 0.0 ELSE hi END AS t FROM bis, z0 WHERE k = {ROUNDS * BITS}),
w AS (SELECT source, tokens, rows, CASE WHEN tokens > 0 THEN exp((SELECT t FROM e) * ln(tokens / total)) / (SELECT sum(exp((SELECT t FROM e) * lp)) FROM p) ELSE 0 END AS weight FROM t, s),
b AS (SELECT *, greatest(CAST(round(weight * (SELECT max(tokens / nullif(weight, 0)) FROM w)) AS BIGINT), tokens) AS budget, CAST(ceil(rows / {BLOCK_ROWS}) AS BIGINT) AS blocks FROM w),
c AS (SELECT *, CASE WHEN tokens > 0 THEN budget // tokens ELSE 0 END AS passes FROM b),
f AS (SELECT *, budget - passes * tokens AS rest FROM c),
k AS (SELECT d.*, weight, passes, rest, md5('42:' || d.doc_id) AS doc_key, blocks FROM d JOIN f ON d.source IS NOT DISTINCT FROM f.source),
k2 AS (SELECT *, CAST('0x' || substr(doc_key, 25, 8) AS BIGINT) % greatest(blocks, 1) AS block FROM k),
k3 AS (SELECT *, md5('42:' || coalesce(source, '') || ':' || block) AS block_key FROM k2),
u AS (SELECT *, CAST(sum(n_tokens) OVER (PARTITION BY source ORDER BY block_key, doc_key RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS upto FROM k3)
SELECT doc_id, source, n_tokens, round(weight, 9) AS weight, CAST(passes + CASE WHEN rest > 0 AND upto <= rest THEN 1 ELSE 0 END AS BIGINT) AS copies, block, block_key, doc_key FROM u"""

_REST = "CASE WHEN instr({0}, '://') > 0 THEN substr({0}, instr({0}, '://') + 3) END"
_HOST = "translate(regexp_extract({0}, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_RULES = ", ".join(f"('{r.host}', '{r.path}', '{r.verdict}')" for r in RULES)
_RULE = "list(struct_pack(size := len(r.h) + len(r.p), rule := r.h || r.p, verdict := r.v) ORDER BY len(r.h) + len(r.p) DESC, len(r.h) DESC)[1]"
_FITS = "({0}.host = r.h OR ends_with({0}.host, '.' || r.h)) AND starts_with({0}.path, r.p)"

#: Canonical links to whole urls, without ``..`` in them, as tables have them if they have any; closed by recursion.
_URLS = f"""
WITH RECURSIVE rules(h, p, v) AS (VALUES {_RULES}),
a AS (SELECT row_number() OVER () AS row, page_id, html, {_REST.format("url")} AS rest FROM pages),
b AS (SELECT *, coalesce({_HOST.format("rest")}, '') AS host, coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path,
  {_HOST.format("rest")} || regexp_extract(rest, '^[^/?#]*([^#]*)', 1) AS key FROM a),
l AS (SELECT key AS u, {_REST.format("t")} AS t FROM (SELECT key, nullif(regexp_extract(html, '<link rel="canonical" href="(https?://[^"]*)"', 1), '') AS t FROM b) WHERE t IS NOT NULL AND key IS NOT NULL),
k AS (SELECT u, {_HOST.format("t")} || regexp_extract(t, '^[^/?#]*([^#]*)', 1) AS v FROM l),
both_ways AS (SELECT u, v FROM k WHERE u <> v UNION ALL SELECT v, u FROM k WHERE u <> v),
r AS (SELECT u, v FROM both_ways UNION SELECT r.u, w.v FROM r JOIN both_ways w ON r.v = w.u),
m AS (SELECT u AS key, least(u, min(v)) AS component FROM r GROUP BY u),
n AS (SELECT *, regexp_extract(key, '^[^/?#]*', 0) AS host, regexp_extract(key, '^[^/?#]*([^?#]*)', 1) AS path FROM m),
o AS (SELECT n.component, n.key, {_RULE} AS best FROM n JOIN rules r ON {_FITS.format("n")} GROUP BY ALL),
c AS (SELECT component, CASE WHEN bool_or(best.verdict = 'allow') THEN 'allow' ELSE 'block' END AS verdict FROM o GROUP BY component),
own AS (SELECT b.row, {_RULE} AS best FROM b JOIN rules r ON {_FITS.format("b")} GROUP BY b.row)
SELECT b.page_id, b.host, b.path, own.best.rule AS rule, coalesce(own.best.verdict, c.verdict, 'allow') AS verdict, c.component AS alias_class
FROM b LEFT JOIN own USING (row) LEFT JOIN m USING (key) LEFT JOIN c ON c.component = m.component"""

_COLLOCATIONS = rf"""
WITH t AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(coalesce({_LOWER}, ''), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM t),
g AS ({" UNION ALL ".join(f"SELECT lang, {m} AS words, unnest(list_transform(range(1, len(w) - {m - 2}), lambda i: array_to_string(w[i:i + {m - 1}], ' '))) AS phrase FROM w WHERE len(w) >= {m}" for m in (1, 2, 3, 4))}),
f AS (SELECT lang, words, phrase, count(*) AS a FROM g GROUP BY ALL HAVING count(*) >= 30),
n AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM w GROUP BY lang),
c AS (SELECT lang, words, phrase, a, string_split(phrase, ' ') AS p, unnest(range(1, words)) AS k FROM f WHERE words > 1),
d AS (SELECT c.lang, c.phrase, c.a, k, l.a AS l, r.a AS r, CAST(CAST(2000000 AS HUGEINT) * c.a // (l.a + r.a) AS BIGINT) AS score
  FROM c JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(p[1:k], ' ') JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(p[k + 1:], ' ')),
b AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
i AS (SELECT lang, phrase, max(a) AS most FROM (SELECT lang, a, unnest({" || ".join(f"CASE WHEN words > {m} THEN list_transform(range(1, words - {m - 2}), lambda i: array_to_string(string_split(phrase, ' ')[i:i + {m - 1}], ' ')) ELSE [] END" for m in (2, 3))}) AS phrase FROM f WHERE words > 2) GROUP BY ALL),
s AS (SELECT b.* FROM b LEFT JOIN i USING (lang, phrase) WHERE NOT coalesce(100 * most >= 80 * b.a, false)),
o AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM s)
SELECT lang, rank, phrase, a, l, r, n, score FROM o JOIN n USING (lang) WHERE rank <= 2000"""

_JACCARD = f"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce({_LOWER}, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s FROM w),
n AS (SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles FROM s),
e AS (SELECT doc_id, len(s) AS size, unnest(s) AS x FROM s),
p AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id AND 100 * least(a.size, b.size) >= 90 * greatest(a.size, b.size) GROUP BY ALL),
l AS (SELECT u, v FROM p JOIN n a ON a.doc_id = u JOIN n b ON b.doc_id = v WHERE 100 * c >= 90 * (a.n_shingles + b.n_shingles - c)),
both_ways AS (SELECT u, v FROM l UNION ALL SELECT v, u FROM l),
r AS (SELECT u, v FROM both_ways UNION SELECT r.u, b.v FROM r JOIN both_ways b ON r.v = b.u),
m AS (SELECT u AS doc_id, least(u, min(v)) AS component_id FROM r GROUP BY u)
SELECT n.doc_id, n_shingles, coalesce(component_id, n.doc_id) AS component_id FROM n LEFT JOIN m USING (doc_id)"""

#: The checksum goes byte by byte over a table of 256 remainders; a node's name is the list of its turns' digests.
_TRIE = """
WITH RECURSIVE bits AS (SELECT i AS b, 0 AS k, CAST(i AS BIGINT) AS c FROM range(256) t(i)
  UNION ALL SELECT b, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM bits WHERE k < 8),
crc AS (SELECT list(c ORDER BY b) AS t FROM bits WHERE k = 8),
o AS (SELECT conv_id, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || ':' || coalesce(text, '')) AS x, CAST(strlen(coalesce(text, '')) AS BIGINT) AS y,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS place FROM conversations WHERE conv_id IS NOT NULL),
g AS (SELECT conv_id, list(x ORDER BY place) AS x, list(y ORDER BY place) AS y FROM o GROUP BY conv_id),
h AS (SELECT g.*, conv_id - conv_id % 5 AS thread,
  xor(list_reduce(list_concat([4294967295], list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda s: CAST(ord(s) AS BIGINT))), lambda c, s: xor(c >> 8, t[(xor(c, s) & 255) + 1])), 4294967295) % 9 AS h FROM g, crc),
b AS (SELECT h.conv_id, coalesce(p.x[1:h.h], []) || h.x[h.h + 1:] AS x, coalesce(p.y[1:h.h], []) || h.y[h.h + 1:] AS y FROM h LEFT JOIN g p ON p.conv_id = h.thread),
r AS (SELECT conv_id, unnest(range(0, len(x) + 1)) AS depth, x, y FROM b),
q AS (SELECT r.conv_id, depth, array_to_string(x[1:depth], ',') AS name, CASE WHEN depth > 0 THEN y[depth] ELSE 0 END AS bytes, depth = len(x) AS ends FROM r),
path AS (SELECT *, min(conv_id) OVER (PARTITION BY name) AS node FROM q),
n AS (SELECT node AS conv_id, depth, count(*) AS n_convs, any_value(bytes) AS bytes,
  sha256(coalesce(string_agg(CASE WHEN ends THEN CAST(conv_id AS VARCHAR) END, ',' ORDER BY conv_id), '')) AS ends_sha256 FROM path GROUP BY node, depth),
c AS (SELECT n.*, p.node AS parent_conv_id FROM n LEFT JOIN path p ON p.conv_id = n.conv_id AND p.depth = n.depth - 1),
k AS (SELECT parent_conv_id AS conv_id, depth - 1 AS depth, count(*) AS kids FROM c WHERE depth > 0 GROUP BY ALL),
a AS (SELECT c.*, coalesce(kids, 0) AS n_children FROM c LEFT JOIN k USING (conv_id, depth)),
s AS (SELECT p.node AS conv_id, p.depth, count(*) FILTER (WHERE a.n_children = 0) AS n_leaves, CAST(sum((a.n_convs - 1) * a.bytes) AS BIGINT) AS saved_tokens
  FROM a JOIN path p ON p.conv_id = a.conv_id AND p.depth <= a.depth GROUP BY ALL)
SELECT a.conv_id, a.depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 FROM a JOIN s USING (conv_id, depth)"""

ORACLES = {
    "op1_url_filter": _URLS,
    "op10_temperature_mixing": _MIXING,
    "op11_collocations": _COLLOCATIONS,
    "op12_jaccard_join": _JACCARD,
    "op13_prefix_trie": _TRIE,
    "op4_adaptive_quality": _QUALITY,
    "op5_near_duplicates": _NEAR,
    "op6_nearest": _NEAREST,
}
