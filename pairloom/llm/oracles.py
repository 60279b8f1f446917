"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from . import mixing, quality, substrings, urls
from .common import WORD_CLASS

_WORDS = f"'{WORD_CLASS}+'"

QUALITY = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT rid, doc_id, source, t, regexp_extract_all(t, {_WORDS}) AS ws FROM d),
cut AS (SELECT rid, source, md5(t) AS doc, unnest(string_split(t, chr(10))) AS line FROM d),
lines AS (SELECT rid, source, doc, line, len(ws) AS n, lower(regexp_replace(array_to_string(ws, ' '), '[0-9]+', '0', 'g')) AS norm
          FROM (SELECT *, regexp_extract_all(line, {_WORDS}) AS ws FROM cut) WHERE len(ws) > 0),
frequent AS (SELECT source, norm FROM lines GROUP BY source, norm HAVING count(DISTINCT doc) > {quality.MAX_LINE_DOCS}),
removed AS (SELECT l.rid, count(*) AS n_lines, sum(l.n) AS n_words
            FROM lines l JOIN frequent f ON l.norm = f.norm AND l.source IS NOT DISTINCT FROM f.source GROUP BY l.rid),
dups AS (SELECT rid, count(*) - count(DISTINCT line) AS n FROM lines GROUP BY rid),
grams AS (SELECT rid, i, array_to_string(ws[i:i + {quality.WINDOW - 1}], ' ') AS g FROM (SELECT rid, ws, unnest(generate_series(1, len(ws) - {quality.WINDOW - 1})) AS i FROM w)),
again AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS n FROM grams) WHERE n > 1),
repeats AS (SELECT rid, count(DISTINCT j) AS n FROM (SELECT rid, unnest(generate_series(i, i + {quality.WINDOW - 1})) AS j FROM again) GROUP BY rid),
s AS (SELECT w.doc_id, len(w.ws)::BIGINT AS n_words, length(array_to_string(w.ws, ''))::BIGINT AS word_chars,
             (length(w.t) - length(regexp_replace(w.t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
             coalesce(dups.n, 0)::BIGINT AS n_dup_lines, coalesce(repeats.n, 0)::BIGINT AS n_repeat_words,
             coalesce(removed.n_lines, 0)::BIGINT AS n_removed_lines, (len(w.ws) - coalesce(removed.n_words, 0))::BIGINT AS n_left_words
      FROM w LEFT JOIN dups USING (rid) LEFT JOIN repeats USING (rid) LEFT JOIN removed USING (rid)),
f AS (SELECT *, n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > {quality.MAX_REPEAT_PERCENT} * n_words AS base_failed FROM s)
SELECT *, NOT base_failed AND n_left_words >= {quality.MIN_WORDS} AS kept FROM f
"""

NEAR_DUP = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), {_WORDS}) AS ws
                     FROM documents),
sh AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 2], ' ') AS g FROM (SELECT doc_id, ws, unnest(generate_series(1, greatest(len(ws) - 2, 1))) AS i FROM d WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
common AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM sh a JOIN sh b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT x, y FROM common JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * c >= 85 * (p.n + q.n - c)),
edges AS (SELECT x, y FROM links UNION SELECT y, x FROM links),
reach(a, b) AS (SELECT x, y FROM edges UNION SELECT r.a, e.y FROM reach r JOIN edges e ON e.x = r.b),
least_of AS (SELECT a, min(b) AS m FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(l.m, d.doc_id)) AS component_id,
       d.doc_id <= coalesce(l.m, d.doc_id) AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN least_of l ON l.a = d.doc_id
"""

SUBSTRINGS = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), {_WORDS}) AS ws FROM documents),
w AS (SELECT rid, doc_id, i, md5(array_to_string(ws[i:i + {substrings.WINDOW - 1}], ' ')) AS h
      FROM (SELECT *, unnest(generate_series(1, len(ws) - {substrings.WINDOW - 1})) AS i FROM d)),
first_of AS (SELECT h, min(doc_id) AS least FROM w GROUP BY h HAVING count(*) > 1),
gone AS (SELECT DISTINCT rid, unnest(generate_series(i, i + {substrings.WINDOW - 1})) AS j FROM w JOIN first_of USING (h) WHERE doc_id > least),
words AS (SELECT rid, generate_subscripts(ws, 1) AS j, unnest(ws) AS word FROM d),
kept AS (SELECT rid, count(*) AS n, string_agg(word, ' ' ORDER BY j) AS t FROM words ANTI JOIN gone USING (rid, j) GROUP BY rid)
SELECT d.doc_id, len(d.ws)::BIGINT AS n_words, (len(d.ws) - coalesce(kept.n, 0))::BIGINT AS n_removed, sha256(coalesce(kept.t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (rid)
"""

MIXING = rf"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), {_WORDS}))::BIGINT AS size,
                  ('0x' || substr(md5('{mixing.SEED}:' || doc_id::VARCHAR), 1, 15))::BIGINT AS key FROM documents),
src AS (SELECT source, sum(size) AS s, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS k FROM d GROUP BY source),
wt AS (SELECT source, s, ([{', '.join(f'{w}.0' for w in mixing.WEIGHTS)}]::DOUBLE[])[(k % {len(mixing.WEIGHTS)} + 1)::INTEGER] AS w FROM src),
-- the sources that stop are the first c in order of limit per weight
r AS (SELECT *, row_number() OVER (ORDER BY {mixing.MAX_EPOCHS} * s / w, source NULLS LAST) AS i FROM wt),
cand AS (SELECT c.c, (SELECT sum(s) FROM r)::DOUBLE AS total, coalesce((SELECT sum({mixing.MAX_EPOCHS} * s) FROM r WHERE i <= c.c), 0)::DOUBLE AS spent,
                (SELECT sum(w) FROM r WHERE i > c.c) AS free FROM (SELECT unnest(generate_series(0, (SELECT count(*) FROM r))) AS c) c),
best AS (SELECT * FROM cand WHERE free IS NULL OR NOT EXISTS (SELECT 1 FROM r WHERE r.i > cand.c AND (cand.total - cand.spent) * r.w / cand.free > {mixing.MAX_EPOCHS} * r.s)
         ORDER BY c LIMIT 1),
t AS (SELECT r.source, r.s, CASE WHEN r.i <= best.c THEN ({mixing.MAX_EPOCHS} * r.s)::DOUBLE ELSE (best.total - best.spent) * r.w / best.free END AS target FROM r, best),
p AS (SELECT d.doc_id, d.size, t.s::BIGINT AS source_size, t.target, floor(t.target)::BIGINT AS budget,
             coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       (CASE WHEN source_size = 0 THEN 0 ELSE (budget // source_size) * size + greatest(0, least(size, budget % source_size - before)) END)::BIGINT AS taken
FROM p
"""


def _tokens_sql() -> str:
    some = lambda text, at, kind: f"list_transform(list_filter(string_split({text}, '{at}'), lambda x: x <> ''), lambda x: '{kind}' || regexp_replace(x, '[0-9]+', '0', 'g'))"
    parts = [some("host", ".", "host="), some("path", "/", "path="),
             some(r"coalesce(regexp_extract(url, '(?s)\?([^#]*)', 1), '')", "&", "query="), some("coalesce(regexp_extract(url, '(?s)#(.*)', 1), '')", "&", "mark=")]
    return "list_sort(list_distinct(" + "list_concat(" * 3 + f"{parts[0]}, {parts[1]}), {parts[2]}), {parts[3]})))"


def _rule_sql() -> str:
    whens = []
    for verdict, rule in sorted(urls.RULES, key=lambda r: -len(r[1])):
        of, slash, start = rule.partition("/")
        whens.append(f"WHEN (host = '{of}' OR ends_with(host, '.{of}')) AND starts_with(path, '{slash}{start}') THEN '{verdict} {rule}'")
    return "CASE " + " ".join(whens) + " END"


URLS = rf"""
WITH p AS (SELECT page_id, url, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                  coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path FROM pages),
t AS (SELECT *, {_tokens_sql()} AS tokens, {_rule_sql()} AS explicit FROM p),
marks AS (SELECT doc_id, max(CASE WHEN quality = 0 OR toxic = 1 THEN 1 WHEN quality <> 0 AND toxic <> 1 THEN 0 END) AS bad FROM labels GROUP BY doc_id),
lab AS (SELECT row_number() OVER () AS rid, t.tokens, marks.bad FROM t JOIN marks ON t.page_id = marks.doc_id WHERE marks.bad IS NOT NULL),
n AS (SELECT count(*) AS n, greatest(ceil({urls.MIN_SHARE} * count(*)), {urls.MIN_COUNT}) AS least FROM lab),
often AS (SELECT token, count(*) AS c FROM (SELECT unnest(tokens) AS token FROM lab) GROUP BY token),
useful AS (SELECT coalesce(list(token), []) AS ts FROM often WHERE c >= {urls.MIN_COUNT}),
x AS (SELECT rid, bad, list_filter(tokens, lambda t: list_contains(useful.ts, t)) AS ts FROM lab, useful),
subs AS (SELECT bad, list_filter(ts, lambda t, i: (b >> (i - 1)::INTEGER) & 1 = 1) AS part FROM (SELECT bad, ts, unnest(generate_series(1, (1 << len(ts)::INTEGER) - 1)) AS b FROM x WHERE len(ts) > 0)),
rules AS (SELECT part, sum(bad)::DOUBLE / count(*) AS confidence, sum(bad) / n.n::DOUBLE AS support FROM subs, n GROUP BY part, n.n, n.least
          HAVING sum(bad) >= CASE WHEN len(part) = 1 THEN {urls.MIN_COUNT} ELSE n.least END AND sum(bad)::DOUBLE / count(*) >= {urls.MIN_CONFIDENCE}),
kept AS (SELECT * FROM rules r WHERE NOT EXISTS (SELECT 1 FROM rules q WHERE len(q.part) < len(r.part) AND list_has_all(r.part, q.part) AND q.confidence >= r.confidence)),
hit AS (SELECT u.url, max({{'c': k.confidence, 's': k.support, 'r': array_to_string(k.part, ' ')}}) AS m
        FROM (SELECT DISTINCT url, tokens FROM t WHERE explicit IS NULL AND url IS NOT NULL) u JOIN kept k ON list_has_all(u.tokens, k.part) GROUP BY u.url)
SELECT t.page_id, t.host, t.path, split_part(t.explicit, ' ', 2) AS rule,
       CASE WHEN t.explicit IS NOT NULL THEN split_part(t.explicit, ' ', 1) WHEN hit.m IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict,
       hit.m.r AS mined_rule, hit.m.c AS confidence
FROM t LEFT JOIN hit ON hit.url = t.url
"""
