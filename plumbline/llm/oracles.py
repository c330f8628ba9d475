"""DuckDB SQL for the corpus operators that SQL can say: quality rules, mixing, revisit resolution, code compression and hard negatives."""

from __future__ import annotations

from plumbline.llm import codes, mixing, negatives, quality, warc

WORD = r"[^\x20\x09-\x0D]+"


def quality_sql() -> str:
    """Counts by lists of words, windows of five words by their positions, and fences from logarithmic bins."""
    rates = {k: sql.split(" / ") for k, (sql, _) in quality.RATES.items()}
    bin_of = lambda c: f"CASE WHEN {c} < {quality.LEAST} THEN 0 ELSE ceil(ln({c} / {quality.LEAST}) / ln({quality.GAMMA}::DOUBLE))::INT END"
    value = f"CASE WHEN bin = 0 THEN 0.0 ELSE {quality.LEAST} * power({quality.GAMMA}::DOUBLE, bin - 0.5) END"
    names = [f"q{q}_{k}" for k in quality.SKETCHED for q in (50, 75)]

    def quartiles(name: str, keys: str) -> str:
        own = f"{keys}, " if keys else ""
        each = f"SELECT {own}rate, bin, sum(n) AS n FROM fine GROUP BY {own}rate, bin"
        run = f"SELECT {own}rate, bin, sum(n) OVER (PARTITION BY {own}rate ORDER BY bin) AS upto, sum(n) OVER (PARTITION BY {own}rate) AS docs FROM ({each})"
        found = ", ".join(f"min({value}) FILTER (WHERE rate = '{k}' AND upto >= {q / 100} * docs) AS q{q}_{k}" for k in quality.SKETCHED for q in (50, 75))
        return f"{name} AS (SELECT {own}max(docs) AS docs, {found} FROM ({run}){f' GROUP BY {keys}' if keys else ''})"

    pick = ", ".join(f"CASE WHEN f.docs >= {quality.MIN_DOCS} THEN f.{c} WHEN fl.docs >= {quality.MIN_DOCS} THEN fl.{c} ELSE fa.{c} END AS {c}" for c in names)
    fences = ", ".join(f"q75_{k} + {quality.SPREAD}::DOUBLE * greatest(q75_{k} - q50_{k}, {unit}) AS max_{k}" for k, (_, unit) in quality.RATES.items())
    return f"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, lang, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT k, doc_id, lang, source, t, regexp_extract_all(t, '{WORD}') AS ws FROM d),
each AS (SELECT k, unnest(range(1, len(ws) + 1)) AS i, unnest(ws) AS x FROM w),
five AS (SELECT k, i, x || ' ' || {" || ' ' || ".join(f"lead(x, {j}) OVER text" for j in range(1, 5))} AS f FROM each WINDOW text AS (PARTITION BY k ORDER BY i)),
again AS (SELECT k, i FROM five WHERE f IS NOT NULL QUALIFY count(*) OVER (PARTITION BY k, f) > 1),
rep AS (SELECT k, count(DISTINCT i + o) AS n FROM again, (SELECT unnest(range(0, 5)) AS o) GROUP BY k),
ln AS (SELECT k, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{WORD}')) AS ls FROM d),
c AS (SELECT doc_id, lang, source, len(ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
  len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words
  FROM w JOIN ln USING (k) LEFT JOIN rep USING (k)),
r AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, {", ".join(f"coalesce({a}::DOUBLE / nullif({b}, 0), 0) AS {k}" for k, (a, b) in rates.items())} FROM c),
binned AS ({" UNION ALL ".join(f"SELECT lang, source, '{k}' AS rate, {bin_of(k)} AS bin FROM r WHERE NOT base_failed" for k in quality.SKETCHED)}),
fine AS (SELECT lang, source, rate, bin, count(*) AS n FROM binned GROUP BY ALL),
{quartiles("f", "lang, source")}, {quartiles("fl", "lang")}, {quartiles("fa", "")},
picked AS (SELECT f.lang, f.source, {pick} FROM f JOIN fl ON f.lang IS NOT DISTINCT FROM fl.lang CROSS JOIN fa),
lim AS (SELECT lang, source, {fences} FROM picked)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND {" AND ".join(f"{k} <= coalesce(max_{k}, 'Infinity'::DOUBLE)" for k in rates)} AS kept
FROM r LEFT JOIN lim ON r.lang IS NOT DISTINCT FROM lim.lang AND r.source IS NOT DISTINCT FROM lim.source"""


def mixing_sql() -> str:
    """All seats ranked one by one, and all blocks of a stream listed."""
    b, cap, seed = mixing.BLOCK, mixing.CAP, mixing.SEED
    return f"""
WITH s AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}'))::BIGINT AS size,
  md5(concat_ws('|', coalesce(doc_id::VARCHAR, ''), coalesce(md5(text), ''), '{seed}')) AS tag FROM documents),
t AS (SELECT source, sum(size)::BIGINT AS source_size, count(*) FILTER (WHERE size > 0) AS docs FROM s GROUP BY source),
o AS (SELECT *, ((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1)::DOUBLE AS weight FROM t),
u AS (SELECT *, {cap} * source_size / weight AS until FROM o),
l AS (SELECT *, ((SELECT sum(source_size) FROM t) - coalesce(sum({cap} * source_size) OVER before, 0)) / ((SELECT sum(weight) FROM o) - coalesce(sum(weight) OVER before, 0)) AS level
  FROM u WINDOW before AS (ORDER BY until, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
lv AS (SELECT coalesce((SELECT level FROM l WHERE level <= until ORDER BY until, source IS NULL, source LIMIT 1), 0) AS level),
g AS (SELECT source, source_size, docs, least(({cap} * source_size)::DOUBLE, lv.level * weight) AS target FROM u, lv),
q AS (SELECT source, target / (2 * unnest(range(0, (SELECT floor(sum(target) / {b} + 0.5)::BIGINT FROM g))) + 1) AS q FROM g WHERE target > 0),
won AS (SELECT source FROM q ORDER BY q DESC, source IS NOT NULL, source LIMIT (SELECT floor(sum(target) / {b} + 0.5)::BIGINT FROM g)),
seats AS (SELECT g.*, (SELECT count(*) FROM won WHERE won.source IS NOT DISTINCT FROM g.source) AS seats FROM g),
x AS (SELECT s.*, seats.source_size, seats.target, seats.seats, CASE WHEN size > 0 THEN ('0x' || substr(tag, 1, 8))::BIGINT % greatest(docs // {mixing.SHARD_DOCS}, 1) END AS shard FROM s JOIN seats ON s.source IS NOT DISTINCT FROM seats.source),
m AS (SELECT source, shard, sum(size)::BIGINT AS stream, any_value(seats) AS seats FROM x WHERE size > 0 GROUP BY source, shard),
mq AS (SELECT source, shard, seats, stream::DOUBLE / (2 * unnest(range(0, seats)) + 1) AS q FROM m),
mw AS (SELECT source, shard, count(*) AS quota FROM (SELECT source, shard, seats, row_number() OVER (PARTITION BY source ORDER BY q DESC, shard) AS n FROM mq) WHERE n <= seats GROUP BY source, shard),
p AS (SELECT m.source, m.shard, m.stream, least(coalesce(quota, 0) * {b}, m.stream * {cap}) AS words FROM m LEFT JOIN mw ON m.source IS NOT DISTINCT FROM mw.source AND m.shard = mw.shard),
pp AS (SELECT *, words // stream AS passes, stream // {b} AS blocks, (words - words // stream * stream) // {b} AS full_, (words - words // stream * stream) % {b} AS part FROM p),
bl AS (SELECT pp.*, unnest(range(0, blocks)) AS i FROM pp),
bo AS (SELECT *, row_number() OVER (PARTITION BY source, shard ORDER BY md5(concat_ws('|', coalesce(source, ''), shard::VARCHAR, i::VARCHAR, '{seed}')), i) - 1 AS turn FROM bl),
tk AS (SELECT source, shard, i * {b} AS a, i * {b} + CASE WHEN turn < full_ THEN {b} WHEN turn = full_ THEN part ELSE 0 END AS z FROM bo
  UNION ALL SELECT source, shard, blocks * {b}, blocks * {b} + CASE WHEN full_ = blocks THEN part ELSE 0 END FROM pp),
e AS (SELECT *, sum(size) OVER (PARTITION BY source, shard ORDER BY tag, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size AS first, row_number() OVER () AS k FROM x WHERE size > 0),
ex AS (SELECT e.k, sum(greatest(0, least(e.first + e.size, tk.z) - greatest(e.first, tk.a))) AS extra FROM e JOIN tk ON e.source IS NOT DISTINCT FROM tk.source AND e.shard = tk.shard AND tk.z > e.first AND tk.a < e.first + e.size GROUP BY e.k)
SELECT e.doc_id, e.size, e.source_size::BIGINT AS source_size, e.target, (pp.passes * e.size + coalesce(ex.extra, 0))::BIGINT AS taken
FROM e JOIN pp ON e.source IS NOT DISTINCT FROM pp.source AND e.shard = pp.shard LEFT JOIN ex USING (k)
UNION ALL SELECT doc_id, size, source_size::BIGINT, target, 0 FROM x WHERE size = 0"""


def revisits_sql() -> str:
    """Headers as lists of names and values, and the last full response before each record by a window over its URL."""
    parts = "^(?:[A-Za-z][A-Za-z0-9+.-]*://)?([^/?#]*)([^?#]*)(?:\\?([^#]*))?"
    time = "strftime(TIMESTAMP '2023-11-14 22:13:20' + to_seconds({0}), '%Y-%m-%d %H:%M:%S')".format
    dated = "page_id % 20 IN (6, 7)"
    fields = lambda pairs: "list_filter([" + ", ".join(f"{{'k': '{k}', 'v': {v}}}" for k, v in pairs) + "], lambda x: x.v IS NOT NULL)"
    full = fields([("content-type", "'text/html; charset=utf-8'"), ("content-length", "strlen(html)::VARCHAR"), ("etag", f"CASE WHEN NOT {dated} THEN tag END"), ("last-modified", f"CASE WHEN {dated} THEN {time('page_id * 60')} END"), ("date", time("page_id * 60")), ("cache-control", "'max-age=600'"), ("server", "'first'")])
    again = fields([("etag", f"CASE WHEN page_id % 20 = 1 THEN '\"other\"' WHEN NOT {dated} AND page_id % 20 <> 2 THEN 'W/' || tag END"), ("last-modified", f"CASE WHEN {dated} THEN {time('page_id * 60 + CASE WHEN page_id % 20 = 7 THEN 1 ELSE 0 END')} END"), ("date", time("page_id * 60 + 604800")), ("cache-control", "'max-age=86400'"), ("content-length", "'0'"), ("server", "'second'")])
    value = "list_filter({0}, lambda x: x.k = '{1}')[1].v".format
    tag = lambda h: f"regexp_replace({value(h, 'etag')}, '^W/', '')"
    permitted = ", ".join(f"'{x}'" for x in warc.PERMITTED)
    return f"""
WITH p AS (SELECT page_id, url, html, '"' || substr(md5(html), 1, 16) || '"' AS tag, 'sha1:' || sha1(html) AS digest FROM pages),
rec AS (SELECT page_id * 2 AS record_id, page_id, url, page_id * 60 AS ts, 'response' AS kind, digest AS payload, {full} AS h FROM p WHERE page_id % 20 <> 3
  UNION ALL SELECT page_id * 2 + 1, page_id, CASE WHEN page_id % 20 <> 8 THEN url END, page_id * 60 + 604800, 'revisit', NULL, {again} FROM p),
u AS (SELECT *, trim(url, ' ') AS u FROM rec),
v AS (SELECT *, regexp_replace(regexp_replace(lower(regexp_extract(u, '{parts}', 1)), '^www\\.', ''), ':(80|443)?$', '') AS host,
  regexp_replace(regexp_replace(regexp_extract(u, '{parts}', 2), '/{{2,}}', '/', 'g'), '/(index\\.html?)?$', '') AS path,
  array_to_string(list_sort(list_filter(string_split(regexp_extract(u, '{parts}', 3), '&'), lambda x: x <> '' AND NOT regexp_matches(x, '{warc.TRACKING}'))), '&') AS q FROM u),
k AS (SELECT record_id, page_id, ts, kind, payload, h, CASE WHEN u <> '' THEN host || path || CASE WHEN q <> '' THEN '?' || q ELSE '' END END AS key FROM v),
a AS (SELECT *, last_value(CASE WHEN kind = 'response' THEN {{'id': record_id, 'payload': payload, 'h': h}} END IGNORE NULLS) OVER (PARTITION BY key ORDER BY ts, record_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS o FROM k),
b AS (SELECT *, coalesce({tag('h')} = {tag('o.h')}, {value('h', 'last-modified')} = {value('o.h', 'last-modified')}) AS same FROM a WHERE kind = 'revisit'),
s AS (SELECT *, CASE WHEN key IS NULL THEN 'no_url' WHEN o IS NULL THEN 'no_response' WHEN same IS NULL THEN 'unverified' WHEN same THEN 'resolved' ELSE 'changed' END AS status, list_filter(h, lambda x: x.k IN ({permitted})) AS allowed FROM b),
m AS (SELECT *, CASE WHEN status IN ('resolved', 'unverified') THEN list_concat(list_filter(o.h, lambda x: NOT list_contains(list_transform(allowed, lambda y: y.k), x.k)), allowed) END AS n FROM s)
SELECT page_id, record_id, key AS canonical_url, status, CASE WHEN key IS NOT NULL THEN o.id END AS of_record_id, CASE WHEN n IS NOT NULL THEN o.payload END AS payload,
  {value('n', 'etag')} AS etag, {value('n', 'date')} AS date, coalesce(len(n), 0)::INT AS n_headers,
  array_to_string(list_sort(list_transform(list_filter(n, lambda x: x.k NOT IN ('etag', 'date')), lambda x: x.k || '=' || x.v)), ';') AS other_headers FROM m"""

#: Rows of ``embeddings`` with a whole vector.
KEPT = "embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"


def codes_sql() -> str:
    """Every point against every entry, in as many steps as there are rounds."""
    parts, width = codes.PARTS, f"(dim // {codes.PARTS})"
    steps = []
    for i in range(codes.ROUNDS + 1):
        steps.append(f"""a{i} AS MATERIALIZED (SELECT k, part, arg_min(entry, d * {codes.ENTRIES} + entry) AS entry, min(d) AS d
  FROM (SELECT x.k, x.part, c.entry, sum((x.v - c.v) * (x.v - c.v))::BIGINT AS d FROM x JOIN c{i} c USING (part, pos) GROUP BY ALL) GROUP BY k, part)""")
        if i < codes.ROUNDS:
            steps.append(f"""c{i + 1} AS MATERIALIZED (SELECT part, entry, pos, coalesce(s.v, c.v) AS v FROM c{i} c
  LEFT JOIN (SELECT part, entry, pos, floor(sum(v)::DOUBLE / count(*))::BIGINT AS v FROM x JOIN a{i} USING (k, part) GROUP BY ALL) s USING (part, entry, pos))""")
    last = codes.ROUNDS
    return f"""
WITH r AS (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS k, vec_id, label, len(embedding) AS dim, list_transform(embedding, lambda v: floor({codes.SCALE} * v::DOUBLE)::BIGINT) AS v FROM embeddings WHERE {KEPT}),
l AS (SELECT k, dim, unnest(range(0, dim)) AS i, unnest(v) AS v FROM r),
x AS MATERIALIZED (SELECT k, i // {width} AS part, i % {width} AS pos, v FROM l),
c0 AS MATERIALIZED (SELECT part, k AS entry, pos, v FROM x WHERE k < {codes.ENTRIES}),
{", ".join(steps)},
h AS (SELECT sha256(string_agg(v::VARCHAR, ',' ORDER BY part, entry, pos)) AS digest FROM c{last}),
o AS (SELECT k, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM a{last} GROUP BY k)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, digest AS codebooks_sha256 FROM r JOIN o USING (k), h"""


def negatives_sql() -> str:
    """Every anchor against every row."""
    return f"""
WITH r AS (SELECT row_number() OVER () AS k, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
  list_transform(embedding, lambda v: floor({negatives.SCALE} * v::DOUBLE)) AS v FROM embeddings WHERE label IS NOT NULL AND {KEPT}),
s AS (SELECT a.k AS ak, a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score FROM r a JOIN r b ON a.k <> b.k WHERE a.vec_id % 50 = 0),
p AS (SELECT ak, anchor_id, vec_id AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY ak ORDER BY score DESC, vec_id) AS place FROM s WHERE same QUALIFY place <= {negatives.POSITIVES})
SELECT p.anchor_id, positive_id, row_number() OVER (PARTITION BY p.ak, place ORDER BY score DESC, vec_id)::INT AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON s.ak = p.ak AND NOT same AND {negatives.LOW} * positive_score <= 100 * score AND 100 * score <= {negatives.HIGH} * positive_score
QUALIFY rank <= {negatives.NEGATIVES}"""


ORACLES = {"op4_warc": revisits_sql(), "op7_mix": mixing_sql(), "op8_quality": quality_sql(), "op12_codes": codes_sql(), "op13_negatives": negatives_sql()}
