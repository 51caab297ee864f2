"""DuckDB SQL with the same results as the queries that SQL can express."""

from codequarry.llm.license_rules import FRAMED, SPDX_NEXT, STATED

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

NEAR_DUP = rf"""
WITH RECURSIVE
 w AS (SELECT doc_id, list_filter(string_split_regex({_LOWER}, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
 s AS (SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
         ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END) AS s FROM w),
 n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
 c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
 l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
 r(id, c) AS (SELECT doc_id, doc_id FROM documents UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.id),
 m AS (SELECT id, min(c) AS c FROM r GROUP BY id)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, m.c AS component_id, m.c = d.doc_id AS kept
FROM documents d JOIN m ON m.id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
"""

DECONTAMINATE = rf"""
WITH
 d AS (SELECT doc_id, list_filter(string_split_regex({_LOWER}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
 b AS (SELECT item_id, list_filter(string_split_regex({_LOWER}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
 p AS (SELECT DISTINCT item_id, unnest(CASE WHEN len(w) = 0 THEN [] ELSE list_transform(range(1, greatest(len(w) - 9, 1) + 1), lambda i: w[i : i + 9]) END) AS p FROM b),
 g AS (SELECT DISTINCT len(p) AS n FROM p),
 x AS (SELECT doc_id, n, unnest(range(1, greatest(len(w) - n + 1, 0) + 1)) AS i, w FROM d, g),
 h AS (SELECT x.doc_id, x.i, x.n, p.item_id FROM x JOIN p ON p.p = x.w[x.i : x.i + x.n - 1]),
 k AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS j FROM h) GROUP BY doc_id),
 t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM h) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN k ON k.doc_id = d.doc_id LEFT JOIN t ON t.doc_id = d.doc_id
"""

EMBEDDING_DUP = """
WITH RECURSIVE
 e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings WHERE embedding IS NOT NULL),
 l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.v, b.v) >= 0.95),
 r(id, c) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.id),
 m AS (SELECT id, min(c) AS c FROM r GROUP BY id),
 n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT m.id AS vec_id, coalesce(n.n, 0)::BIGINT AS n_links, m.c AS component_id, m.c = m.id AS kept FROM m LEFT JOIN n ON n.a = m.id
"""


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def secrets_sql(kinds: list, n_base: int, placeholders: list[str]) -> str:
    """Query op6 for the given kinds (name, regex, group, least length, gate)."""
    found = " UNION ALL ".join(
        f"SELECT row, {k} AS rank, '{name}' AS kind, {least} AS least, string_split_regex(t, {_quoted(regex)}) AS gaps, regexp_extract_all(t, {_quoted(regex)}, 0) AS hits, regexp_extract_all(t, {_quoted(regex)}, {group}) AS vals FROM d"
        for k, (name, regex, group, least, _) in enumerate(kinds)
    )
    named = " OR ".join(f"contains(lower(v), '{p}')" for p in placeholders)
    text = lambda cond: f"coalesce(string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank){cond}, '')"
    return f"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS t, concat_ws('/', source, lang) AS repo, source AS owner FROM documents),
 m AS ({found}),
 u AS (SELECT row, rank, kind, least, gaps, hits, vals, unnest(range(1, len(hits) + 1)) AS i FROM m),
 s AS (SELECT row, rank, kind, (list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(hits[1:i - 1], lambda x: length(x))), 0))::BIGINT AS start, length(hits[i]) AS n, vals[i] AS v FROM u WHERE length(vals[i]) >= least),
 p AS (SELECT s.*, start + n AS stop, d.repo, d.owner, len(list_distinct(string_split(v, ''))) >= 6 AND NOT ({named}) AS looks FROM s JOIN d ON d.row = s.row),
 o AS (SELECT v, count(DISTINCT owner) > 2 OR count(DISTINCT repo) > 4 AS copied FROM p GROUP BY v),
 g AS (SELECT row, count(*) FILTER (rank = 0) AS n_assign, count(*) FILTER (rank = 1) AS n_access, count(*) FILTER (rank = 2) AS n_hex, {text(f" FILTER (rank < {n_base})")} AS base, {text("")} AS spans,
   count(*) FILTER (copied) AS n_copied, count(*) FILTER (looks AND NOT copied) AS n_live FROM p JOIN o ON o.v = p.v GROUP BY row)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_copied, 0) AS n_copied, coalesce(n_live, 0) AS n_live
FROM d LEFT JOIN g ON g.row = d.row
"""


def licenses_sql(rules: list, phrases: list) -> str:
    """Query op8 for the given rules (priority, label, keyword, regex, weight) and phrases.

    Keywords are used only by rules for further SPDX identifiers: the others run on every text. RE2 has no look-around: blanks are doubled,
    so that neighbouring matches don't share one.
    """
    doubled = lambda r: r.replace(" ?", "(?:  )?").replace(" ", "  ").replace("(?:    )?", "(?:  )?")
    values = ", ".join(f"({p}, '{la}', {_quoted(' ' + doubled(r) + ' ')}, {w}, '{k.replace(' ', '  ') if r.startswith(SPDX_NEXT) else ''}')" for p, la, k, r, w in rules)
    places = " UNION ALL ".join(f"SELECT row, '{label}' AS label, unnest(list_filter(range(0, len(w)), lambda i: w[i + 1 : i + {len(p.split())}] = {p.split()})) AS i FROM d" for p, label in phrases)
    return rf"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, list_filter(string_split_regex({_LOWER}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
 k(priority, label, regex, weight, needs) AS (VALUES {values}),
 n AS (SELECT row, '  ' || array_to_string(w, '  ') || '  ' AS norm, w FROM d),
 m AS (SELECT row, priority, label, weight::DOUBLE AS weight, string_split_regex(norm, regex) AS gaps, regexp_extract_all(norm, regex) AS hits FROM n JOIN k ON contains(norm, needs) AND regexp_matches(norm, regex)),
 u AS (SELECT row, priority, label, weight, gaps, hits, unnest(range(1, len(hits) + 1)) AS i FROM m),
 f AS (SELECT row, priority, label, greatest(weight, CASE WHEN regexp_matches(hits[i], '^ (licen[cs]ed|released|distributed|published|available|provided|redistributable)  under ') THEN {STATED} WHEN starts_with(hits[i], ' under ') THEN {FRAMED} ELSE 0 END) AS weight, list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(hits[1:i - 1], lambda x: length(x))), 0) AS a, length(hits[i]) AS len FROM u),
 s AS (SELECT * FROM f WHERE NOT EXISTS (SELECT 1 FROM f e WHERE e.row = f.row AND e.a <= f.a AND e.a + e.len >= f.a + f.len AND (e.len > f.len OR e.priority < f.priority))),
 p AS ({places}),
 b AS (SELECT row, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM p GROUP BY row),
 l AS (SELECT row, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT row, label FROM p UNION ALL SELECT row, label FROM s) GROUP BY row),
 c AS (SELECT row, max(weight) AS score FROM s GROUP BY row)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0)::DOUBLE AS score
FROM d LEFT JOIN b ON b.row = d.row LEFT JOIN l ON l.row = d.row LEFT JOIN c ON c.row = d.row
"""


def vector_codes_sql(parts: int, entries: int, rounds: int, scale: int) -> str:
    """Product codes after so many rounds of Lloyd's method, all in whole numbers."""
    nearest = """
 a{k} AS (SELECT p.vec_id, p.p, arg_min(b.e, {d} * {entries} + b.e) AS e, min({d}) AS d
          FROM p JOIN b{k} b ON b.p = p.p GROUP BY p.vec_id, p.p)"""
    moved = """
 s{k} AS (SELECT p.p, a.e, i, floor(sum(p.x[i]) / count(*))::BIGINT AS x FROM p JOIN a{k} a ON a.vec_id = p.vec_id AND a.p = p.p, range(1, w + 1) r(i) GROUP BY 1, 2, 3),
 b{n} AS (SELECT b.p, b.e, coalesce(s.x, b.x) AS x FROM b{k} b LEFT JOIN (SELECT p, e, list(x ORDER BY i) AS x FROM s{k} GROUP BY 1, 2) s ON s.p = b.p AND s.e = b.e)"""
    d = "list_sum(list_transform(range(1, w + 1), lambda i: (p.x[i] - b.x[i]) * (p.x[i] - b.x[i])))::BIGINT"
    steps = [nearest.format(k=0, d=d, entries=entries)]
    for k in range(rounds):
        steps += [moved.format(k=k, n=k + 1), nearest.format(k=k + 1, d=d, entries=entries)]
    return f"""
WITH
 v AS (SELECT vec_id, label, list_transform(embedding, lambda c: floor(c::DOUBLE * {scale})::BIGINT) AS x FROM embeddings
       WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
 p AS (SELECT vec_id, label, p, x[p * (len(x) // {parts}) + 1 : (p + 1) * (len(x) // {parts})] AS x, len(x) // {parts} AS w FROM v, range(0, {parts}) r(p)),
 f AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM v ORDER BY vec_id LIMIT {entries}),
 b0 AS (SELECT p.p, f.e, p.x FROM p JOIN f ON f.vec_id = p.vec_id),{",".join(steps)},
 c AS (SELECT a.vec_id, string_agg(printf('%02x', a.e), '' ORDER BY a.p) AS code, sum(a.d)::BIGINT AS error FROM a{rounds} a GROUP BY a.vec_id),
 l AS (SELECT v.vec_id, v.label, c.code, c.error FROM v JOIN c ON c.vec_id = v.vec_id),
 h AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY p, e)) AS h FROM b{rounds})
SELECT l.vec_id, l.code, l.error, (sum(l.error) OVER (PARTITION BY l.label))::BIGINT AS label_error, h.h AS codebooks_sha256 FROM l, h
"""
