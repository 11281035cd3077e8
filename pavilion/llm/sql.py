"""The queries that SQL can express, in the oracle's dialect. Hash and tokenizer based ones are tested by brute force."""

from __future__ import annotations

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SPACED = r"'[^\x20\x09-\x0D]+'"
_ALNUM = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"


def _words(table: str, key: str, pattern: str, lower: bool) -> str:
    text = f"translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}')" if lower else "coalesce(text, '')"
    return f"SELECT {key}, words, len(words) AS n FROM (SELECT {key}, regexp_extract_all({text}, {pattern}) AS words FROM {table}) t"


SUBSTRING = f"""
WITH d AS MATERIALIZED ({_words('documents', 'doc_id', _SPACED, False)}),
w AS MATERIALIZED (SELECT doc_id, i, array_to_string(words[i:i + 12], ' ') AS win FROM (SELECT doc_id, words, unnest(generate_series(1, n - 12)) AS i FROM d WHERE n >= 13) x),
first AS MATERIALIZED (SELECT win, min(doc_id) AS f FROM w GROUP BY 1 HAVING count(*) > 1),
gone AS MATERIALIZED (SELECT doc_id, list(DISTINCT p) AS lost FROM (SELECT w.doc_id, unnest(generate_series(w.i, w.i + 12)) AS p FROM w JOIN first ON first.win = w.win WHERE first.f < w.doc_id) x GROUP BY 1)
SELECT d.doc_id, CAST(n AS BIGINT) AS n_words, CAST(coalesce(len(lost), 0) AS BIGINT) AS n_removed, sha256(array_to_string(list_filter(words, lambda x, i: NOT coalesce(list_contains(lost, i), FALSE)), ' ')) AS kept_sha256
FROM d LEFT JOIN gone ON gone.doc_id = d.doc_id"""

DECONTAMINATION = f"""
WITH d AS MATERIALIZED ({_words('documents', 'doc_id', _ALNUM, True)}),
b AS MATERIALIZED ({_words('benchmark', 'item_id', _ALNUM, True)}),
g AS MATERIALIZED (SELECT DISTINCT item_id, l, array_to_string(words[i:i + l - 1], ' ') AS win FROM (SELECT item_id, words, least(10, n) AS l, unnest(generate_series(1, n - least(10, n) + 1)) AS i FROM b WHERE n > 0) x),
h AS MATERIALIZED (SELECT w.doc_id, w.i, w.l, g.item_id FROM (SELECT doc_id, l, i, array_to_string(words[i:i + l - 1], ' ') AS win FROM (SELECT d.doc_id, d.words, q.l, unnest(generate_series(1, d.n - q.l + 1)) AS i FROM d, (SELECT DISTINCT l FROM g) q WHERE d.n >= q.l) x) w JOIN g ON g.win = w.win AND g.l = w.l),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + l - 1)) AS p FROM h) x GROUP BY 1),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM h) x GROUP BY 1)
SELECT d.doc_id, CAST(d.n AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN hit ON hit.doc_id = d.doc_id LEFT JOIN items ON items.doc_id = d.doc_id"""

NEAR = f"""
WITH RECURSIVE d AS MATERIALIZED ({_words('documents', 'doc_id', _SPACED, True)}),
s AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(words[i:i + least(4, n - 1)], ' ') || ' ' || least(5, n) AS g FROM (SELECT doc_id, words, n, unnest(generate_series(1, greatest(1, n - 4))) AS i FROM d WHERE n > 0) x),
c AS MATERIALIZED (SELECT doc_id, count(*) AS m FROM s GROUP BY 1),
l AS MATERIALIZED (SELECT x.a, x.b FROM (SELECT p.doc_id AS a, q.doc_id AS b, count(*) AS k FROM s p JOIN s q ON p.g = q.g AND p.doc_id <> q.doc_id GROUP BY 1, 2) x JOIN c ca ON ca.doc_id = x.a JOIN c cb ON cb.doc_id = x.b WHERE 100 * k >= 75 * (ca.m + cb.m - k)),
r AS (SELECT doc_id AS v, doc_id AS reach FROM d UNION SELECT r.v, l.b FROM r JOIN l ON l.a = r.reach),
comp AS (SELECT v, min(reach) AS component_id FROM r GROUP BY 1)
SELECT d.doc_id, coalesce(c.m, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept FROM d LEFT JOIN c ON c.doc_id = d.doc_id JOIN comp ON comp.v = d.doc_id"""

TOP_K = """
WITH v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS e FROM embeddings
 WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 100 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) x WHERE rank <= 10"""

ORACLES = {"op6_fast_similarity_sketch": NEAR, "op7_fixed_block_anchors": SUBSTRING, "op8_maxscore_top_k": TOP_K, "op9_ngram_decontamination": DECONTAMINATION}
