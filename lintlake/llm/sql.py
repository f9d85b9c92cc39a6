"""DuckDB SQL for the operators that SQL can express on whole tables; it shares no code and no method with them."""

from __future__ import annotations

import string

from .urls import LIMIT, RULES, VOCABULARY

#: Every 50-byte string by itself, as hexadecimal text: the smallest document it starts in, then the bytes that a string of a smaller one covers.
OP5 = """
WITH docs AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
parts AS MATERIALIZED (SELECT r, doc_id, base, substr(h, 2 * base + 1, 698) AS p, least(300, length(h) // 2 - base) AS n FROM (SELECT *, unnest(range(0, length(h) // 2, 300)) AS base FROM docs)),
places AS (SELECT *, unnest(range(n)) AS j FROM parts),
bytes AS MATERIALIZED (SELECT r, doc_id, base + j AS i, substr(p, 2 * j + 1, 2) AS b, substr(p, 2 * j + 1, 100) AS w FROM places),
first AS MATERIALIZED (SELECT w, min(doc_id) AS least, max(doc_id) AS most FROM bytes WHERE length(w) = 100 GROUP BY w HAVING min(doc_id) < max(doc_id)),
gone AS (SELECT r, i, b, max(start) OVER (PARTITION BY r ORDER BY i) AS start FROM (SELECT b.*, CASE WHEN f.least < b.doc_id THEN b.i END AS start FROM bytes b LEFT JOIN first f USING (w))),
marked AS (SELECT r, i, b, coalesce(i - start < 50, false) AS goes FROM gone),
runs AS (SELECT *, goes AND NOT coalesce(lag(goes) OVER (PARTITION BY r ORDER BY i), false) AS begins FROM marked),
digests AS (SELECT r, count(*) FILTER (goes) AS n_removed, count(*) FILTER (begins) AS n_spans, coalesce(string_agg(b, '' ORDER BY i) FILTER (NOT goes), '') AS kept FROM runs GROUP BY r)
SELECT doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256
FROM docs LEFT JOIN digests USING (r)
"""

#: All pairs of documents with a shingle in common, counted; then the smallest document that links reach.
OP6 = f"""
WITH RECURSIVE docs AS MATERIALIZED (SELECT doc_id, regexp_extract_all(translate(text, '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
shingles AS MATERIALIZED (SELECT DISTINCT doc_id, CASE WHEN len(w) = 1 THEN w[1] ELSE w[i] || ' ' || w[i + 1] END AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w), 2))) AS i FROM docs WHERE len(w) > 0)),
sizes AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
links AS MATERIALIZED (SELECT a, b FROM common c JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c.n >= 80 * (x.n + y.n - c.n)),
edges AS MATERIALIZED (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(node, least) AS (SELECT doc_id, doc_id FROM sizes UNION SELECT e.b, r.least FROM reach r JOIN edges e ON e.a = r.node WHERE r.least < e.b)
SELECT doc_id, coalesce(n, 0) AS n_shingles, coalesce(least, doc_id) AS component_id, coalesce(least, doc_id) = doc_id AS kept
FROM documents LEFT JOIN sizes USING (doc_id) LEFT JOIN (SELECT node AS doc_id, min(least) AS least FROM reach GROUP BY node) USING (doc_id)
"""

_ESCAPES = " + ".join(f"(length({{c}}) - length(replace({{c}}, '{x}', ''))) // {len(x)}" for x in ("\\", "<s>", "</s>", "[INST]", "[/INST]"))

#: Turns in their order; an example is as long as all turns up to its own.
OP9 = f"""
WITH said AS (SELECT conv_id, turn, role, text FROM conversations UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
turns AS (SELECT conv_id, row_number() OVER o AS k, count(*) OVER (PARTITION BY conv_id) AS n, coalesce(role, '') AS role, coalesce(text, '') AS text FROM said WINDOW o AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST)),
sized AS (SELECT *, length('<s>[INST][/INST]</s>') + length(role) + length(text) + {_ESCAPES.format(c="role")} + {_ESCAPES.format(c="text")} AS chars FROM turns),
grown AS (SELECT *, sum(chars) OVER (PARTITION BY conv_id ORDER BY k) AS prefix FROM sized)
SELECT conv_id, max(n) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256, CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '')) AS loss_sha256, CAST(sum(prefix) FILTER (role = 'assistant' OR k = n) AS BIGINT) AS formatted_chars
FROM grown GROUP BY conv_id
"""

_QUOTED = lambda x: "'" + x.replace("'", "''") + "'"
_LOWERED = "translate({}, '" + string.ascii_uppercase + "', '" + string.ascii_lowercase + "')"
_EDGE = "[^a-z0-9\\x{80}-\\x{10FFFF}]"

#: Every rule and every term by itself.
OP12 = f"""
WITH rules(h, p, verdict) AS (VALUES {", ".join(f"({_QUOTED(r.host)}, {_QUOTED(r.path)}, {_QUOTED(r.verdict)})" for r in RULES)}),
terms(t, w) AS (VALUES {", ".join(f"({_QUOTED(t)}, {w})" for t, w in VOCABULARY.items())}),
parts AS (SELECT row_number() OVER () AS r, page_id, {_LOWERED.format("coalesce(url, '')")} AS low, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
split AS (SELECT r, page_id, low, {_LOWERED.format("regexp_extract(rest, '^[^/?#]*')")} AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM parts),
fits AS (SELECT r, max(struct_pack(n := length(h || p), verdict := verdict, rule := h || p)) AS best FROM split JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY r),
hits AS (SELECT r, count(*) FILTER (w >= {LIMIT}) AS strict, count(*) FILTER (w < {LIMIT}) AS soft, sum(w) AS weight FROM split JOIN terms ON contains(low, t) AND regexp_matches(low, '(^|{_EDGE})' || t || '($|{_EDGE})') GROUP BY r)
SELECT page_id, host, path, best.rule AS rule, coalesce(best.verdict, CASE WHEN weight >= {LIMIT} THEN 'block' ELSE 'allow' END) AS verdict, CAST(coalesce(weight, 0) AS BIGINT) AS weight, coalesce(strict, 0) AS strict, coalesce(soft, 0) AS soft
FROM split LEFT JOIN fits USING (r) LEFT JOIN hits USING (r)
"""

#: Equal words by pairs; for each distance the islands of such pairs are the runs, and of the distances of one stretch the smallest counts.
OP11 = r"""
WITH docs AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
  CASE WHEN doc_id IS NULL THEN 1 ELSE xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)), lambda h, b: list_reduce(list_prepend(xor(h, b), range(8)), lambda x, k: xor(x >> 1, 3988292384 * (x & 1))))) END AS h FROM documents),
sized AS (SELECT r, doc_id, w, len(w) AS n, h % 10 = 0 AND len(w) > 0 AS again, h // 10 AS g FROM docs),
placed AS (SELECT *, g % greatest(n, 1) AS a FROM sized),
tails AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS t FROM placed),
taken AS MATERIALIZED (SELECT r, doc_id, n, CASE WHEN again THEN list_transform(range(n), lambda i: w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % t END]) ELSE w END AS w FROM tails),
words AS MATERIALIZED (SELECT r, n, unnest(range(n)) AS i, unnest(w) AS x FROM taken),
apart AS (SELECT a.r, a.n, a.i, b.i - a.i AS p FROM words a JOIN words b ON a.r = b.r AND a.x = b.x AND b.i > a.i AND 4 * (b.i - a.i) <= a.n),
islands AS (SELECT r, n, p, i, i - row_number() OVER (PARTITION BY r, p ORDER BY i) AS island FROM apart),
stretches AS (SELECT r, p, min(i) AS s, max(i) + p + 1 AS e FROM islands GROUP BY r, p, island),
runs AS MATERIALIZED (SELECT r, s, e - s AS l, min(p) AS p FROM stretches WHERE e - s >= greatest(6, 4 * p) GROUP BY r, s, e),
listed AS (SELECT r, count(*) AS n_runs, min(struct_pack(a := -l, b := s, c := p)) AS top, string_agg(s || ',' || l || ',' || p || chr(10), '' ORDER BY s, p) AS lines FROM runs GROUP BY r),
gone AS MATERIALIZED (SELECT DISTINCT r, unnest(range(s + p, s + l)) AS i FROM runs),
kept AS (SELECT r, string_agg(x, ' ' ORDER BY i) AS line FROM words ANTI JOIN gone USING (r, i) GROUP BY r)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, top.b AS start, -top.a AS length, top.c AS period, 1000 * -top.a // top.c AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(line, '')) AS collapsed_sha256
FROM docs LEFT JOIN listed USING (r) LEFT JOIN kept USING (r)
"""

_TERM = "'[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+'"

#: Every term of an item with every document that holds it, scored and ranked.
OP13 = f"""
WITH docs AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOWERED.format("coalesce(text, '')")}, {_TERM}) AS w FROM documents),
counted AS MATERIALIZED (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(w) AS term FROM docs) GROUP BY ALL),
total AS (SELECT count(*) FILTER (len(w) > 0) AS n, CAST(sum(len(w)) AS BIGINT) AS l FROM docs),
sized AS (SELECT r, doc_id, 100 - 25 + (25 * len(w) * n) // l AS m FROM docs, total WHERE len(w) > 0),
rare AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * n + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS weight FROM counted, total GROUP BY term, n),
asked AS (SELECT item_id, term, count(*) AS repeats FROM (SELECT item_id, unnest(regexp_extract_all({_LOWERED.format("text")}, {_TERM})) AS term FROM benchmark) GROUP BY ALL),
scored AS (SELECT item_id, r, doc_id, CAST(sum(repeats * weight * ((1000000000 * tf) // (1000 * tf + 12 * m))) AS BIGINT) AS score FROM asked JOIN rare USING (term) JOIN counted USING (term) JOIN sized USING (r) GROUP BY ALL),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank FROM scored WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 20
"""

SQL = {"op13_ranked_lexical_search": OP13, "op11_periodic_run_detection": OP11, "op12_url_filters": OP12, "op5_suffix_array_dedup": OP5, "op6_minhash_near_dedup": OP6, "op9_chat_formatting": OP9}
