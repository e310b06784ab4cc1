"""DuckDB SQL for the rows of the queries that SQL can express."""

_LOWER = "translate({c}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP3 = r"""
WITH urls AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), parts AS (
  SELECT row_number() OVER () AS r, page_id,
         translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM urls
), rules(rule, h, p, v) AS (
  VALUES ('org/', 'org', '/', 'allow'), ('example.org/es/', 'example.org', '/es/', 'block'), ('example.org/en/1', 'example.org', '/en/1', 'block'),
         ('com/fr/', 'com', '/fr/', 'allow'), ('com/de/', 'com', '/de/', 'block')
), fit AS (
  SELECT r, rule, v, row_number() OVER (PARTITION BY r ORDER BY length(rule) DESC) AS k
  FROM parts JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
)
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict
FROM parts LEFT JOIN (SELECT * FROM fit WHERE k = 1) USING (r)
"""

_WORDS = r"regexp_extract_all({low}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP4 = rf"""
WITH items AS (
  SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS.format(low=_LOWER.format(c="coalesce(text, '')"))} AS w FROM benchmark
), windows AS (
  SELECT DISTINCT item, len_ AS n, array_to_string(list_slice(w, i, i + len_ - 1), ' ') AS phrase
  FROM (SELECT item, w, least(13, len(w)) AS len_, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM items WHERE len(w) > 0)
), docs AS (
  SELECT row_number() OVER () AS r, doc_id, {_WORDS.format(low=_LOWER.format(c="coalesce(text, '')"))} AS w FROM documents
), sizes AS (SELECT DISTINCT n FROM windows
), spread AS (
  SELECT r, n, i, array_to_string(list_slice(w, i, i + n - 1), ' ') AS phrase
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM docs, sizes WHERE len(w) >= n)
), found AS (
  SELECT s.r, s.n, s.i, d.item FROM spread s JOIN windows d USING (n, phrase)
), words AS (
  SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM found) GROUP BY r
), named AS (
  SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT r, item FROM found) GROUP BY r
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM docs LEFT JOIN words USING (r) LEFT JOIN named USING (r)
"""

ORACLES = {"op3_url_filters": OP3, "op4_benchmark_decontamination": OP4}

OP6 = rf"""
WITH RECURSIVE docs AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOWER.format(c="coalesce(text, '')")}, '[^\x20\x09-\x0D]+') AS w FROM documents
), shingles AS (
  SELECT DISTINCT r, array_to_string(list_slice(w, i, i + 4), ' ') AS s FROM (SELECT r, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM docs WHERE len(w) > 0)
), sizes AS (
  SELECT r, count(*) AS n FROM shingles GROUP BY r
), links AS (
  SELECT a, b FROM (SELECT x.r AS a, y.r AS b, count(*) AS n FROM shingles x JOIN shingles y USING (s) WHERE x.r <> y.r GROUP BY x.r, y.r) p
  JOIN sizes sa ON sa.r = a JOIN sizes sb ON sb.r = b WHERE 100 * p.n >= 75 * (sa.n + sb.n - p.n)
), reach(a, b) AS (
  SELECT r, r FROM docs UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a
)
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, g.component_id
FROM docs d LEFT JOIN sizes s USING (r) JOIN (SELECT a AS r, min(t.doc_id) AS component_id FROM reach JOIN docs t ON t.r = reach.b GROUP BY a) g USING (r)
"""

OP8 = """
WITH RECURSIVE vecs AS (
  SELECT row_number() OVER () AS r, vec_id, label, list_transform(embedding, lambda v: CAST(v AS DOUBLE)) AS e FROM embeddings
), unit AS (
  SELECT r, label, list_transform(e, lambda v: v / sqrt(list_dot_product(e, e))) AS u FROM vecs
  WHERE label IS NOT NULL AND e IS NOT NULL AND len(e) > 0 AND list_count(e) = len(e)
    AND len(list_filter(e, lambda v: NOT isfinite(v))) = 0 AND list_dot_product(e, e) > 0
), links AS (
  SELECT x.r AS a, y.r AS b FROM unit x JOIN unit y ON x.label = y.label AND x.r <> y.r AND len(x.u) = len(y.u) WHERE list_dot_product(x.u, y.u) >= 0.93
), degree AS (
  SELECT a AS r, count(*) AS n FROM links GROUP BY a
), reach(a, b) AS (
  SELECT r, r FROM vecs UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a
), least AS (
  SELECT a AS r, min(t.vec_id) AS component_id FROM reach JOIN vecs t ON t.r = reach.b GROUP BY a
)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM vecs LEFT JOIN degree USING (r) JOIN least USING (r)
"""

ORACLES |= {"op6_jaccard_join": OP6, "op8_embedding_dedup": OP8}

OP1 = rf"""
WITH docs AS (
  SELECT doc_id, regexp_extract_all({_LOWER.format(c="coalesce(text, '')")}, '[^\x20\x09-\x0D]+') AS w FROM documents
), windows AS (
  SELECT doc_id, i, array_to_string(list_slice(w, i + 1, i + 50), ' ') AS phrase FROM (SELECT doc_id, w, unnest(range(0, len(w) - 49)) AS i FROM docs WHERE len(w) >= 50)
), later AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY phrase ORDER BY doc_id, i) AS k FROM windows) WHERE k > 1
), marked AS (
  SELECT doc_id, i, CASE WHEN i <= lag(i + 50) OVER (PARTITION BY doc_id ORDER BY i) THEN 0 ELSE 1 END AS new FROM later
), spans AS (
  SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM marked
)
SELECT doc_id, min(i) AS start_word, max(i) + 50 AS end_word, max(i) + 50 - min(i) AS n_words FROM spans GROUP BY doc_id, g
"""

OP2 = r"""
WITH RECURSIVE msgs AS (
  SELECT row_number() OVER () AS r, conv_id, turn, role, coalesce(text, '') AS text FROM conversations
), lines AS (
  SELECT r, conv_id, turn, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS i, regexp_matches(text, '(?m)^[ \t]*>') AS q FROM msgs
), levels AS (
  SELECT r, conv_id, turn, i, CASE WHEN q THEN length(regexp_replace(regexp_extract(l, '^((?:[ \t]*>)*)[ \t]?', 1), '[^>]', '', 'g')) ELSE 0 END AS lv,
         CASE WHEN q THEN regexp_replace(l, '^((?:[ \t]*>)*)[ \t]?', '') ELSE l END AS body FROM lines
), runs AS (
  SELECT *, i - row_number() OVER (PARTITION BY r, lv ORDER BY i) AS g FROM levels
), parts AS (
  SELECT r, conv_id, turn, lv, min(i) AS place, string_agg(body, chr(10) ORDER BY i) AS body FROM runs GROUP BY r, conv_id, turn, lv, g
), pieces AS (
  SELECT r, conv_id, turn, lv, 0 AS rank, body AS piece FROM parts
  UNION ALL SELECT r, conv_id, turn, lv, 1, unnest(string_split_regex(body, '\n(?:[ \t\r]*\n)+')) FROM parts WHERE contains(body, chr(10))
  UNION ALL SELECT r, conv_id, turn, lv, 2, unnest(string_split(body, chr(10))) FROM parts WHERE contains(body, chr(10))
), normal AS (
  SELECT *, length(norm) AS n FROM (SELECT *, trim(regexp_replace(translate(piece, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t\r\n]+', ' ', 'g')) AS norm FROM pieces)
  WHERE length(norm) >= 8 OR rank = 0 AND length(norm) > 0
), quoted AS (SELECT *, row_number() OVER () AS q FROM normal WHERE lv > 0
), originals AS (SELECT DISTINCT conv_id, turn, norm FROM normal WHERE lv = 0
), inside AS (
  SELECT q.q, q.r, q.lv, q.rank, q.n, max(o.turn) AS found FROM quoted q JOIN originals o ON o.norm = q.norm AND o.conv_id IS NOT DISTINCT FROM q.conv_id AND o.turn < q.turn GROUP BY ALL
), summed AS (
  SELECT r, lv, rank, found, CASE WHEN rank > 0 THEN sum(n) ELSE 0 END AS n FROM inside GROUP BY r, lv, rank, found
), parent AS (
  SELECT r, found FROM (SELECT *, row_number() OVER (PARTITION BY r ORDER BY lv, rank, n DESC, found DESC) AS k FROM summed) WHERE k = 1
), firsts AS (
  SELECT norm, conv_id AS o_conv FROM (SELECT *, row_number() OVER (PARTITION BY norm ORDER BY conv_id NULLS FIRST, turn NULLS FIRST) AS k FROM originals) WHERE k = 1
), foreign_ AS (
  SELECT r, o_conv AS f FROM (SELECT q.r, o_conv, row_number() OVER (PARTITION BY q.r ORDER BY q.rank, o_conv NULLS FIRST) AS k FROM quoted q JOIN firsts USING (norm) WHERE q.n >= 8 AND o_conv IS DISTINCT FROM q.conv_id) WHERE k = 1
), own AS (
  SELECT r, trim(string_agg(trim(body, ' ' || chr(10)), chr(10) ORDER BY place) FILTER (lv = 0), ' ' || chr(10)) AS text, count(*) FILTER (lv > 0) AS n_quoted, max(lv) AS max_level FROM parts GROUP BY r
), placed AS (
  SELECT m.*, p.found, row_number() OVER w AS place, last_value(m.turn IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before
  FROM msgs m LEFT JOIN parent p USING (r) WINDOW w AS (PARTITION BY m.conv_id ORDER BY m.turn NULLS FIRST, m.role NULLS FIRST, r)
), turns AS (SELECT conv_id, turn, max(place) AS last_place FROM placed GROUP BY conv_id, turn
), tree AS (
  SELECT a.r, a.conv_id, a.place, CASE WHEN a.found IS NULL THEN a.place - 1 ELSE t.last_place END AS up FROM placed a LEFT JOIN turns t ON t.conv_id IS NOT DISTINCT FROM a.conv_id AND t.turn = a.found
), walk(r, conv_id, place, path) AS (
  SELECT r, conv_id, place, [place] FROM tree WHERE up = 0
  UNION ALL SELECT t.r, t.conv_id, t.place, list_append(w.path, t.place) FROM walk w JOIN tree t ON t.up = w.place AND t.conv_id IS NOT DISTINCT FROM w.conv_id
)
SELECT m.conv_id, m.turn, m.role, coalesce(o.text, '') AS text, o.n_quoted, o.max_level::BIGINT AS max_level,
       coalesce(m.found, m.before) AS parent_turn, m.found IS NOT NULL AS linked, CASE WHEN m.found IS NULL THEN x.f END AS foreign_conv, row_number() OVER (PARTITION BY m.conv_id ORDER BY k.path) AS position
FROM placed m JOIN own o USING (r) JOIN walk k USING (r) LEFT JOIN foreign_ x USING (r)
"""

_UUID = "'<urn:uuid:' || substr({h}, 1, 8) || '-' || substr({h}, 9, 4) || '-' || substr({h}, 13, 4) || '-' || substr({h}, 17, 4) || '-' || substr({h}, 21, 12) || '>'"
def _entities() -> tuple[str, str]:
    """SQL lists of HTML's names (with ``;`` where it belongs to them) and of what they stand for; and of odd numbers."""
    import html
    from html.entities import html5

    quoted = lambda t: "'" + t.replace("'", "''") + "'" if t.isprintable() or t == "" else " || ".join(f"chr({ord(c)})" for c in t)
    odd = {n: html.unescape(f"&#{n};") for n in [*range(160), *range(0xFDD0, 0xFDF0), *(p << 16 | e for p in range(17) for e in (0xFFFE, 0xFFFF))]}
    pick = lambda held: (f"[{', '.join(map(str, (quoted(k) if isinstance(k, str) else k for k in held)))}]", f"[{', '.join(quoted(v) for v in held.values())}]")
    names, numbers = pick(html5), pick(odd)
    bare = "|".join(sorted((n for n in html5 if not n.endswith(";")), key=lambda n: (-len(n), n)))
    return f"SELECT {names[0]} AS names, {names[1]} AS chars, {numbers[0]} AS odd, {numbers[1]} AS meant", bare


_ENTITIES, _BARE = _entities()
_REF = r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)"
_HEX = "CASE WHEN lower(substr(x, 3, 1)) = 'x' THEN try_cast('0x' || regexp_extract(x, '^&#[xX]([0-9a-fA-F]+)', 1) AS BIGINT) ELSE try_cast(regexp_extract(x, '^&#([0-9]+)', 1) AS BIGINT) END"
_NUMBER = f"""CASE WHEN ({_HEX}) IS NULL OR ({_HEX}) > 1114111 OR ({_HEX}) BETWEEN 55296 AND 57343 THEN chr(65533)
  WHEN list_position(odd, ({_HEX})::INTEGER) > 0 THEN meant[list_position(odd, ({_HEX})::INTEGER)] ELSE chr(({_HEX})::INTEGER) END"""
_NAME = f"""CASE WHEN list_position(names, substr(x, 2)) > 0 THEN chars[list_position(names, substr(x, 2))]
  WHEN regexp_matches(x, '^&(?:{_BARE})') THEN chars[list_position(names, regexp_extract(x, '^&({_BARE})', 1))] || substr(x, length(regexp_extract(x, '^&(?:{_BARE})', 0)) + 1) ELSE x END"""
_STRIPPED = r"""regexp_replace(regexp_replace(regexp_replace(payload,
      '(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>|<head\b.*?</head\s*>', ' ', 'g'),
      '(?i)</(?:p|div|li|tr|h[1-6]|section|article|table|ul|ol|title)\s*>|<br\s*/?>', chr(10), 'g'),
      '<[^>]*>', ' ', 'g')"""
_HEADERS = " || chr(13) || chr(10) || ".join(
    (
        "'WARC/1.1'", "'WARC-Type: ' || kind", "'WARC-Record-ID: ' || record_id", "'WARC-Refers-To: ' || refers_to", "'WARC-Refers-To-Target-URI: ' || uri", "'WARC-Refers-To-Date: ' || date",
        "'X-Refers-To-Payload-Digest: ' || source_digest", "'WARC-Target-URI: ' || uri", "'WARC-Date: ' || date", "'WARC-Block-Digest: ' || block_digest", "'Content-Type: ' || mime", "'Content-Length: ' || content_length",
    )
)

OP5 = rf"""
WITH pages_ AS (
  SELECT page_id, coalesce(url, '') AS target_uri, coalesce(html, '') AS payload FROM pages
), keyed AS (
  SELECT *, sha256(payload) AS digest, md5('response|' || coalesce(page_id::VARCHAR, '') || '|' || target_uri || '|' || sha256(payload)) AS k FROM pages_
), records AS (
  SELECT *, {_UUID.format(h="k")} AS response_id, row_number() OVER () AS r FROM keyed
), entities AS ({_ENTITIES}), cut AS (
  SELECT r, string_split_regex({_STRIPPED}, '{_REF}') AS between_, regexp_extract_all({_STRIPPED}, '{_REF}') AS refs FROM records
), spread AS (
  SELECT r, unnest(between_) AS t, unnest(refs) AS x, generate_subscripts(between_, 1) AS i FROM cut
), decoded AS (
  SELECT r, string_agg(t || CASE WHEN x IS NULL THEN '' WHEN starts_with(x, '&#') THEN {_NUMBER} ELSE {_NAME} END, '' ORDER BY i) AS t FROM spread, entities GROUP BY r
), both_ AS (
  SELECT page_id, response_id, target_uri, digest, 'metadata' AS kind, 'application/json' AS mime,
         to_json({{'title': regexp_extract(payload, '(?is)<title[^>]*>(.*?)</title', 1), 'lang': regexp_extract(payload, '(?i)<html[^>]*\blang="([^"]*)"', 1),
                  'links': regexp_extract_all(payload, '(?i)<a\b[^>]*?\bhref="([^"]*)"', 1),
                  'source_headers': 'HTTP/1.1 200 OK' || chr(13) || chr(10) || 'Content-Type: text/html; charset=utf-8' || chr(13) || chr(10) || 'Content-Length: ' || strlen(payload),
                  'source_digest': 'sha256:' || digest}})::VARCHAR AS block FROM records
  UNION ALL SELECT page_id, response_id, target_uri, digest, 'conversion', 'text/plain; charset=utf-8',
         trim(regexp_replace(regexp_replace(replace(t, chr(160), ' '), '[ \t\r\f]+', ' ', 'g'), ' ?\n[ \n]*', chr(10), 'g'), ' ' || chr(10)) FROM records JOIN decoded USING (r)
), made AS (
  SELECT page_id, kind, {_UUID.format(h="md5(kind || '|' || response_id)")} AS record_id, response_id AS refers_to, target_uri, '1970-01-01T00:00:00Z' AS date, mime, 'sha256:' || digest AS source_digest,
         'sha256:' || sha256(block) AS block_digest, strlen(block) AS content_length, block, replace(replace(target_uri, chr(13), '%0D'), chr(10), '%0A') AS uri FROM both_
)
SELECT * EXCLUDE (uri), {_HEADERS} AS headers FROM made
"""

OP9 = rf"""
WITH pieces AS (
  SELECT doc_id, unnest(p) AS piece, generate_subscripts(p, 1) AS i FROM (
    SELECT doc_id, string_split(replace(regexp_replace(coalesce(text, ''), '([.!?])([ \t\r\n\x0b\x0c])', '\1' || chr(1) || '\2', 'g'), chr(10), chr(10) || chr(1)), chr(1)) AS p FROM documents)
), placed AS (
  SELECT doc_id, piece, i, coalesce(sum(strlen(piece)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS base,
         {_WORDS.format(low=_LOWER.format(c="piece"))} AS w FROM pieces
), sentences AS (
  SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS s, array_to_string(w, ' ') AS words, len(w) AS n, base + strlen(piece) AS b,
         base + strlen(piece) - strlen(regexp_replace(piece, '^[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+', '')) AS a
  FROM placed WHERE len(w) > 0
), listed AS (
  SELECT doc_id, list(words ORDER BY s) AS w, list(n ORDER BY s) AS ns, list(a ORDER BY s) AS a, list(b ORDER BY s) AS b FROM sentences GROUP BY doc_id
), spread AS (
  SELECT *, unnest(range(1, len(w) + 1)) AS s FROM listed
), tried AS (
  SELECT *, unnest(range(1, least(10, len(w) - s + 1) + 1)) AS m FROM spread
), summed AS (
  SELECT doc_id, a[s] AS a, b[s + m - 1] AS b, m, list_sum(ns[s : s + m - 1]) AS held, ns[s + m - 1] AS last_n, array_to_string(w[s : s + m - 1], '|') AS k FROM tried
), runs AS (
  SELECT doc_id, a, b, k FROM summed WHERE CASE m WHEN 1 THEN held >= 40 WHEN 2 THEN held >= 20 WHEN 3 THEN held >= 10 ELSE held >= 10 AND held - last_n < 10 END
), later AS (
  SELECT doc_id, a, b FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY doc_id, a) AS r FROM runs) WHERE r > 1
), marked AS (
  SELECT *, CASE WHEN a <= max(b) OVER (PARTITION BY doc_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS new FROM later
), spans AS (
  SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY a, b) AS g FROM marked
)
SELECT doc_id, min(a)::BIGINT AS start_byte, max(b)::BIGINT AS end_byte FROM spans GROUP BY doc_id, g
"""

ORACLES |= {"op1_suffix_array_dedup": OP1, "op2_quotation_linking": OP2, "op5_warc_derivatives": OP5, "op9_substring_dedup": OP9}
