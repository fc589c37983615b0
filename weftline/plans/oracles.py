"""DuckDB SQL for the registered queries, by name."""

from __future__ import annotations

from . import delivery

_LINES = """lines AS (
  SELECT doc_id, CAST(unnest(range(0, len(l))) AS BIGINT) AS line, unnest(l) AS body
  FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))"""

_SPACES = " || ".join(f"chr({ord(c)})" for c in map(chr, range(0x3001)) if c.isspace())
_BARE = f"trim(body, {_SPACES})"
_KIND = f"""CASE WHEN {_BARE} = '' THEN 'blank' WHEN starts_with({_BARE}, ';') OR starts_with({_BARE}, '//') THEN 'comment'
  WHEN starts_with({_BARE}, '*') THEN 'label' WHEN starts_with({_BARE}, '#') THEN 'linetag' WHEN starts_with({_BARE}, '[') THEN 'command' ELSE 'text' END"""

_SPANS = f"""{_LINES},
spans AS (
  SELECT doc_id, line, body, CAST(length(body) AS BIGINT) AS n,
         CAST(coalesce(sum(length(body) + 1) OVER (PARTITION BY doc_id ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start
  FROM lines)"""

_TAGS = "regexp_extract_all(html, '<[^>]*>')"

_FILES = """f AS (SELECT doc_id, source || '/' || CASE WHEN doc_id % 10 = 0 THEN 'backup/' ELSE '' END || 'n' || doc_id || ['.ks', '.txt', '.TXT', '.bin'][doc_id % 4 + 1] AS path, text FROM documents)"""
_HITS = f"""{_FILES}, h AS (
    SELECT 'the' AS kind, path, 'probe' AS strength, '546865' AS evidence FROM f WHERE starts_with(text, 'The')
    UNION ALL SELECT 'er', path, 'probe', '4572' FROM f WHERE starts_with(text, 'Er')
    UNION ALL SELECT 'any-e', path, 'probe', '45' FROM f WHERE starts_with(text, 'E')
    UNION ALL SELECT 'first', path, 'filename', 'n1.txt' FROM f WHERE lower(split_part(path, '/', -1)) = 'n1.txt'
    UNION ALL SELECT 'script', path, 'filename', 'n4.ks' FROM f WHERE lower(split_part(path, '/', -1)) = 'n4.ks'
    UNION ALL SELECT 'script', path, 'extension', '.ks' FROM f WHERE ends_with(lower(path), '.ks')
    UNION ALL SELECT unnest(['plain', 'script']), path, 'extension', '.txt' FROM f WHERE ends_with(lower(path), '.txt'))"""

_VALID = """WITH a AS (SELECT conv_id, turn, role AS n1, text AS m1 FROM conversations),
      b AS (SELECT conv_id, turn, CASE WHEN conv_id % 13 = 0 THEN NULL ELSE role END AS n2,
                   CASE WHEN turn % 5 = 1 THEN replace(text, '.', '') WHEN turn % 7 = 2 THEN '' ELSE upper(text) END AS m2 FROM conversations WHERE (conv_id + turn) % 11 <> 0),
      j AS (SELECT a.conv_id, a.turn, CASE WHEN b.turn IS NULL THEN 'missing' WHEN (n1 IS NULL) <> (n2 IS NULL) THEN 'name' WHEN m2 = '' AND m1 <> '' THEN 'empty'
              WHEN len(regexp_extract_all(m1, '[.]')) <> len(regexp_extract_all(m2, '[.]')) THEN 'tokens' ELSE 'ok' END AS reason FROM a LEFT JOIN b ON a.conv_id = b.conv_id AND a.turn = b.turn)"""

_TRIP = "SELECT source AS container, 'dir/' || doc_id || '.txt' AS name, CAST(strlen(text) AS BIGINT) AS size, sha256(text) AS sha256, 'success' AS status FROM documents"

ORACLES = {
    "line_kind": f"WITH {_LINES} SELECT doc_id, line, {_KIND} AS kind FROM lines",
    "content_kind": f"""WITH {_LINES}, k AS (SELECT doc_id, line, {_KIND} AS kind FROM lines),
      r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line) AS rn FROM k WHERE kind <> 'blank')
      SELECT doc_id, count(*) AS n_seen, count(*) FILTER (kind = 'text') AS n_text, count(*) FILTER (kind = 'text') >= count(*) * 0.6 AS is_script
      FROM r WHERE rn <= 20 GROUP BY doc_id""",
    "first_lines": f"WITH {_LINES} SELECT * FROM lines WHERE line < 3",
    "paragraphs": f"""WITH {_LINES}, g AS (
        SELECT *, sum(CASE WHEN trim(body) = '' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line) AS para FROM lines)
      SELECT doc_id, CAST(para AS BIGINT) AS para, min(line) AS first_line, count(*) AS n_lines, string_agg(body, chr(10) ORDER BY line) AS body
      FROM g WHERE trim(body) <> '' GROUP BY doc_id, para""",
    "tag_inventory": f"SELECT page_id, token, count(*) AS n FROM (SELECT page_id, unnest({_TAGS}) AS token FROM pages) GROUP BY ALL",
    "section_mask": """WITH l AS (SELECT page_id, CAST(unnest(range(0, len(x))) AS BIGINT) AS line, unnest(x) AS body
        FROM (SELECT page_id, string_split(replace(html, '>', '>' || chr(10)), chr(10)) AS x FROM pages)),
      f AS (SELECT *, CAST(contains(body, '<nav') AS INT) AS o, CAST(contains(body, '</nav') AS INT) AS c FROM l),
      d AS (SELECT page_id, line, CAST(sum(o) OVER w - (sum(c) OVER w - c) AS BIGINT) AS depth FROM f
        WINDOW w AS (PARTITION BY page_id ORDER BY line ROWS UNBOUNDED PRECEDING))
      SELECT page_id, line, depth, depth > 0 AS inside, depth > 1 AS nested FROM d""",
    "speaker_ffill": """WITH s AS (SELECT *, sum(CASE WHEN turn % 4 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS seg FROM conversations)
      SELECT conv_id, turn, last_value(CASE WHEN role <> 'assistant' THEN role END IGNORE NULLS) OVER (PARTITION BY conv_id, seg ORDER BY turn ROWS UNBOUNDED PRECEDING) AS speaker FROM s""",
    "one_shot_speaker": """WITH s AS (SELECT *, coalesce(sum(CASE WHEN role = 'assistant' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS m FROM conversations)
      SELECT conv_id, turn, CASE WHEN role = 'assistant' THEN last_value(CASE WHEN role <> 'assistant' THEN role END IGNORE NULLS) OVER (PARTITION BY conv_id, m ORDER BY turn ROWS UNBOUNDED PRECEDING) END AS speaker FROM s""",
    "overlay_last_wins": """SELECT user_id, event_type, event_id, value, n - 1 AS n_losers FROM (
      SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS rn, count(*) OVER (PARTITION BY user_id, event_type) AS n FROM events) WHERE rn = 1""",
    "override_chain": """SELECT user_id, event_type, l[-1] AS winner, array_to_string(l[:-2], ',') AS losers FROM (
      SELECT user_id, event_type, list(event_id ORDER BY event_id) AS l FROM events GROUP BY ALL)""",
    "loose_or_packed": """WITH d AS (SELECT doc_id AS k, md5(text) AS digest FROM documents),
      a AS (SELECT k, digest AS d1 FROM d WHERE k % 3 <> 0), b AS (SELECT k, CASE WHEN k % 4 = 0 THEN 'other' ELSE digest END AS d2 FROM d WHERE k % 2 = 0 OR k % 3 = 0)
      SELECT k, CASE WHEN d1 IS NULL THEN 'packed' WHEN d2 IS NULL THEN 'loose' WHEN d1 = d2 THEN 'same' ELSE 'override' END AS state, coalesce(d1, d2) AS digest FROM a FULL JOIN b USING (k)""",
    "first_seen": "SELECT user_id, min(event_id) AS first_seen, count(*) AS n FROM events GROUP BY user_id",
    "missing_rows": "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    "present_rows": "SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)",
    "key_set_equality": """WITH a AS (SELECT DISTINCT o_orderkey AS k, 1 AS l FROM orders), b AS (SELECT DISTINCT l_orderkey AS k, 1 AS r FROM lineitem)
      SELECT count(*) FILTER (l = 1 AND r = 1) AS n_both, count(*) FILTER (r IS NULL) AS n_left_only, count(*) FILTER (l IS NULL) AS n_right_only,
             count(*) FILTER (r IS NULL OR l IS NULL) = 0 AS equal FROM a FULL JOIN b USING (k)""",
    "dict_ambiguity": """SELECT alias, CAST(len(v) AS BIGINT) AS n_values, CASE WHEN len(v) = 1 THEN v[1] END AS resolved, CASE WHEN len(v) > 1 THEN array_to_string(v, ',') END AS ambiguous
      FROM (SELECT substr(text, 1, 12) AS alias, list(DISTINCT source ORDER BY source) AS v FROM documents GROUP BY 1)""",
    "default_name": """SELECT c_custkey, coalesce(n_name, CAST(c_nationkey AS VARCHAR)) AS shown
      FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_nationkey % 2 = 0) ON n_nationkey = c_nationkey""",
    "positional_join": """WITH n AS (SELECT n_name, row_number() OVER (ORDER BY n_name) - 1 AS ref FROM nation)
      SELECT event_id, user_id % 30 AS ref, n_name FROM events LEFT JOIN n ON n.ref = user_id % 30""",
    "two_hop_fk": """SELECT n_name, count(*) AS n_lines, round(sum(l_extendedprice), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey
      JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name""",
    "range_tag": "SELECT CASE WHEN o_totalprice >= 0 AND o_totalprice < 1e5 THEN 'low' WHEN o_totalprice >= 1e5 AND o_totalprice < 3e5 THEN 'mid' END AS tag, count(*) AS n FROM orders GROUP BY 1",
    "range_join_binned": "SELECT event_id, p_partkey FROM events JOIN part ON event_id >= p_partkey * 7 AND event_id < p_partkey * 7 + p_size",
    "char_entropy": """WITH c AS (SELECT doc_id, unnest(string_split(text, '')) AS c FROM documents), h AS (SELECT doc_id, c, count(*) AS n FROM c WHERE c <> '' GROUP BY ALL)
      SELECT doc_id, CAST(sum(n) AS BIGINT) AS n_chars, round(log2(sum(n)) - sum(n * log2(n)) / sum(n), 3) AS entropy FROM h GROUP BY doc_id""",
    "byte_entropy": """WITH b AS (SELECT conv_id, turn, hex(encode(text)) AS h FROM conversations),
      c AS (SELECT conv_id, turn, substr(h, 2 * i - 1, 2) AS c FROM b, LATERAL (SELECT unnest(range(1, length(h) // 2 + 1)) AS i)), k AS (SELECT conv_id, turn, c, count(*) AS n FROM c GROUP BY ALL),
      e AS (SELECT conv_id, turn, round(log2(sum(n)) - sum(n * log2(n)) / sum(n), 3) AS entropy FROM k GROUP BY ALL)
      SELECT conv_id, turn, coalesce(entropy, 0) AS entropy FROM conversations LEFT JOIN e USING (conv_id, turn)""",
    "merge_hits": """SELECT user_id, event_type, l[1] AS first, array_to_string(l[2:5], ',') AS others, CAST(len(l) AS BIGINT) AS n
      FROM (SELECT user_id, event_type, list(event_id ORDER BY event_id) AS l FROM events GROUP BY ALL)""",
    "evidence_topk": """WITH s AS (SELECT *, CASE event_type WHEN 'error' THEN 0 WHEN 'purchase' THEN 1 WHEN 'signup' THEN 2 ELSE 3 END AS st FROM events),
      f AS (SELECT *, row_number() OVER (PARTITION BY user_id, st ORDER BY event_id) = 1 AS first FROM s),
      r AS (SELECT *, count(*) FILTER (first) OVER (PARTITION BY user_id) AS n, row_number() OVER (PARTITION BY user_id ORDER BY first DESC, st, event_id) AS rn FROM f)
      SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY st, event_id) AS place FROM r WHERE rn <= greatest(2, n)""",
    "ordered_counts": """SELECT *, row_number() OVER (ORDER BY n DESC, first_seen) AS place FROM (SELECT event_type, count(*) AS n, min(event_id) AS first_seen FROM events GROUP BY 1)""",
    "largest_per_group": """SELECT source, doc_id, n_chars, place FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS place FROM documents) WHERE place <= 5""",
    "refcount": """SELECT c_custkey, count(o_orderkey) AS n_refs, CASE count(o_orderkey) WHEN 0 THEN 'unused' WHEN 1 THEN 'single' ELSE 'shared' END AS state
      FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1""",
    "series_extend": """WITH p AS (SELECT DISTINCT regexp_extract(s_name, '^(.*?)(\\d+)$', 1) AS prefix, regexp_extract(s_name, '^(.*?)(\\d+)$', 2) AS d FROM supplier),
      g AS (SELECT prefix, CAST(length(d) AS BIGINT) AS width, max(CAST(d AS BIGINT)) AS top FROM p WHERE d <> '' GROUP BY ALL HAVING count(DISTINCT CAST(d AS BIGINT)) >= 2)
      SELECT prefix, width, unnest(generate_series(1, greatest(1, least(999, top + 64)))) AS number FROM g""",
    "range_merge": """SELECT user_id, min(event_id) AS low, max(event_id) AS high, count(*) AS n FROM (
      SELECT user_id, event_id, event_id - row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS g FROM events) GROUP BY user_id, g""",
    "cumulative_budget": "SELECT source, doc_id, CAST(sum(n_chars) OVER w AS BIGINT) AS running, sum(n_chars) OVER w <= 50000 AS fits FROM documents WINDOW w AS (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING)",
    "dup_groups": "SELECT CAST(strlen(text) AS BIGINT) AS size, sha256(text) AS digest, count(*) AS n, min(doc_id) AS first FROM documents GROUP BY 1, 2 HAVING count(*) > 1",
    "pooled_values": """SELECT value, count(*) AS n FROM (SELECT '{"source":"' || source || '","lang":"' || lang || '"}' AS value FROM documents) GROUP BY 1 HAVING count(*) > 1 AND length(value) > 10""",
    "conditional_counts": "SELECT user_id, count(*) FILTER (event_type = 'error') AS n_errors, count(*) FILTER (value > 50) AS n_large, count(DISTINCT event_type) AS n_types FROM events GROUP BY 1",
    "row_export": """SELECT conv_id, turn, 'r' || lpad(CAST(turn AS VARCHAR), 8, '0') AS id, CASE WHEN role = 'system' THEN NULL ELSE role END AS name, text AS message,
      sha256(text) AS sha256, CAST(strlen(text) AS BIGINT) AS n_bytes, CAST(length(text) AS BIGINT) AS n_chars FROM conversations""",
    "manifest": """SELECT conv_id, count(*) AS n_rows, sha256(string_agg(sha256(text), '' ORDER BY turn)) AS digest, CAST(sum(len(regexp_extract_all(text, '[.,]'))) AS BIGINT) AS n_tokens FROM conversations GROUP BY 1""",
    "validate_rows": """WITH a AS (SELECT conv_id, turn, role AS n1, text AS m1 FROM conversations),
      b AS (SELECT conv_id, turn, CASE WHEN conv_id % 13 = 0 THEN NULL ELSE role END AS n2,
                   CASE WHEN turn % 5 = 1 THEN replace(text, '.', '') WHEN turn % 7 = 2 THEN '' ELSE upper(text) END AS m2 FROM conversations WHERE (conv_id + turn) % 11 <> 0),
      j AS (SELECT a.conv_id, a.turn, CASE WHEN b.turn IS NULL THEN 'missing' WHEN (n1 IS NULL) <> (n2 IS NULL) THEN 'name' WHEN m2 = '' AND m1 <> '' THEN 'empty'
              WHEN len(regexp_extract_all(m1, '[.]')) <> len(regexp_extract_all(m2, '[.]')) THEN 'tokens' ELSE 'ok' END AS reason FROM a LEFT JOIN b ON a.conv_id = b.conv_id AND a.turn = b.turn)
      SELECT *, reason = 'ok' AS valid FROM j""",
    "status_gate": """WITH r AS (SELECT event_id, user_id, CASE WHEN event_type = 'error' AND value > 60 THEN 'blocked' ELSE 'success' END AS status FROM events)
      SELECT user_id, event_id, status FROM r WHERE user_id NOT IN (SELECT user_id FROM r WHERE status = 'blocked')""",
    "rows_equal": """SELECT CAST(count(*) FILTER (doc_id % 10 = 0 AND doc_id % 15 <> 0) AS BIGINT) AS n_lost, CAST(count(*) FILTER (doc_id % 15 = 0 AND doc_id % 10 <> 0) AS BIGINT) AS n_new,
      count(*) FILTER ((doc_id % 10 = 0) <> (doc_id % 15 = 0)) = 0 AS equal FROM labels""",
    "token_multiset": f"""SELECT page_id, CAST(len(regexp_extract_all(html, '<p>')) AS BIGINT) AS n_before, CAST(len(regexp_extract_all(replace(html, '<br>', ''), '<br>')) AS BIGINT) AS n_after,
      list_sort({_TAGS}) = list_sort(regexp_extract_all(replace(html, '<br>', ''), '<[^>]*>')) AS same FROM pages""",
    "offset_map": f"""WITH {_SPANS}, m AS (SELECT doc_id, line, start, CAST(coalesce(sum(CASE WHEN line % 3 = 1 THEN 5 - n ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS shift FROM spans)
      SELECT *, start + shift AS new_start FROM m""",
    "splice_text": f"""WITH {_LINES}, t AS (SELECT doc_id, string_agg(CASE WHEN line % 3 = 1 AND body <> '' THEN 'EDIT!' ELSE body END, chr(10) ORDER BY line) AS s FROM lines GROUP BY 1)
      SELECT doc_id, md5(s) AS digest, CAST(length(s) AS BIGINT) AS n FROM t""",
    "map_addresses": f"""WITH {_SPANS}, e AS (SELECT doc_id, start, start + n AS stop, 5 - n AS delta FROM spans WHERE line % 3 = 1 AND n > 0),
      a AS (SELECT doc_id, unnest(range(0, n_chars + 1, 97)) AS address FROM documents)
      SELECT a.doc_id, address, coalesce(bool_or(start < address AND address < stop), false) AS inside,
             CASE WHEN NOT coalesce(bool_or(start < address AND address < stop), false) THEN address + CAST(coalesce(sum(delta) FILTER (stop <= address), 0) AS BIGINT) END AS mapped
      FROM a LEFT JOIN e ON a.doc_id = e.doc_id GROUP BY a.doc_id, address""",
    "overlap_check": """WITH e AS (SELECT user_id, event_id AS start, event_id + CAST(floor(value) AS BIGINT) AS "end" FROM events),
      w AS (SELECT *, max("end") OVER (PARTITION BY user_id ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM e)
      SELECT user_id, start, "end" FROM w WHERE start < m""",
    "consistent_rename": """WITH k AS (SELECT role, CASE WHEN role = 'user' THEN role || '_' || CAST(conv_id % 2 AS VARCHAR) ELSE upper(role) END AS a FROM conversations)
      SELECT role, CASE WHEN count(DISTINCT a) = 1 THEN min(a) END AS new_name, count(DISTINCT a) AS n_after, count(DISTINCT a) > 1 AS conflict FROM k GROUP BY role""",
    "fixed_slot": "SELECT p_partkey, strlen(p_name) <= 11 AS fits, CASE WHEN strlen(p_name) <= 11 THEN rpad(p_name, 11, ' ') END AS slot FROM part",
    "pool_offsets": "SELECT conv_id, turn, CAST(coalesce(sum(strlen(text) + 1) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS offset FROM conversations",
    "clone_references": """SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 10000 + CAST(sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS BIGINT) - 1 ELSE o_custkey END AS new_index FROM orders""",
    "paged_catalog": """WITH h AS (SELECT p_partkey, p_name, p_brand, p_type, p_size FROM part WHERE lower(p_type) = 'economy' AND
        contains(lower('{"p_partkey":' || p_partkey || ',"p_name":"' || p_name || '","p_brand":"' || p_brand || '","p_type":"' || p_type || '","p_size":' || p_size || '}'), 'ring'))
      SELECT *, (SELECT count(*) FROM h) AS total, CAST(least(10, greatest((SELECT count(*) FROM h) - 3, 0)) AS BIGINT) AS returned,
             CASE WHEN (SELECT count(*) FROM h) > 13 THEN CAST(13 AS BIGINT) END AS next_offset FROM h ORDER BY p_partkey LIMIT 10 OFFSET 3""",
    "name_pattern": "SELECT p_partkey, p_name FROM part WHERE regexp_full_match(lower(p_name), 'r.d.*')",
    "disambiguate": """WITH p AS (SELECT p_partkey, CASE WHEN p_partkey % 7 = 0 THEN p_name || '_' || (p_partkey % 3 + 1) ELSE p_name END AS name FROM part),
      r AS (SELECT *, lower(name) AS low, row_number() OVER (PARTITION BY lower(name) ORDER BY p_partkey) - 1 AS i FROM p),
      free AS (SELECT b.low, k, row_number() OVER (PARTITION BY b.low ORDER BY k) AS i
        FROM (SELECT low, count(*) AS n FROM r GROUP BY low) b, LATERAL (SELECT unnest(range(1, b.n + 5)) AS k) WHERE b.low || '_' || k NOT IN (SELECT low FROM r))
      SELECT p_partkey, name || CASE WHEN r.i = 0 THEN '' ELSE '_' || k END AS slot_name FROM r LEFT JOIN free ON free.low = r.low AND free.i = r.i""",
    "expand_refs": """WITH pool AS (SELECT value, row_number() OVER (ORDER BY value) - 1 AS ref FROM (SELECT DISTINCT p_type AS value FROM part))
      SELECT p_partkey, CAST(p_size % 9 AS BIGINT) AS ref, value, value IS NULL AS bad FROM part LEFT JOIN pool ON pool.ref = p_size % 9""",
    "json_leaf": "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events",
    "json_canonical": """SELECT n_nationkey, '{"n_name":"' || n_name || '","n_regionkey":' || n_regionkey || '}' AS json FROM nation""",
    "header_cells": "SELECT conv_id, turn, coalesce(string_split(text, ' ')[2], '') AS b, '' AS z FROM conversations",
    "preview": r"SELECT doc_id, substr(regexp_replace(trim(text), '[ \t\n\x0b\f\r]+', ' ', 'g'), 1, 40) AS preview FROM documents",
    "name_split": "SELECT conv_id, turn, role AS name, text AS message FROM conversations",
    "ruby_strip": r"""WITH k AS (SELECT doc_id, regexp_replace(text, '([A-Za-z0-9_]+) ([A-Za-z0-9_]+)', '[\1/\2]', 'g') AS t FROM documents)
      SELECT doc_id, md5(regexp_replace(t, '\[([^/\[\]]+)/([^/\[\]]+)\]', '\1', 'g')) AS digest, CAST(len(regexp_extract_all(t, '\[([^/\[\]]+)/([^/\[\]]+)\]')) AS BIGINT) AS n_ruby FROM k""",
    "letter_ranges": "SELECT doc_id, CAST(len(regexp_extract_all(text, '[à-ÿ]')) AS BIGINT) AS n_accented, CAST(len(regexp_extract_all(text, '[一-鿿]')) AS BIGINT) AS n_han FROM documents",
    "charset_plan": """WITH c AS (SELECT doc_id, unnest(string_split(text, '')) AS c FROM documents), g AS (SELECT c, count(*) AS n, min(doc_id) AS first_doc FROM c WHERE c <> '' AND unicode(c) > 127 GROUP BY c)
      SELECT *, 63743 - row_number() OVER (ORDER BY c) + 1 AS proxy FROM g""",
    "variants": """WITH v AS (SELECT replace(p_name, ' ', '_') || unnest(['.txt', '.bin', '.dat']) AS candidate FROM part)
      SELECT lower(candidate) AS key, min(candidate) AS candidate FROM v GROUP BY 1""",
    "quoted_tokens": """SELECT DISTINCT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS token FROM pages""",
    "utf16_units": "SELECT doc_id, CAST(length(text) + len(regexp_extract_all(text, '[\\x{10000}-\\x{10FFFF}]')) AS BIGINT) AS n_units FROM documents",
    "break_policy": "SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN true WHEN 1 THEN false ELSE regexp_replace(text, chr(10), '', 'g') = regexp_replace(upper(text), chr(10), '', 'g') END AS allowed FROM conversations",
    "container_flat": _TRIP,
    "container_chunked": _TRIP,
    "container_tree": _TRIP,
    "container_records": "SELECT CAST(conv_id AS VARCHAR) AS container, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS k, sha256(text) AS sha256 FROM conversations",
    "container_index": "SELECT source AS container, 'dir/' || doc_id || '.txt' AS name, CAST(strlen(text) AS BIGINT) AS size FROM documents WHERE doc_id % 10 = 7",
    "container_replace": "SELECT source AS container, 'dir/' || doc_id || '.txt' AS name, sha256(CASE WHEN doc_id % 10 = 3 THEN 'replaced' ELSE text END) AS sha256 FROM documents",
    "incremental_patch": """WITH n AS (SELECT source AS container, CASE WHEN doc_id % 4 = 1 THEN 'alt/' || (doc_id - 1) ELSE 'dir/' || doc_id END || '.txt' AS name, CASE WHEN doc_id % 9 = 0 THEN 'x' ELSE text END AS t FROM documents),
      o AS (SELECT source AS container, 'dir/' || doc_id || '.txt' AS name, text AS t FROM documents),
      b AS (SELECT container, lower(split_part(name, '/', -1)) AS base, count(*) AS k FROM n GROUP BY ALL)
      SELECT n.container, n.name, sha256(n.t) AS sha256, k > 1 AS conflict, CASE WHEN k = 1 THEN split_part(n.name, '/', -1) END AS packed_as
      FROM n JOIN b ON b.container = n.container AND base = lower(split_part(n.name, '/', -1)) ANTI JOIN o ON o.container = n.container AND o.name = n.name AND o.t = n.t""",
    "codec_roundtrip": "SELECT doc_id, sha256(text) AS sha256 FROM documents",
    "codec_bounded": "SELECT doc_id, strlen(text) <= 2000 AS fits FROM documents",
    "keyed_bytes": "SELECT conv_id, turn, sha256(text) AS sha256 FROM conversations",
    "aes_roundtrip": "SELECT conv_id, turn, sha256(text) AS sha256 FROM conversations",
    "charset_strict": "SELECT doc_id, strlen(text) = length(text) AND NOT regexp_matches(text, '[^\\x00-\\x7F]') AS ascii, true AS same FROM documents",
    "charset_lacking": """WITH c AS (SELECT unnest(string_split(text, '')) AS c FROM documents), g AS (SELECT c, count(*) AS n FROM c WHERE c <> '' AND unicode(c) > 127 GROUP BY c)
      SELECT c, n, upper(to_hex(CAST(63743 - row_number() OVER (ORDER BY n DESC, c) + 1 AS BIGINT))) AS proxy FROM g""",
    "encoding_guess": "SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN 'utf-8' ELSE 'bom-16le' END AS charset FROM conversations",
    "publish_roundtrip": "SELECT doc_id, sha256(text) AS sha256 FROM documents",
    "stream_tumbling": "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 2) AS value FROM events GROUP BY 1, 2",
    "stream_sliding": "SELECT start, event_type, count(*) AS n FROM (SELECT event_type, date_trunc('hour', ts) - INTERVAL (k) HOUR AS start FROM events, (VALUES (0), (1)) v(k)) GROUP BY 1, 2",
    "stream_sessions": """WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS gap FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
      s AS (SELECT *, sum(gap) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM g)
      SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, s""",
    "evidence_scan": f"WITH {_HITS} SELECT * FROM h",
    "evidence_candidates": f"""WITH {_HITS}, r AS (SELECT *, CASE strength WHEN 'probe' THEN 0 WHEN 'filename' THEN 1 ELSE 2 END AS st FROM h),
      x AS (SELECT *, row_number() OVER (PARTITION BY kind, st ORDER BY path) = 1 AS first FROM r),
      y AS (SELECT *, count(*) FILTER (first) OVER (PARTITION BY kind) AS n, row_number() OVER (PARTITION BY kind ORDER BY first DESC, st, path) AS rn FROM x),
      g AS (SELECT kind, string_agg(path, ',' ORDER BY st, path) AS shown, count(*) AS k FROM y WHERE rn <= greatest(3, n) GROUP BY kind)
      SELECT kind, count(DISTINCT path) AS n_files, count(*) AS n_hits, ['probe', 'filename', 'extension'][min(st) + 1] AS best, count(*) > any_value(k) AS capped, any_value(shown) AS shown FROM r JOIN g USING (kind) GROUP BY kind""",
    "scan_limits": f"""WITH {_FILES}, k AS (SELECT path, CAST(len(string_split(path, '/')) - 1 AS BIGINT) AS depth, row_number() OVER (ORDER BY len(string_split(path, '/')), path) AS rn FROM f)
      SELECT path, depth, NOT (depth > 2 OR rn > 300) AS kept, CASE WHEN depth > 2 THEN 'depth' WHEN rn > 300 THEN 'files' END AS reason FROM k""",
    "derived_paths": f"WITH {_FILES} SELECT path, contains(path, '/backup/') AS derived FROM f",
    "volume_sets": """WITH t AS (SELECT DISTINCT source || '.pak' || CASE WHEN doc_id % 50 < 20 THEN '' ELSE '.' || lpad(CAST(doc_id % 50 AS VARCHAR), 3, '0') END AS path FROM documents),
      b AS (SELECT path, regexp_replace(path, '\\.\\d{1,4}$', '') AS base FROM t)
      SELECT base, path, row_number() OVER (PARTITION BY base ORDER BY length(path), path) - 1 AS volume FROM b""",
    "paired_files": """WITH t AS (SELECT DISTINCT source || '/' || doc_id % 7 AS stem, doc_id % 3 = 0 AS i FROM documents)
      SELECT stem, max(CASE WHEN i THEN stem || '.idx' END) AS index_path, max(CASE WHEN NOT i THEN stem || '.dat' END) AS payload_path FROM t GROUP BY stem""",
    "strict_json": "SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'duplicate' WHEN event_id % 7 = 0 THEN 'constant' WHEN event_id % 11 = 0 THEN 'malformed' END AS reason FROM events",
    "tree_nodes": """WITH n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS k FROM conversations)
      SELECT DISTINCT conv_id, 0 AS pos, NULL AS parent, '' AS path, 'object' AS tag, NULL AS value FROM n
      UNION ALL SELECT DISTINCT conv_id, 1, 0, 't', 'string', 'c' FROM n UNION ALL SELECT DISTINCT conv_id, 2, 0, 'a', 'array', NULL FROM n
      UNION ALL SELECT conv_id, 3 + 3 * k, 2, 'a/' || k, 'object', NULL FROM n
      UNION ALL SELECT conv_id, 4 + 3 * k, 3 + 3 * k, 'a/' || k || '/turn', 'integer', CAST(turn AS VARCHAR) FROM n
      UNION ALL SELECT conv_id, 5 + 3 * k, 3 + 3 * k, 'a/' || k || '/role', 'string', role FROM n""",
    "event_leaves": """WITH n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS k FROM conversations)
      SELECT conv_id, 0 AS event, k AS ordinal, 401 AS code, role AS leaf FROM n WHERE role = 'user'""",
    "delimited_rows": "SELECT p_partkey // 50 AS g, p_partkey % 50 AS line, p_name AS value, CASE WHEN p_partkey % 9 = 0 THEN 3 ELSE 2 END AS n_fields, p_partkey % 9 <> 0 AS rectangular FROM part",
    "xml_resources": """WITH l AS (SELECT n_regionkey, n_nationkey AS t, n_nationkey + 1 AS m FROM nation UNION ALL SELECT DISTINCT n_regionkey, 999, 0 FROM nation),
      k AS (SELECT *, row_number() OVER (PARTITION BY n_regionkey ORDER BY t) - 1 AS position FROM l)
      SELECT k.n_regionkey, position, b.n_name AS name, a.n_name AS message, a.n_name IS NULL AS dangling FROM k
      LEFT JOIN nation a ON a.n_nationkey = t AND a.n_regionkey = k.n_regionkey LEFT JOIN nation b ON b.n_nationkey = m AND b.n_regionkey = k.n_regionkey""",
    "grid_records": """SELECT p_partkey // 100 AS book, p_partkey AS row, CASE WHEN p_partkey % 13 = 0 THEN '//note' WHEN p_partkey % 17 = 0 THEN '' ELSE p_type END AS command,
      CASE WHEN p_partkey % 13 = 0 OR p_partkey % 17 = 0 THEN '' ELSE p_name END AS text,
      CASE WHEN p_partkey % 13 = 0 THEN 'comment' WHEN p_partkey % 17 = 0 THEN 'empty' WHEN p_type = 'ECONOMY' THEN 'text' WHEN p_type = 'STANDARD' THEN 'other' ELSE 'unknown' END AS role
      FROM part WHERE p_partkey % 100 <> 0""",
    "tag_lexer": f"SELECT page_id, CAST(len({_TAGS}) AS BIGINT) AS n_tags, CAST(length(html) AS BIGINT) AS n_chars, md5(html) AS digest FROM pages",
    "tag_attributes": """SELECT page_id, href, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS href FROM pages) GROUP BY ALL""",
    "handoff": f"""{_VALID}, g AS (SELECT conv_id, count(*) AS n_rows, count(*) FILTER (reason <> 'ok') AS n_open, min(turn) FILTER (reason <> 'ok') AS first_open FROM j GROUP BY conv_id)
      SELECT *, CASE WHEN n_open = 0 THEN 'success' WHEN n_open < n_rows THEN 'partial' ELSE 'blocked' END AS state FROM g""",
    "path_check": """SELECT doc_id, [ 'a/b.ks', NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, 'ok/name.txt'][doc_id % 10 + 1] AS path,
      [NULL, 'segment', 'absolute', 'colon', 'segment', 'reserved', 'reserved', 'trailing', 'trailing', NULL][doc_id % 10 + 1] AS reason FROM documents""",
    "path_collisions": """WITH k AS (SELECT source || CASE WHEN doc_id % 25 = 0 THEN '' ELSE '/' || doc_id % 40 END AS key, source, doc_id % 25 = 0 AS file FROM documents)
      SELECT key, count(*) AS n, 'same' AS kind FROM k GROUP BY key HAVING count(*) > 1
      UNION ALL SELECT source, count(*), 'prefix' FROM k WHERE NOT file AND source IN (SELECT key FROM k WHERE file) GROUP BY source""",
    "pointer_repair": "SELECT conv_id || '/' || turn AS k, '0A000000' AS pointer, sha256(text) AS sha256, 'success' AS status FROM conversations",
    "rel_pricing": """SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc, round(avg(l_discount), 6) AS avg_disc, count(*) AS n
      FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2""",
    "rel_cube": "SELECT o_orderstatus, o_orderpriority, count(*) AS n, CAST(grouping(o_orderstatus, o_orderpriority) AS BIGINT) AS gid FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)",
    "rel_rollup": "SELECT p_brand, p_type, count(*) AS n, max(p_size) AS max_size FROM part GROUP BY ROLLUP (p_brand, p_type)",
    "rel_windows": """SELECT o_orderkey, row_number() OVER w AS rn, lag(o_orderkey) OVER w AS prev, round(sum(o_totalprice) OVER (w ROWS UNBOUNDED PRECEDING), 2) AS running, ntile(4) OVER w AS quart
      FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)""",
    "rel_asof": """SELECT a.o_orderkey AS lk, arg_max(b.o_orderkey, (epoch_us(b.o_orderdate)::HUGEINT * 1000000000 + b.o_orderkey)) AS asof
      FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND b.o_orderdate <= a.o_orderdate + INTERVAL 90 DAY GROUP BY 1""",
    "rel_sets": """SELECT k, 'customer' AS side FROM (SELECT c_nationkey AS k FROM customer EXCEPT SELECT s_nationkey FROM supplier)
      UNION ALL SELECT k, 'both' FROM (SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier)""",
    "rel_top_customers": """SELECT c_custkey, c_name, c_mktsegment, round(sum(o_totalprice), 2) AS spent FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2, 3 ORDER BY spent DESC, c_custkey LIMIT 20""",
    "rel_sessions": """WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w > INTERVAL 30 MINUTE OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS gap FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
      s AS (SELECT *, CAST(sum(gap) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session FROM g)
      SELECT user_id, session, count(*) AS n, round(sum(value), 2) AS value FROM s GROUP BY 1, 2""",
    "rel_hourly": "SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n, round(avg(value), 4) AS mean FROM events GROUP BY 1, 2",
}
ORACLES |= delivery.ORACLES
