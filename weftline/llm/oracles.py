"""DuckDB SQL for the operators that SQL can express."""

from __future__ import annotations

from .queries import MIX_BLOCK, MIX_OTHER, MIX_WEIGHTS, PACK_BUCKETS, PACK_BUDGET, PACK_MAX

OP2 = rf"""
WITH RECURSIVE doc AS (
  SELECT doc_id, substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS h,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS n
  FROM documents),
seq AS (
  SELECT doc_id, h, piece, least(n - piece * {PACK_MAX}, {PACK_MAX}) AS n_tokens
  FROM (SELECT doc_id, h, n, unnest(range(0, greatest(CAST(ceil(n / {PACK_MAX}.0) AS BIGINT), 1))) AS piece FROM doc)),
hist AS (
  SELECT n_tokens AS x, row_number() OVER (ORDER BY n_tokens) AS j,
         CAST(sum(count(*)) OVER (ORDER BY n_tokens) AS BIGINT) AS cn,
         CAST(sum(count(*) * n_tokens) OVER (ORDER BY n_tokens) AS BIGINT) AS cs
  FROM seq GROUP BY n_tokens),
cum AS (SELECT * FROM hist UNION ALL SELECT 0, 0, 0, 0),
dp AS (
  SELECT 1 AS k, j, x * cn - cs AS cost, CASE WHEN j = 0 THEN CAST([] AS BIGINT[]) ELSE [x] END AS path FROM cum
  UNION ALL
  SELECT k + 1, j, min(c), arg_min(path, CAST(c AS HUGEINT) * 1000000 + tie)
  FROM (SELECT d.k, b.j,
               CASE WHEN d.j = b.j THEN d.cost ELSE d.cost + b.x * (b.cn - a.cn) - (b.cs - a.cs) END AS c,
               CASE WHEN d.j = b.j THEN -1 ELSE d.j END AS tie,
               CASE WHEN d.j = b.j THEN d.path ELSE list_append(d.path, b.x) END AS path
        FROM dp d JOIN cum a ON a.j = d.j JOIN cum b ON d.j <= b.j
        WHERE d.k < {PACK_BUCKETS})
  GROUP BY k, j),
bounds AS (SELECT path FROM dp WHERE k = {PACK_BUCKETS} AND j = (SELECT max(j) FROM cum)),
put AS (
  SELECT doc_id, h, piece, n_tokens, CAST(len(list_filter(path, lambda b: b < n_tokens)) AS BIGINT) AS bucket, path
  FROM seq, bounds),
num AS (
  SELECT *, path[bucket + 1] AS bucket_len,
         row_number() OVER (PARTITION BY bucket ORDER BY h, doc_id NULLS FIRST, n_tokens, piece) - 1 AS i
  FROM put),
fit AS (SELECT *, greatest(1, {PACK_BUDGET} // greatest(bucket_len, 1)) AS m FROM num)
SELECT doc_id, piece, n_tokens, bucket, bucket_len, i // m AS batch, i % m AS slot, bucket_len - n_tokens AS n_pad FROM fit
"""

_shares = ", ".join(f"('{k}', {v})" for k, v in MIX_WEIGHTS.items())
OP6 = rf"""
WITH RECURSIVE w(name, share) AS (VALUES {_shares}, ('*', {MIX_OTHER})),
doc AS (
  SELECT doc_id, source, coalesce(w.name, '*') AS mix_source, substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS h
  FROM documents LEFT JOIN w ON source = w.name AND w.name <> '*'),
num AS (
  SELECT *, row_number() OVER (PARTITION BY mix_source ORDER BY h, doc_id NULLS FIRST) - 1 AS i FROM doc),
src AS (
  SELECT mix_source AS name, CAST(max(w.share) AS BIGINT) AS share, CAST(ceil(count(*) / {MIX_BLOCK}.0) AS BIGINT) AS n
  FROM doc JOIN w ON mix_source = w.name GROUP BY mix_source),
ps AS (
  SELECT DISTINCT p FROM (SELECT 0 AS p UNION ALL SELECT n // share FROM src UNION ALL SELECT (n + share - 1) // share FROM src)),
pr AS (SELECT p AS p_from, lead(p) OVER (ORDER BY p) AS p_to FROM ps),
tm AS (
  SELECT p_from, p_to, list(name ORDER BY name) AS names,
         list(greatest(0, least(share, n - p_from * share)) ORDER BY name) AS c,
         CAST(sum(greatest(0, least(share, n - p_from * share))) AS BIGINT) AS d,
         CAST(sum(least(n, p_from * share)) AS BIGINT) AS start
  FROM pr, src WHERE p_to IS NOT NULL GROUP BY p_from, p_to),
edf AS (
  SELECT p_from, 0 AS t, c, d, list_transform(c, lambda x: 0) AS done, CAST(NULL AS STRUCT(dl BIGINT, i BIGINT)) AS pick, CAST(NULL AS BIGINT) AS j FROM tm
  UNION ALL
  SELECT p_from, t + 1, c, d, list_transform(done, lambda x, k: x + CASE WHEN k = got.i THEN 1 ELSE 0 END), got, done[got.i]
  FROM (SELECT *, list_min(list_transform(
                 list_filter(range(1, len(c) + 1), lambda k: done[k] < c[k] AND done[k] * d // greatest(c[k], 1) <= t),
                 lambda k: {{'dl': CAST(((done[k] + 1) * d + c[k] - 1) // greatest(c[k], 1) AS BIGINT), 'i': CAST(k AS BIGINT)}})) AS got
        FROM edf WHERE t < d)),
ran AS (
  SELECT e.p_from, p_to, names[pick.i] AS name, j, (j * e.d) // greatest(e.c[pick.i], 1) AS r, pick.dl AS dl, t - 1 AS t, e.d, start
  FROM edf e JOIN tm USING (p_from) WHERE t > 0),
blk AS (SELECT num.*, share, i // {MIX_BLOCK} AS block, i % {MIX_BLOCK} AS slot_row FROM num JOIN src ON name = mix_source)
SELECT doc_id, source, mix_source, blk.share, block, start + (block // share - p_from) * d + r AS release,
       start + (block // share - p_from) * d + dl AS deadline, start + (block // share - p_from) * d + t AS slot, slot_row
FROM blk JOIN ran ON ran.name = mix_source AND j = block % share AND block // share >= p_from AND block // share < p_to
"""

ORACLES = {"op2_packing": OP2, "op6_mixing": OP6}
