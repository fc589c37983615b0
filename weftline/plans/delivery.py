"""Registered queries of delivery: writers, read-back, files of tables and codecs,
with the DuckDB SQL of each beside it."""

from __future__ import annotations

import pandas as pd
import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import charset, codecs
from ..functions import text as tx
from ..operators import catalog, contract, edits, overlay, resolve, rewrite, verify
from ..sources import containers, structured
from ..sources import tables_in_files as inside
from ..sources.tables import load
from ..streaming import windows

QUERIES, ORACLES = {}, {}


def query(sql):
    def put(fn):
        QUERIES[fn.__name__], ORACLES[fn.__name__] = fn, sql
        return fn

    return put


def _turns(s, d):
    """Turns numbered from 0 within their conversation."""
    k = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")).cast("long") - 1
    return load(s, d, "conversations").withColumn("k", k)


_TURNS = "t AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS k FROM conversations)"


def _joined(rows, by, order, line, between, out):
    g = rows.groupBy(by).agg(F.sort_array(F.collect_list(F.struct(order, line.alias("l")))).alias("s"))
    return g.select(by, F.array_join(F.transform("s", lambda x: x.l), between).alias(out))


@query(r"""WITH p AS (SELECT p_partkey // 50 AS g, p_partkey, p_name, CASE WHEN p_partkey % 5 = 0 THEN upper(p_name) ELSE '' END AS v FROM part)
  SELECT g, CASE WHEN g = 2 THEN 'blocked' ELSE 'success' END AS status,
    md5('id,Original text,Translated text' || chr(13) || chr(10) || CASE WHEN g = 2 THEN string_agg(p_partkey || ',' || p_name || ',', chr(13) || chr(10) ORDER BY p_partkey)
      ELSE string_agg(p_partkey || ',' || p_name || ',' || v || chr(13) || chr(10), '' ORDER BY p_partkey) END) AS digest FROM p GROUP BY g""")
def csv_rewrite(s, d):
    p = load(s, d, "part").select(F.floor(F.col("p_partkey") / 50).alias("g"), "p_partkey", "p_name")
    docs = _joined(p, "g", "p_partkey", F.concat_ws(",", F.col("p_partkey").cast("string"), "p_name", F.lit("")), "\r\n", "t")
    docs = docs.select("g", F.concat(F.lit("id,Original text,Translated text\r\n"), "t").alias("t"))
    line = F.row_number().over(Window.partitionBy("g").orderBy("p_partkey")) - 1
    new = p.withColumn("line", line).where("p_partkey % 5 = 0").select("g", "line", F.upper("p_name").alias("value"))
    new = new.unionByName(docs.where("g = 2").select("g", F.lit(9999).alias("line"), F.lit("none").alias("value")))
    return rewrite.delimited(docs, new, "g", "t", "Original text").select("g", "status", F.md5("content").alias("digest"))


@query("""WITH n AS (SELECT n_regionkey, n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN lower(n_name) ELSE n_name END AS v FROM nation),
  k AS (SELECT *, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS position FROM n)
  SELECT k.n_regionkey, position, k.v AS message, b.v AS name FROM k LEFT JOIN n b ON b.n_nationkey = k.n_nationkey + 1 AND b.n_regionkey = k.n_regionkey""")
def xml_rewrite(s, d):
    n = load(s, d, "nation").withColumn("n_nationkey", F.col("n_nationkey").cast("string"))
    res = _joined(n, "n_regionkey", "n_nationkey", F.concat(F.lit('<Res id="'), "n_nationkey", F.lit('">'), "n_name", F.lit("</Res>")), "", "r")
    log = F.concat(F.lit('<Log text="'), "n_nationkey", F.lit('" name="'), (F.col("n_nationkey").cast("int") + 1).cast("string"), F.lit('"/>'))
    log = n.groupBy("n_regionkey").agg(F.sort_array(F.collect_list(F.struct(F.col("n_nationkey").cast("int").alias("o"), log.alias("l")))).alias("s"))
    docs = res.join(log, "n_regionkey").select("n_regionkey", F.concat(F.lit("<Doc>"), "r", F.array_join(F.transform("s", lambda x: x.l), ""), F.lit("</Doc>")).alias("x"))
    new = n.where("n_nationkey % 2 = 0").select("n_regionkey", F.col("n_nationkey").alias("id"), F.lower("n_name").alias("value"))
    out = rewrite.resources(docs, new, "n_regionkey", "x")
    return structured.text_resources(out, "n_regionkey", "content").select("n_regionkey", "position", "message", "name")


def _records(s, d):
    m = _turns(s, d).select(F.col("conv_id").cast("string").alias("container"), F.col("k").alias("ordinal"), F.lit("").alias("name"), F.encode("text", "UTF-8").alias("payload"))
    return containers.build(m, "records")


@query(f"WITH {_TURNS} SELECT CAST(conv_id AS VARCHAR) AS container, k, sha256(CASE WHEN k % 3 = 0 THEN text || '!' ELSE text END) AS sha256 FROM t")
def record_rewrite(s, d):
    new = _turns(s, d).where("k % 3 = 0").select(F.col("conv_id").cast("string").alias("container"), F.col("k").alias("index"), F.encode(F.concat("text", F.lit("!")), "UTF-8").alias("payload"))
    out = containers.scan(rewrite.records(_records(s, d), new, "container", "content"), "records", payload=True)
    return out.select("container", F.col("ordinal").alias("k"), F.sha2("payload", 256).alias("sha256"))


@query(f"""WITH {_TURNS} SELECT conv_id, 4 * k AS field, md5(CASE WHEN k % 4 = 1 THEN 'new ' || text ELSE text END) AS digest, 'success' AS status FROM t""")
def append_repoint(s, d):
    t = _turns(s, d).withColumn("field", 4 * F.col("k"))
    head = t.groupBy("conv_id").agg(F.unhex(F.repeat(F.lit("00000000"), F.count(F.lit(1)).cast("int"))).alias("content"))
    first = rewrite.append(head, t.select("conv_id", "field", F.encode("text", "UTF-8").alias("payload")), "conv_id", "content")
    new = t.where("k % 4 = 1").select("conv_id", "field", F.encode(F.concat(F.lit("new "), "text"), "UTF-8").alias("payload"))
    out = rewrite.append(first.select("conv_id", "content"), new, "conv_id", "content")
    return inside.strings_at(out, t.select("conv_id", "field"), "conv_id", "content").select("conv_id", "field", F.md5("body").alias("digest"), "status")


@query(f"""WITH {_TURNS} SELECT conv_id, CASE WHEN conv_id % 7 = 0 THEN 'blocked' ELSE 'success' END AS status, k,
  CASE WHEN k % 2 = 0 AND conv_id % 7 <> 0 THEN 'R' || k ELSE role END AS role FROM t""")
def tree_patch(s, d):
    t = _turns(s, d)
    docs = t.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("k", "role"))).alias("c"))
    docs = docs.select("conv_id", F.to_json(F.struct("c")).alias("j"))
    new = t.where("k % 2 = 0").select("conv_id", F.array(F.lit("c"), F.col("k").cast("string"), F.lit("role")).alias("path"), F.concat(F.lit("R"), F.col("k").cast("string")).alias("value"))
    new = new.unionByName(docs.where("conv_id % 7 = 0").select("conv_id", F.array(F.lit("c"), F.lit("0"), F.lit("k")).alias("path"), F.lit("a number").alias("value")))
    out = rewrite.leaves(docs, new, "conv_id", "j")
    c = F.from_json("content", "c array<struct<k:bigint,role:string>>").getField("c")
    return out.select("conv_id", "status", F.explode(c).alias("x")).select("conv_id", "status", "x.k", "x.role")


@query(r"""SELECT c_custkey, 'success' AS status, '{"c_custkey":' || c_custkey || ',"note":"{\"c_name\":\"' || c_name || '\",\"seg\":\"' ||
  CASE WHEN c_custkey % 3 = 0 THEN lower(c_mktsegment) ELSE c_mktsegment END || '\"}"}' AS content FROM customer""")
def nested_json(s, d):
    c = load(s, d, "customer")
    docs = c.select("c_custkey", F.to_json(F.struct("c_custkey", F.to_json(F.struct("c_name", F.col("c_mktsegment").alias("seg"))).alias("note"))).alias("j"))
    new = c.where("c_custkey % 3 = 0").select("c_custkey", F.array(F.lit("note"), F.lit("seg")).alias("path"), F.lower("c_mktsegment").alias("value"))
    return rewrite.nested_leaves(docs, new, "c_custkey", "j", [["note"]]).select("c_custkey", "status", "content")


def _word(n):
    """A number as four bytes, least first."""
    h = F.lpad(F.hex(n), 8, "0")
    return F.unhex(F.concat(*[F.substring(h, k, 2) for k in (7, 5, 3, 1)]))


def _number(data, at):
    h = F.hex(F.substring(data, at, 4))
    return F.conv(F.concat(*[F.substring(h, k, 2) for k in (7, 5, 3, 1)]), 16, 10).cast("long")


@query("""SELECT conv_id, turn, 8 + strlen(text || '/' || turn) AS absolute, strlen(text || '/' || turn) AS relative, sha256(text || '/' || turn || 'TAIL') AS sha256, 'success' AS status
  FROM conversations WHERE text <> ''""")
def code_relocate(s, d):
    t = load(s, d, "conversations").where("text <> ''").withColumn("key", F.format_string("%d/%d", "conv_id", "turn")).withColumn("n", F.octet_length("text").cast("long"))
    docs = t.select("key", F.concat(_word(F.col("n") + 8), _word(F.col("n")), F.encode("text", "UTF-8"), F.encode(F.lit("TAIL"), "UTF-8")).alias("content"))
    new = t.select("key", F.lit(8).cast("long").alias("start"), (F.col("n") + 8).alias("end"), F.encode(F.concat_ws("/", "text", F.col("turn").cast("string")), "UTF-8").alias("payload"))
    jumps = t.select("key", F.explode(F.array(F.struct(F.lit(0).cast("long").alias("field"), F.lit(False).alias("relative")), F.struct(F.lit(4).cast("long").alias("field"), F.lit(True).alias("relative")))).alias("x")).select("key", "x.*")
    out = rewrite.code(docs, new, jumps, "key", "content").join(t.select("key", "conv_id", "turn"), "key")
    return out.select("conv_id", "turn", _number("content", 1).alias("absolute"), _number("content", 5).alias("relative"), F.sha2(F.substring("content", 9, 1 << 30), 256).alias("sha256"), "status")


def _members(s, d):
    return load(s, d, "documents").select(F.col("source").alias("container"), F.col("doc_id").alias("ordinal"), F.concat(F.lit("dir/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("name"), F.encode("text", "UTF-8").alias("payload"))


def _new_members(s, d):
    return _members(s, d).where("ordinal % 10 = 3").select("container", "name", F.encode(F.concat(F.lit("new "), "name"), "UTF-8").alias("payload"))


@query("""SELECT source AS container, 'dir/' || doc_id || '.txt' AS name, sha256(CASE WHEN doc_id % 10 = 3 THEN 'new dir/' || doc_id || '.txt' ELSE text END) AS sha256, 'success' AS status FROM documents""")
def container_patch(s, d):
    out = containers.patch(containers.build(_members(s, d), "flat"), _new_members(s, d), "flat")
    return containers.scan(out, "flat", payload=True).select("container", "name", F.sha2("payload", 256).alias("sha256"), "status")


@query("SELECT source AS container, 'dir/' || doc_id || '.txt' AS name, CAST(strlen(text) AS BIGINT) AS size, sha256(text) AS sha256, 'success' AS status FROM documents")
def container_bundle(s, d):
    out = containers.scan_pieces(containers.build_pieces(_members(s, d), "bundle"), "bundle", payload=True)
    return out.select("container", "name", "size", F.sha2("payload", 256).alias("sha256"), "status")


@query("SELECT DISTINCT source AS container, 'plain' AS profile FROM documents")
def profile_dispatch(s, d):
    return containers.detect_profile(containers.build(_members(s, d), "chunked"))


_ADDRESS = r"""replace(html, '<a href="/', '<a href="/zh/')"""


@query(f"SELECT page_id, md5({_ADDRESS}) AS digest FROM pages")
def attribute_rewrite(s, d):
    """Every address led elsewhere at its own span; all else as it was."""
    p = load(s, d, "pages").select("page_id", "html")
    spans = structured.attribute_spans(p, "page_id", "html").where("tag = 'a' and name = 'href' and value like '/%'")
    new = spans.select("page_id", "start", "end", F.concat(F.lit("/zh"), "value").alias("replacement"))
    return edits.splice(p, new, "page_id", "html").select("page_id", F.md5("spliced").alias("digest"))


@query("""SELECT n_nationkey, CASE WHEN n_nationkey % 3 = 0 THEN lower(n_name) ELSE n_name END AS value, CASE WHEN n_nationkey % 3 = 0 THEN 'own' ELSE 'fallback' END AS state FROM nation""")
def language_attributes(s, d):
    x = F.concat(F.lit("<m text='"), "n_name", F.lit("'"), F.when(F.col("n_nationkey") % 3 == 0, F.concat(F.lit(' textEn="'), F.lower("n_name"), F.lit('"'))).otherwise(""), F.lit("/>"))
    spans = structured.attribute_spans(load(s, d, "nation").select("n_nationkey", x.alias("x")), "n_nationkey", "x")
    return structured.in_language(spans, ["n_nationkey"], "text", "En").select("n_nationkey", "value", "state")


@query("""SELECT source AS container, 'dir/' || doc_id || '.txt' AS name, CASE WHEN doc_id % 10 = 3 THEN 'replaced' ELSE 'same' END AS state, true AS ok FROM documents""")
def container_readback(s, d):
    old, new = containers.build(_members(s, d), "chunked"), _new_members(s, d)
    out = containers.patch(old, new, "chunked")
    return verify.members(containers.scan(old, "chunked", payload=True), containers.scan(out, "chunked", payload=True), new, ["container", "name"])


@query("SELECT CAST(conv_id AS VARCHAR) AS container, count(*) AS n_rows, 0 AS n_wrong, true AS ok FROM conversations GROUP BY 1")
def trial_edit(s, d):
    def read(files):
        out = containers.scan(files.select("container", "content"), "records", payload=True)
        return out.select("container", F.col("ordinal").alias("index"), F.decode("payload", "UTF-8").alias("body"))

    def write(files, changes):
        return rewrite.records(files, changes.withColumn("payload", F.encode("body", "UTF-8")), "container", "content")

    return verify.trial(_records(s, d), read, write, "container", "index", "body")


@query(f"""WITH {_TURNS} SELECT conv_id, k, k % 9 <> 4 AS stored_ok, k % 9 <> 4 AS shown_ok FROM t""")
def two_level_readback(s, d):
    pair = {"e": "\ue001", "a": "\ue002"}
    t = _turns(s, d).select("conv_id", "k", F.concat("text", F.lit("ea")).alias("body"))
    proxies = t.withColumn("body", charset.substitute(F.col("body"), pair))
    stored = proxies.withColumn("body", F.when(F.col("k") % 9 == 4, F.concat("body", F.lit("?"))).otherwise(F.col("body")))
    return verify.two_levels(stored, proxies, t, ["conv_id", "k"], "body", lambda c: charset.substitute(c, {v: k for k, v in pair.items()}))


@query("""SELECT 'n' || doc_id AS path, CASE WHEN doc_id % 77 = 0 THEN 'lost' WHEN doc_id % 50 = 0 THEN 'changed' ELSE 'same' END AS state FROM documents""")
def input_unchanged(s, d):
    f = load(s, d, "documents").select("doc_id", F.concat(F.lit("n"), F.col("doc_id").cast("string")).alias("path"), F.encode("text", "UTF-8").alias("content"))
    later = f.where("doc_id % 77 <> 0").withColumn("content", F.when(F.col("doc_id") % 50 == 0, F.encode(F.lit("changed since"), "UTF-8")).otherwise(F.col("content")))
    return verify.unchanged(verify.digests(f, "path", "content"), verify.digests(later, "path", "content"))


@query("SELECT source, CAST(sum(strlen(text)) AS BIGINT) AS n_bytes, CASE WHEN sum(strlen(text)) > 100000 THEN 'blocked' ELSE 'success' END AS status FROM documents GROUP BY source")
def byte_budget(s, d):
    return verify.within_bytes(load(s, d, "documents"), "source", "text", 100_000, 1 << 50)


@query("""SELECT CAST(p_size AS BIGINT) AS size, 'parts' AS "table", row_number() OVER (PARTITION BY p_size ORDER BY p_partkey) - 1 AS row, p_partkey AS id, p_name AS name, 'success' AS status FROM part""")
def typed_rows(s, d):
    def make(t: pa.Table) -> pa.Table:
        t = t.sort_by("p_partkey")
        rows = [list(r) for r in zip(t.column("p_partkey").to_pylist(), t.column("p_name").to_pylist(), strict=True)]
        return pa.table({"size": pa.array([t.column("size")[0].as_py()], pa.int64()), "content": pa.array([inside.build_typed([("parts", [("id", 4), ("name", 0)], rows)])], pa.binary())})

    p = load(s, d, "part").select(F.col("p_size").cast("long").alias("size"), F.col("p_partkey").cast("long").alias("p_partkey"), "p_name")
    out = inside.typed_rows(p.groupBy("size").applyInArrow(make, "size long, content binary"), "size", "content")
    return out.select("size", "table", "row", F.col("values")["id"].cast("long").alias("id"), F.col("values")["name"].alias("name"), "status")


@query(f"""WITH {_TURNS} SELECT conv_id, 2 + k AS line, replace(text, chr(10), ' ') AS body FROM t""")
def packed_lines(s, d):
    t = _joined(_turns(s, d), "conv_id", "k", F.replace("text", F.lit("\n"), F.lit(" ")), "\n", "t")
    t = t.select("conv_id", inside.pack_string(F.concat(F.lit("head\n\\text\n"), "t", F.lit("\n\\endtext\ntail"))).alias("z"))
    return inside.block_lines(t.select("conv_id", inside.unpack_string(F.col("z")).alias("t")), "conv_id", "t")


@query("""SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN '{"formats":[{"b":{"a":"' || p_name || '"}},{"a":"' || p_name || '"}]}' END AS content,
  CASE p_partkey % 4 WHEN 0 THEN 'success' ELSE 'blocked' END AS status, [NULL, 'reference', 'cycle', 'reference'][p_partkey % 4 + 1] AS reason FROM part""")
def shared_refs(s, d):
    k = F.col("p_partkey") % 4
    ref = F.when(k == 1, "9").when(k == 2, "2").when(k == 3, "true").otherwise("0")
    j = F.concat(F.lit('{"shared":[{"a":"'), "p_name", F.lit('"},{"b":{"$ref":0}},[{"$ref":2}]],"formats":[{"$ref":1},{"$ref":'), ref, F.lit("}]}"))
    return inside.expand_shared(load(s, d, "part").select("p_partkey", j.alias("j")), "p_partkey", "j").select("p_partkey", "content", "status", "reason")


@query(r"""SELECT p_partkey, [u || '/x.ks', 'dir/' || u, u, NULL, NULL, u || '.txt', NULL, u][p_partkey % 8 + 1] AS token FROM (SELECT p_partkey, replace(p_name, ' ', '_') AS u FROM part)""")
def clean_tokens(s, d):
    u = F.replace("p_name", F.lit(" "), F.lit("_"))
    raw = [F.concat(F.lit(' "'), u, F.lit('\\x.ks" ')), F.concat(F.lit("12:dir/"), u, F.lit("|tail")), F.concat(F.lit("@"), u, F.lit("#tag")), F.concat(u, F.lit(" two")), F.lit("3.5"), F.concat(F.lit("./"), u, F.lit(".txt,")), F.concat(F.lit("*"), u), F.concat(F.lit("("), u, F.lit(")@e"))]
    k = load(s, d, "part").select("p_partkey", F.element_at(F.array(*raw), (F.col("p_partkey") % 8 + 1).cast("int")).alias("t"))
    return k.select("p_partkey", tx.clean_token(F.col("t")).alias("token"))


@query(r"""WITH a AS (SELECT DISTINCT replace(p_name, ' ', '_') || '.ks' AS n FROM part), b AS (SELECT DISTINCT upper(replace(p_name, ' ', '_')) || '.KS' AS n FROM part WHERE p_size < 10),
  c AS (SELECT DISTINCT s_name AS n FROM supplier), e AS (SELECT lower(n) AS key, n, 0 AS i FROM a UNION ALL SELECT lower(n), n, 1 FROM b UNION ALL SELECT lower(n), n, 2 FROM c)
  SELECT key, arg_min(n, i) AS name, count(DISTINCT i) AS n_sources FROM e GROUP BY key""")
def candidate_union(s, d):
    p = load(s, d, "part").withColumn("u", F.replace("p_name", F.lit(" "), F.lit("_")))
    a = p.select(tx.clean_token(F.concat(F.lit('"'), "u", F.lit('.ks"'))).alias("name"))
    b = p.where("p_size < 10").select(F.upper(F.concat("u", F.lit(".ks"))).alias("name"))
    return tx.union_first([a, b, load(s, d, "supplier").select(F.col("s_name").alias("name"))], "name")


_ESCAPES = [("\\\\", "\\"), ("\\n", "\n"), ("\\t", "\t"), ("\\q", '"')]


@query(r"""SELECT conv_id, turn, md5(replace(replace(replace(replace(text || chr(9) || '"\n', '\', '\\'), chr(10), '\n'), chr(9), '\t'), '"', '\q')) AS digest, true AS same FROM conversations""")
def escape_roundtrip(s, d):
    t = load(s, d, "conversations").withColumn("t", F.concat("text", F.lit('\t"\\n'))).withColumn("e", tx.escape(F.col("t"), _ESCAPES))
    return t.select("conv_id", "turn", F.md5("e").alias("digest"), (tx.unescape(F.col("e"), _ESCAPES) == F.col("t")).alias("same"))


@query("""SELECT n_nationkey, CASE WHEN n_nationkey % 5 = 0 THEN NULL ELSE n_name END AS base, CASE WHEN n_nationkey % 5 = 0 THEN NULL ELSE lower(n_name) END AS reading FROM nation""")
def ruby_roundtrip(s, d):
    n = load(s, d, "nation").select("n_nationkey", tx.with_ruby(F.col("n_name"), F.when(F.col("n_nationkey") % 5 == 0, "a/b").otherwise(F.lower("n_name"))).alias("r"))
    first = F.get(tx.ruby_pairs(F.concat(F.lit("x"), "r", F.lit("y"))), F.lit(0))
    return n.select("n_nationkey", first.getField("base").alias("base"), first.getField("reading").alias("reading"))


_LINES = "l AS (SELECT doc_id, CAST(unnest(range(0, len(x))) AS BIGINT) AS line, unnest(x) AS body FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents))"


@query(f"""WITH {_LINES}, c AS (SELECT doc_id, line, unnest(string_split(body, '')) AS c FROM l),
  p AS (SELECT doc_id, line, c, count(*) AS n FROM c WHERE c <> '' AND unicode(c) > 127 GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY doc_id, line) AS rn FROM p)
  SELECT c, CAST(sum(n) AS BIGINT) AS n, count(*) AS n_lines, string_agg(doc_id || ':' || line, ',' ORDER BY doc_id, line) FILTER (rn <= 5) AS places FROM r GROUP BY c""")
def lacking_places(s, d):
    out = charset.lacking_places(load(s, d, "documents"), "doc_id", "text", "ascii", 5)
    return out.withColumn("places", F.array_join(F.transform("places", lambda x: F.concat_ws(":", x.doc_id.cast("string"), x.line.cast("string"))), ","))


@query("""SELECT doc_id, NOT regexp_matches(replace(text, 'é', 'e'), '[^\\x00-\\x7F]') AS fits, CASE WHEN NOT regexp_matches(replace(text, 'é', 'e'), '[^\\x00-\\x7F]') THEN sha256(replace(text, 'é', 'e')) END AS sha256 FROM documents""")
def transcode_table(s, d):
    t = load(s, d, "documents").select("doc_id", charset.transcode(F.encode("text", "UTF-8"), "utf-8", "ascii", {"é": "e"}).alias("b"))
    return t.select("doc_id", F.col("b").isNotNull().alias("fits"), F.sha2("b", 256).alias("sha256"))


@query(r"""SELECT n_nationkey, CASE WHEN n_nationkey % 6 = 5 THEN NULL ELSE n_name || '\p' || chr(13) || chr(10) || 'x' END AS escaped, n_nationkey % 6 <> 5 AS same FROM nation""")
def control_escapes(s, d):
    # a second byte F0 behind a first byte is no control; EF F1 is unknown
    data = F.concat(F.encode("n_name", "UTF-8"), F.unhex(F.when(F.col("n_nationkey") % 6 == 5, "EFF1").otherwise("EFF2EFF0")), F.encode(F.lit("x"), "UTF-8"))
    n = load(s, d, "nation").select("n_nationkey", data.alias("b")).withColumn("e", charset.control_escapes(F.col("b")))
    return n.select("n_nationkey", F.decode("e", "UTF-8").alias("escaped"), F.coalesce(charset.control_escapes(F.col("e"), True) == F.col("b"), F.lit(False)).alias("same"))


@query("""WITH t AS (SELECT doc_id, text FROM documents), n AS (SELECT doc_id, text FROM t WHERE doc_id % 2 = 0), m(c, proxy) AS (VALUES ('é', 'Q'), ('ü', 'e'), ('ñ', '~')),
  need AS (SELECT c, count(*) AS n FROM (SELECT unnest(string_split(text, '')) AS c FROM n) WHERE c <> '' AND unicode(c) > 127 GROUP BY c),
  lit AS (SELECT proxy, doc_id, count(*) AS k FROM (SELECT doc_id, unnest(string_split(text, '')) AS proxy FROM (SELECT * FROM t WHERE doc_id % 2 = 1 UNION ALL SELECT * FROM n)) WHERE proxy IN (SELECT proxy FROM m) GROUP BY ALL),
  tot AS (SELECT proxy, CAST(sum(k) AS BIGINT) AS n_literal, min(doc_id) AS first_doc FROM lit GROUP BY proxy)
  SELECT need.c, m.proxy, need.n, CASE WHEN m.proxy IS NULL THEN 'missing' WHEN n_literal > 0 THEN 'conflict' ELSE 'ok' END AS state, coalesce(n_literal, 0) AS n_literal, first_doc
  FROM need LEFT JOIN m USING (c) LEFT JOIN tot ON tot.proxy = m.proxy""")
def proxy_preflight(s, d):
    t = load(s, d, "documents").select("doc_id", "text")
    m = s.createDataFrame([("é", "Q"), ("ü", "e"), ("ñ", "~")], "c string, proxy string")
    out = charset.preflight(t.where("doc_id % 2 = 1"), t.where("doc_id % 2 = 0"), "doc_id", "text", m, "ascii")
    return out.select("c", "proxy", "n", "state", "n_literal", F.get("places", F.lit(0)).alias("first_doc"))


@query("""WITH e AS (SELECT user_id, event_type, CASE event_id % 3 WHEN 0 THEN 932 WHEN 1 THEN 0 END AS page, event_id FROM events),
  k AS (SELECT user_id, CASE event_type WHEN 'click' THEN 'convert' WHEN 'purchase' THEN CASE WHEN event_id % 4 = 0 THEN 'branch' ELSE 'convert' END WHEN 'signup' THEN CASE WHEN event_id % 5 = 0 THEN 'table' ELSE 'none' END
          ELSE CASE WHEN event_id % 9 = 0 THEN 'packed' ELSE 'none' END END AS kind, page FROM e),
  g AS (SELECT user_id, count(*) FILTER (kind = 'convert' AND page = 0) AS n_system, count(*) FILTER (kind = 'convert' AND page = 932) AS n_fixed, count(*) FILTER (kind = 'branch') AS n_branches,
          count(*) FILTER (kind = 'table') AS t, count(*) FILTER (kind = 'packed') AS p FROM k GROUP BY user_id),
  v AS (SELECT *, CASE WHEN p > 0 THEN 'undetermined' WHEN n_system + n_branches > 0 AND n_fixed + t > 0 THEN 'mixed' WHEN n_system + n_branches > 0 THEN 'acp-following' WHEN n_fixed + t > 0 THEN 'fixed-cp932' ELSE 'undetermined' END AS verdict FROM g)
  SELECT user_id, n_system, n_fixed, n_branches, verdict, CASE verdict WHEN 'acp-following' THEN CASE WHEN n_branches > 0 THEN 'strong' ELSE 'weak' END
    WHEN 'fixed-cp932' THEN CASE WHEN n_fixed >= 2 OR t > 0 THEN 'strong' ELSE 'weak' END END AS confidence FROM v""")
def page_verdict(s, d):
    n, e = F.col("event_id"), F.col("event_type")
    kind = F.when(e == "click", "convert").when(e == "purchase", F.when(n % 4 == 0, "branch").otherwise("convert")).when(e == "signup", F.when(n % 5 == 0, "table").otherwise("none")).otherwise(F.when(n % 9 == 0, "packed").otherwise("none"))
    sites = load(s, d, "events").select("user_id", kind.alias("kind"), F.when(n % 3 == 0, 932).when(n % 3 == 1, 0).alias("page"))
    return charset.page_verdict(sites, "user_id")


@query("""WITH n AS (SELECT DISTINCT p_name AS name FROM part UNION SELECT DISTINCT upper(p_name) FROM part WHERE p_size < 5 UNION SELECT DISTINCT substr(p_name, 1, 3) || '*' FROM part),
  h AS (SELECT CASE WHEN ends_with(name, '*') THEN md5(substr(lower(name), 1, 3)) ELSE md5(lower(name)) END AS k, name FROM n),
  g AS (SELECT k, list(DISTINCT name ORDER BY name) AS v, count(DISTINCT lower(name)) AS c FROM h GROUP BY k)
  SELECT p_partkey, CASE WHEN c = 1 THEN v[1] END AS resolved, CASE WHEN c > 1 THEN array_to_string(v, ',') END AS ambiguous
  FROM (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN md5(lower(p_name)) WHEN 1 THEN md5(substr(lower(p_name), 1, 3)) ELSE 'none' END AS k FROM part) LEFT JOIN g USING (k)""")
def hash_names(s, d):
    p = load(s, d, "part")
    names = p.select(F.col("p_name").alias("name")).unionByName(p.where("p_size < 5").select(F.upper("p_name").alias("name"))).unionByName(p.select(F.concat(F.substring("p_name", 1, 3), F.lit("*")).alias("name")))
    low = F.lower("name")
    hashed = F.md5(F.when(F.endswith("name", F.lit("*")), F.substring(low, 1, 3)).otherwise(low))
    k = F.col("p_partkey") % 3
    entries = p.select("p_partkey", F.when(k == 0, F.md5(F.lower("p_name"))).when(k == 1, F.md5(F.substring(F.lower("p_name"), 1, 3))).otherwise(F.lit("none")).alias("k"))
    return resolve.by_hash(entries, names, "k", "name", hashed).select("p_partkey", "resolved", F.array_join("ambiguous", ",").alias("ambiguous"))


@query("""SELECT o_custkey % 10 AS file, o_orderkey % 4 AS file_id, o_custkey AS path_id, CASE o_orderkey % 4 WHEN 0 THEN o_custkey % 10 WHEN 1 THEN (o_custkey + 1) % 10 WHEN 2 THEN (o_custkey + 2) % 10 END AS target,
    c_name AS name, CASE WHEN o_orderkey % 4 = 3 THEN 'no external' WHEN c_name IS NULL THEN 'no object' ELSE 'found' END AS state
  FROM orders LEFT JOIN customer ON c_custkey = o_custkey AND c_custkey % 5 = CASE o_orderkey % 4 WHEN 0 THEN o_custkey % 10 WHEN 1 THEN (o_custkey + 1) % 10 WHEN 2 THEN (o_custkey + 2) % 10 END""")
def two_hop_externals(s, d):
    o = load(s, d, "orders").select((F.col("o_custkey") % 10).alias("file"), (F.col("o_orderkey") % 4).alias("file_id"), F.col("o_custkey").alias("path_id"))
    e = s.range(10).select(F.col("id").alias("file"), F.explode(F.array(F.lit(1), F.lit(2)).cast("array<bigint>")).alias("file_id")).withColumn("target", (F.col("file") + F.col("file_id")) % 10)
    c = load(s, d, "customer").select((F.col("c_custkey") % 5).alias("file"), F.col("c_custkey").alias("path_id"), F.col("c_name").alias("name"))
    return resolve.two_hops(o, e, c)


@query("""WITH d AS (SELECT doc_id, 'n' || doc_id AS n, md5(text) AS h FROM documents),
  p AS (SELECT n, h FROM d WHERE doc_id % 2 = 0), l AS (SELECT CASE WHEN doc_id % 30 = 0 THEN upper(n) ELSE n END AS n, h FROM d WHERE doc_id % 3 = 0), s AS (SELECT n, CASE WHEN doc_id % 45 = 0 THEN 'x' ELSE h END AS h FROM d WHERE doc_id % 5 = 0),
  j AS (SELECT d.doc_id, p.n AS pn, l.n AS ln, s.n AS sn, p.h AS ph, l.h AS lh, s.h AS sh FROM d LEFT JOIN p ON p.n = d.n LEFT JOIN l ON lower(l.n) = d.n LEFT JOIN s ON s.n = d.n),
  st AS (SELECT *, CASE WHEN pn <> ln THEN 'case' WHEN ln IS NOT NULL AND sn IS NOT NULL AND lh <> sh THEN 'stale' WHEN pn IS NOT NULL AND ln IS NULL AND sn IS NOT NULL THEN 'both'
      WHEN pn IS NOT NULL AND ln IS NOT NULL THEN 'override' WHEN ln IS NOT NULL THEN 'loose' WHEN pn IS NOT NULL THEN 'packed' ELSE 'source only' END AS state FROM j WHERE coalesce(pn, ln, sn) IS NOT NULL)
  SELECT coalesce(ln, pn, sn) AS name, state, CASE WHEN state NOT IN ('case', 'stale', 'both') THEN coalesce(lh, ph, sh) END AS digest FROM st""")
def effective_scripts(s, d):
    k = load(s, d, "documents").select("doc_id", F.concat(F.lit("n"), F.col("doc_id").cast("string")).alias("name"), F.md5("text").alias("digest"))
    loose = k.where("doc_id % 3 = 0").withColumn("name", F.when(F.col("doc_id") % 30 == 0, F.upper("name")).otherwise(F.col("name")))
    sources = k.where("doc_id % 5 = 0").withColumn("digest", F.when(F.col("doc_id") % 45 == 0, "x").otherwise(F.col("digest")))
    return overlay.effective(k.where("doc_id % 2 = 0"), loose, sources, "name", "digest")


def _codec(name):
    def run(s, d):
        k = load(s, d, "conversations").select("conv_id", "turn", F.octet_length("text").alias("n"), codecs.encode(F.encode("text", "UTF-8"), name).alias("z"))
        whole, short = codecs.decode_sized(F.col("z"), name, F.col("n")), codecs.decode_sized(F.col("z"), name, F.col("n") - 1)
        return k.select("conv_id", "turn", F.sha2(whole, 256).alias("sha256"), short.isNotNull().alias("beyond"))

    run.__name__ = f"codec_{name}"
    return query("SELECT conv_id, turn, sha256(text) AS sha256, false AS beyond FROM conversations")(run)


for _name in ("lz4", "lzma", "lzss", "huffman", "pairs"):
    _codec(_name)


@query("""SELECT conv_id, turn, CASE turn % 6 WHEN 1 THEN 'name' WHEN 2 THEN 'message' WHEN 3 THEN 'key' WHEN 4 THEN 'malformed' END AS reason FROM conversations""")
def row_shape(s, d):
    k, m = F.col("turn") % 6, F.to_json(F.struct(F.col("text").alias("message")))
    tail = F.substring(m, 2, 1 << 30)
    v = F.when(k == 1, F.concat(F.lit('{"name":"a","names":["b"],'), tail)).when(k == 2, F.lit('{"message":7}')).when(k == 3, F.concat(F.lit('{"pre_src":"",'), tail)).when(k == 4, F.lit("{")).when(k == 5, F.concat(F.lit('{"names":["b"],'), tail)).otherwise(m)
    return load(s, d, "conversations").select("conv_id", "turn", contract.row_shape(v).alias("reason"))


@query("SELECT p_partkey, p_name, p_brand, p_size FROM part WHERE p_size > 10")
def catalog_details(s, d):
    p = load(s, d, "part").select("p_partkey", "p_name", "p_brand", "p_size").where("p_size > 10")
    return catalog.view(p, ["p_partkey", "p_name"], True).select("p_partkey", "p_name", "details.p_brand", "details.p_size")


@query("SELECT count(*) AS n_rows FROM events")
def stream_progress(s, d):
    out = windows.progress(windows.events(s, f"{d}/events.parquet"))
    return out.agg(F.sum("n_rows").alias("n_rows"))


@query("""SELECT event_type, round(quantile_cont(value, 0.5), 4) AS median, round(quantile_cont(value, 0.9), 4) AS p90, count(DISTINCT user_id) AS n_users FROM events GROUP BY 1""")
def rel_quantiles(s, d):
    g = load(s, d, "events").groupBy("event_type")
    return g.agg(F.round(F.percentile("value", 0.5), 4).alias("median"), F.round(F.percentile("value", 0.9), 4).alias("p90"), F.count_distinct("user_id").alias("n_users"))


@F.pandas_udf(T.DoubleType())
def weighted_mean(value: pd.Series, weight: pd.Series) -> float:
    """A grouped aggregate of one's own, over Arrow batches."""
    total = weight.sum()
    return float((value * weight).sum() / total) if total else 0.0


@query("SELECT l_returnflag, l_linenumber, round(sum(l_discount * l_quantity) / sum(l_quantity), 6) AS mean FROM lineitem GROUP BY 1, 2")
def rel_udaf(s, d):
    return load(s, d, "lineitem").groupBy("l_returnflag", "l_linenumber").agg(F.round(weighted_mean("l_discount", "l_quantity"), 6).alias("mean"))


@query("SELECT event_type, true AS near FROM events GROUP BY 1")
def rel_approximate(s, d):
    """Approximate against exact: distinct users within 5 standard errors, median within its rank error."""
    e = load(s, d, "events")
    g = e.groupBy("event_type").agg(F.approx_count_distinct("user_id", 0.02).alias("a"), F.count_distinct("user_id").alias("n"), F.percentile_approx("value", 0.5, 10_000).alias("m"), F.percentile("value", [0.45, 0.55]).alias("r"))
    return g.select("event_type", ((F.abs(F.col("a") - F.col("n")) <= 0.1 * F.col("n") + 1) & F.col("m").between(F.col("r")[0], F.col("r")[1])).alias("near"))
