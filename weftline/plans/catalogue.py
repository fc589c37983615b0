"""Registered queries: one per operator, over the standard tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import charset, codecs
from ..functions import text as tx
from ..operators import binary, catalog, contract, edits, overlay, paths, resolve, spans, stats
from ..sources import containers, publish, scan, structured
from ..sources.tables import load
from ..streaming import windows
from . import delivery

TAG = r"<[^>]*>"


def _lines(s, d):
    return spans.split_lines(load(s, d, "documents"), "doc_id", "text")


def line_kind(s: SparkSession, d: str) -> DataFrame:
    return _lines(s, d).select("doc_id", "line", spans.line_kind(F.col("body")).alias("kind"))


def content_kind(s, d):
    return spans.content_kind(_lines(s, d), "doc_id", 20, 0.6)


def first_lines(s, d):
    return spans.first_lines(_lines(s, d), 3)


def paragraphs(s, d):
    return spans.paragraphs(_lines(s, d), "doc_id")


def tag_inventory(s, d):
    return spans.tokens(load(s, d, "pages"), ["page_id"], "html", TAG)


def section_mask(s, d):
    lines = spans.split_lines(load(s, d, "pages").withColumn("html", F.regexp_replace("html", ">", ">\n")), "page_id", "html")
    out = spans.section_mask(lines, "page_id", F.col("body").contains("<nav"), F.col("body").contains("</nav"))
    return out.select("page_id", "line", "depth", "inside", "nested")


def speaker_ffill(s, d):
    rows = load(s, d, "conversations")
    name = F.when(F.col("role") != "assistant", F.col("role"))
    return spans.forward_fill(rows, ["conv_id"], "turn", name, F.col("turn") % 4 == 0, "speaker").select("conv_id", "turn", "speaker")


def one_shot_speaker(s, d):
    rows = load(s, d, "conversations")
    out = spans.one_shot(rows, ["conv_id"], "turn", F.when(F.col("role") != "assistant", F.col("role")), F.col("role") == "assistant")
    return out.select("conv_id", "turn", "speaker")


def overlay_last_wins(s, d):
    out = overlay.last_wins(load(s, d, "events"), ["user_id", "event_type"], [F.col("ts"), F.col("event_id")])
    return out.select("user_id", "event_type", "event_id", "value", F.col("n_losers").cast("long"))


def override_chain(s, d):
    out = overlay.override_chain(load(s, d, "events"), ["user_id", "event_type"], "event_id", F.col("event_id"))
    return out.select("user_id", "event_type", "winner", F.array_join(F.transform("losers", lambda x: x.cast("string")), ",").alias("losers"))


def loose_or_packed(s, d):
    docs = load(s, d, "documents").select(F.col("doc_id").alias("k"), F.md5("text").alias("digest"))
    loose = docs.where("k % 3 <> 0")
    packed = docs.where("k % 2 = 0 or k % 3 = 0").withColumn("digest", F.when(F.col("k") % 4 == 0, F.lit("other")).otherwise(F.col("digest")))
    return overlay.loose_or_packed(loose, packed, "k", "digest")


def first_seen(s, d):
    return overlay.first_seen(load(s, d, "events"), ["user_id"], "event_id")


def missing_rows(s, d):
    return overlay.missing(load(s, d, "documents"), load(s, d, "labels"), "doc_id").select("doc_id")


def present_rows(s, d):
    return overlay.present(load(s, d, "documents"), load(s, d, "labels").where("quality = 1"), "doc_id").select("doc_id", "lang")


def key_set_equality(s, d):
    return overlay.key_sets(load(s, d, "orders"), load(s, d, "lineitem"), "o_orderkey", "l_orderkey")


def dict_ambiguity(s, d):
    k = load(s, d, "documents").select(F.substring("text", 1, 12).alias("alias"), "source")
    out = resolve.unique_or_ambiguous(k, "alias", "source")
    return out.withColumn("ambiguous", F.array_join("ambiguous", ","))


def default_name(s, d):
    names = load(s, d, "nation").select(F.col("n_nationkey").cast("string").alias("key"), F.col("n_name").alias("name")).where("n_nationkey % 2 = 0")
    rows = load(s, d, "customer").select("c_custkey", F.col("c_nationkey").cast("string").alias("key"))
    return resolve.with_default(rows, names, "key", "name", "shown").select("c_custkey", "shown")


def positional_join(s, d):
    nations = resolve.numbered(load(s, d, "nation").select("n_name"), [F.col("n_name")])
    refs = load(s, d, "events").select("event_id", (F.col("user_id") % 30).alias("ref"))
    return resolve.by_position(refs, nations, "ref").select("event_id", "ref", "n_name")


def two_hop_fk(s, d):
    j = load(s, d, "lineitem").select("l_orderkey", "l_extendedprice").join(load(s, d, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    g = j.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.sum("l_extendedprice").alias("v"))
    c = load(s, d, "customer").select("c_custkey", "c_nationkey")
    g = g.join(c, F.col("o_custkey") == F.col("c_custkey")).join(load(s, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return g.groupBy("n_name").agg(F.sum("n").alias("n_lines"), F.round(F.sum("v"), 2).alias("revenue"))


def range_tag(s, d):
    ranges = s.createDataFrame([("low", 0.0, 1e5), ("mid", 1e5, 3e5)], "tag string, lo double, hi double")
    return resolve.in_ranges(load(s, d, "orders"), F.col("o_totalprice"), ranges, "lo", "hi").groupBy("tag").agg(F.count(F.lit(1)).alias("n"))


def range_join_binned(s, d):
    p = load(s, d, "part").select("p_partkey", (F.col("p_partkey") * 7).alias("lo"), (F.col("p_partkey") * 7 + F.col("p_size")).alias("hi"))
    e = load(s, d, "events").select("event_id", F.col("event_id").alias("pt"))
    return resolve.in_binned_ranges(e, "pt", p, "lo", "hi", 64).select("event_id", "p_partkey")


def char_entropy(s, d):
    return stats.char_entropy(load(s, d, "documents"), "doc_id", "text").withColumn("entropy", F.round("entropy", 3))


def byte_entropy(s, d):
    return load(s, d, "conversations").select("conv_id", "turn", F.round(stats.byte_entropy(F.encode("text", "UTF-8")), 3).alias("entropy"))


def merge_hits(s, d):
    out = stats.merge_hits(load(s, d, "events"), ["user_id", "event_type"], "event_id")
    return out.withColumn("others", F.array_join(F.transform("others", lambda x: x.cast("string")), ","))


def _strength():
    return F.when(F.col("event_type") == "error", 0).when(F.col("event_type") == "purchase", 1).when(F.col("event_type") == "signup", 2).otherwise(3)


def evidence_topk(s, d):
    return stats.top_with_floor(load(s, d, "events"), "user_id", _strength(), "event_id", 2).select("user_id", "event_id", "event_type", "place")


def ordered_counts(s, d):
    return stats.ordered_counts(load(s, d, "events"), "event_type", "event_id")


def largest_per_group(s, d):
    return stats.largest(load(s, d, "documents"), "source", F.col("n_chars"), "doc_id", 5).select("source", "doc_id", "n_chars", "place")


def refcount(s, d):
    return stats.refcount(load(s, d, "orders"), load(s, d, "customer"), "o_custkey", "c_custkey")


def series_extend(s, d):
    return stats.series(load(s, d, "supplier"), "s_name", r"^(.*?)(\d+)$", 64)


def range_merge(s, d):
    return stats.merge_ranges(load(s, d, "events"), "user_id", "event_id")


def cumulative_budget(s, d):
    out = stats.within_budget(load(s, d, "documents"), "source", "doc_id", F.col("n_chars"), 50_000)
    return out.select("source", "doc_id", F.col("running").cast("long"), "fits")


def dup_groups(s, d):
    return stats.duplicate_groups(load(s, d, "documents"), "doc_id", "text")


def pooled_values(s, d):
    return stats.pooled(load(s, d, "documents"), F.to_json(F.struct("source", "lang")), 10)


def conditional_counts(s, d):
    return load(s, d, "events").groupBy("user_id").agg(F.count_if(F.col("event_type") == "error").alias("n_errors"), F.count_if(F.col("value") > 50).alias("n_large"), F.count_distinct("event_type").alias("n_types"))


def row_export(s, d):
    return contract.export_rows(load(s, d, "conversations"), "conv_id", "turn", F.when(F.col("role") == "system", "").otherwise(F.col("role")), F.col("text"))


def manifest(s, d):
    rows = contract.export_rows(load(s, d, "conversations"), "conv_id", "turn", F.col("role"), F.col("text"))
    return contract.manifest(rows, "conv_id", "turn", r"[.,]").withColumn("n_tokens", F.col("n_tokens").cast("long"))


def validate_rows(s, d):
    a = load(s, d, "conversations").select("conv_id", "turn", F.col("role").alias("name"), F.col("text").alias("message"))
    b = a.where("(conv_id + turn) % 11 <> 0").withColumn("message", F.when(F.col("turn") % 5 == 1, F.replace("message", F.lit("."), F.lit(""))).when(F.col("turn") % 7 == 2, F.lit("")).otherwise(F.upper("message")))
    b = b.withColumn("name", F.when(F.col("conv_id") % 13 == 0, F.lit(None)).otherwise(F.col("name")))
    return contract.validate(a, b, ["conv_id", "turn"], r"[.]")


def status_gate(s, d):
    r = load(s, d, "events").select("event_id", "user_id", F.when((F.col("event_type") == "error") & (F.col("value") > 60), "blocked").otherwise("success").alias("status"))
    return contract.gate(r, "user_id")


def rows_equal(s, d):
    a = load(s, d, "labels").select("doc_id", "quality")
    b = a.where("doc_id % 10 <> 0").unionByName(a.where("doc_id % 15 = 0"))
    return contract.same_rows(a, b)


def token_multiset(s, d):
    k = load(s, d, "pages").select("page_id", "html", F.replace("html", F.lit("<br>"), F.lit("")).alias("after"))
    return k.select("page_id", tx.count_token(F.col("html"), "<p>").alias("n_before"), tx.count_token(F.col("after"), "<br>").alias("n_after"), tx.same_tokens(F.col("html"), F.col("after"), TAG).alias("same"))


def _line_edits(s, d):
    """Each line of the documents with its place, and an edit of every third."""
    w = Window.partitionBy("doc_id").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    k = _lines(s, d).withColumn("n", F.char_length("body").cast("long"))
    return k.withColumn("start", F.coalesce(F.sum(F.col("n") + 1).over(w), F.lit(0)).cast("long")).withColumn("end", F.col("start") + F.col("n"))


def offset_map(s, d):
    k = _line_edits(s, d)
    delta = F.when(F.col("line") % 3 == 1, 5 - F.col("n")).otherwise(F.lit(0))
    return edits.relocate(k, "doc_id", "line", delta).select("doc_id", "line", "start", "shift", "new_start")


def _edits(s, d):
    return _line_edits(s, d).where("line % 3 = 1 and n > 0").select("doc_id", "start", "end", F.lit("EDIT!").alias("replacement"))


def splice_text(s, d):
    out = edits.splice(load(s, d, "documents").select("doc_id", "text"), _edits(s, d), "doc_id", "text")
    return out.select("doc_id", F.md5("spliced").alias("digest"), F.char_length("spliced").cast("long").alias("n"))


def map_addresses(s, d):
    a = load(s, d, "documents").select("doc_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_chars"), F.lit(97).cast("long"))).alias("address"))
    return edits.map_addresses(a, _edits(s, d), "doc_id", "address").select("doc_id", "address", "inside", "mapped")


def overlap_check(s, d):
    e = load(s, d, "events").select("user_id", F.col("event_id").alias("start"), (F.col("event_id") + F.floor(F.col("value"))).alias("end"))
    return edits.overlaps(e, "user_id")


def consistent_rename(s, d):
    k = load(s, d, "conversations").select("role", F.when(F.col("role") == "user", F.concat("role", F.lit("_"), (F.col("conv_id") % 2).cast("string"))).otherwise(F.upper("role")).alias("new_name"))
    return edits.consistent_rename(k, "role", "new_name")


def fixed_slot(s, d):
    k = load(s, d, "part").select("p_partkey", "p_name")
    return edits.fixed_slot(k, F.col("p_name"), F.lit(11)).select("p_partkey", "fits", "slot")


def pool_offsets(s, d):
    return edits.pool_offsets(load(s, d, "conversations"), "conv_id", "turn", F.col("text")).select("conv_id", "turn", "offset")


def clone_references(s, d):
    k = load(s, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    return edits.clone_changed(k, "o_custkey", "o_orderkey", "o_custkey", F.col("o_orderstatus") == "F", F.lit(10_000)).select("o_orderkey", "new_index")


def paged_catalog(s, d):
    p = load(s, d, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size")
    return catalog.search(p, [F.lower("p_type") == "economy", catalog.contains_text(p, "RING")], ["p_partkey"], 3, 10)


def name_pattern(s, d):
    return load(s, d, "part").where(catalog.glob(F.col("p_name"), "R?d*")).select("p_partkey", "p_name")


def disambiguate(s, d):
    k = load(s, d, "part").select("p_partkey", F.when(F.col("p_partkey") % 7 == 0, F.concat("p_name", F.lit("_"), (F.col("p_partkey") % 3 + 1).cast("string"))).otherwise(F.col("p_name")).alias("p_name"))
    return catalog.disambiguate(k, "p_name", "p_partkey").select("p_partkey", "slot_name")


def expand_refs(s, d):
    pool = resolve.numbered(load(s, d, "part").select(F.col("p_type").alias("value")).distinct(), [F.col("value")])
    e = load(s, d, "part").select("p_partkey", (F.col("p_size") % 9).cast("long").alias("ref"))
    return catalog.expand_refs(e, pool, "ref", "index").select("p_partkey", "ref", "value", F.col("value").isNull().alias("bad"))


def json_leaf(s, d):
    e = load(s, d, "events")
    return e.select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


def json_canonical(s, d):
    return load(s, d, "nation").select("n_nationkey", tx.canonical_json(n_name=F.col("n_name"), n_regionkey=F.col("n_regionkey")).alias("json"))


def header_cells(s, d):
    lines = load(s, d, "conversations").select("conv_id", "turn", F.split("text", " ").alias("cells"))
    head = F.array(F.lit("a"), F.lit("b"), F.lit("c"))
    return lines.select("conv_id", "turn", tx.cell(head, F.col("cells"), "b").alias("b"), tx.cell(head, F.col("cells"), "z").alias("z"))


def preview(s, d):
    return load(s, d, "documents").select("doc_id", tx.preview(F.col("text"), 40).alias("preview"))


def name_split(s, d):
    k = load(s, d, "conversations").select("conv_id", "turn", F.concat(F.lit("【"), "role", F.lit("】"), "text").alias("line"))
    return k.select("conv_id", "turn", *tx.split_name(F.col("line")))


def ruby_strip(s, d):
    k = load(s, d, "documents").select("doc_id", F.regexp_replace("text", r"(\w+) (\w+)", "[$1/$2]").alias("t"))
    return k.select("doc_id", F.md5(tx.strip_ruby(F.col("t"))).alias("digest"), tx.ruby_count(F.col("t")).alias("n_ruby"))


def letter_ranges(s, d):
    return load(s, d, "documents").select("doc_id", tx.count_between(F.col("text"), "à", "ÿ").alias("n_accented"), tx.count_between(F.col("text"), "一", "鿿").alias("n_han"))


def charset_plan(s, d):
    """Characters beyond ASCII, how often and where they occur first."""
    k = load(s, d, "documents").select("doc_id", F.explode(F.split("text", "")).alias("c")).where(F.ascii("c") > 127)
    g = k.groupBy("c").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_doc"))
    return g.withColumn("proxy", F.lit(0xF8FF).cast("long") - F.row_number().over(Window.orderBy("c")) + 1)


def variants(s, d):
    k = load(s, d, "part").select("p_partkey", F.replace("p_name", F.lit(" "), F.lit("_")).alias("stem"))
    return tx.name_variants(k, "stem", [".txt", ".bin", ".dat"])


def quoted_tokens(s, d):
    return load(s, d, "pages").select("page_id", F.explode(F.array_distinct(F.regexp_extract_all("html", F.lit(r'href="([^"]*)"'), F.lit(1)))).alias("token"))


def utf16_units(s, d):
    return load(s, d, "documents").select("doc_id", tx.utf16_units(F.col("text")).alias("n_units"))


def break_policy(s, d):
    k = load(s, d, "conversations")
    tok = lambda c: F.regexp_extract_all(c, F.lit(r"\n|[^\n]+"), F.lit(0))
    after = F.when(F.col("turn") % 3 == 0, F.replace("text", F.lit("\n\n"), F.lit("\n"))).when(F.col("turn") % 3 == 1, F.concat("text", F.lit("\n"))).otherwise(F.upper("text"))
    return k.select("conv_id", "turn", tx.only_breaks_dropped(tok(F.col("text")), tok(after), "\n").alias("allowed"))


def _members(s, d):
    k = load(s, d, "documents").select(F.col("source").alias("container"), F.col("doc_id").alias("ordinal"), F.concat(F.lit("dir/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("name"), F.encode("text", "UTF-8").alias("payload"))
    return k


def _round_trip(s, d, fmt):
    out = containers.scan(containers.build(_members(s, d), fmt), fmt, payload=True)
    return out.select("container", "name", "size", F.sha2("payload", 256).alias("sha256"), "status")


def container_flat(s, d):
    return _round_trip(s, d, "flat")


def container_chunked(s, d):
    return _round_trip(s, d, "chunked")


def container_tree(s, d):
    return _round_trip(s, d, "tree")


def container_records(s, d):
    rows = load(s, d, "conversations").select(F.col("conv_id").cast("string").alias("container"), F.col("turn").alias("ordinal"), F.lit("").alias("name"), F.encode("text", "UTF-8").alias("payload"))
    out = containers.scan(containers.build(rows, "records"), "records", payload=True)
    return out.select("container", F.col("name").cast("long").alias("k"), F.sha2("payload", 256).alias("sha256"))


def container_index(s, d):
    """Index scan with a member pattern; no payload is read."""
    out = containers.scan(containers.build(_members(s, d), "flat"), "flat", "dir/*7.txt")
    return out.select("container", "name", "size")


def container_replace(s, d):
    m = containers.scan(containers.build(_members(s, d), "chunked"), "chunked", payload=True).select("container", "ordinal", "name", "payload")
    new = m.where("name like '%3.txt'").select("container", "name", F.encode(F.lit("replaced"), "UTF-8").alias("payload"))
    out = containers.scan(containers.build(containers.replace_members(m, new), "chunked"), "chunked", payload=True)
    return out.select("container", "name", F.sha2("payload", 256).alias("sha256"))


def incremental_patch(s, d):
    old = _members(s, d)
    new = old.withColumn("payload", F.when(F.col("ordinal") % 9 == 0, F.encode(F.lit("x"), "UTF-8")).otherwise(F.col("payload")))
    new = new.withColumn("name", F.when(F.col("ordinal") % 4 == 1, F.concat(F.lit("alt/"), (F.col("ordinal") - 1).cast("string"), F.lit(".txt"))).otherwise(F.col("name")))
    out = containers.flat_patch(containers.changed_members(new, old), new)
    return out.select("container", "name", F.sha2("payload", 256).alias("sha256"), "conflict", "packed_as")


def codec_roundtrip(s, d):
    b = F.encode("text", "UTF-8")
    k = load(s, d, "documents").select("doc_id", codecs.deflate(b).alias("z"), F.octet_length(b).alias("n"))
    return k.select("doc_id", F.sha2(codecs.decode_sized(F.col("z"), "zlib", F.col("n")), 256).alias("sha256"))


def codec_bounded(s, d):
    k = load(s, d, "documents").select("doc_id", codecs.deflate(F.encode("text", "UTF-8")).alias("z"))
    return k.select("doc_id", codecs.decode(F.col("z"), "zlib", 2000).isNotNull().alias("fits"))


def keyed_bytes(s, d):
    """A keyed transform applied twice is the input."""
    twice = codecs.bytes_udf(lambda b: codecs.xor_repeat(codecs.xor_lcg(codecs.xor_lcg(codecs.xor_repeat(b, b"key"), 7), 7), b"key"))
    k = load(s, d, "conversations")
    return k.select("conv_id", "turn", F.sha2(twice(F.encode("text", "UTF-8")), 256).alias("sha256"))


def aes_roundtrip(s, d):
    key, iv = F.lit(bytes(range(16))), F.lit(bytes(range(16, 32)))
    k = load(s, d, "conversations").select("conv_id", "turn", codecs.aes_cbc_encrypt(F.encode("text", "UTF-8"), key, iv).alias("c"))
    return k.select("conv_id", "turn", F.sha2(codecs.aes_cbc_decrypt(F.col("c"), key, iv), 256).alias("sha256"))


def charset_strict(s, d):
    k = load(s, d, "documents")
    return k.select("doc_id", charset.encode_strict(F.col("text"), "ascii").isNotNull().alias("ascii"), charset.decode_strict(charset.encode_strict(F.col("text"), "utf-16-le"), "utf-16-le").eqNullSafe(F.col("text")).alias("same"))


def charset_lacking(s, d):
    return charset.substitution_plan(load(s, d, "documents"), "text", "ascii").select("c", "n", F.hex(F.encode("proxy", "UTF-16BE")).alias("proxy"))


def encoding_guess(s, d):
    k = load(s, d, "conversations")
    b = F.when(F.col("turn") % 2 == 0, F.encode("text", "UTF-8")).otherwise(F.concat(F.unhex(F.lit("FFFE")), F.encode("text", "UTF-16LE")))
    return k.select("conv_id", "turn", charset.guess(b).alias("charset"))


def publish_roundtrip(s, d):
    k = load(s, d, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"))
    path = windows.shared(s, "publish")
    if not publish.holds(publish.publish(k, path), path, k.schema, s):
        raise RuntimeError("read-back differs")
    return s.read.parquet(path)


def stream_tumbling(s, d):
    e = windows.events(s, f"{d}/events.parquet")
    return windows.drain(windows.tumbling(e, "1 hour", "10 minutes", "event_type"), "complete")


def stream_sliding(s, d):
    e = windows.events(s, f"{d}/events.parquet")
    return windows.drain(windows.sliding(e, "2 hours", "1 hour", "10 minutes", "event_type"), "complete")


def stream_sessions(s, d):
    e = windows.events(s, f"{d}/events.parquet")
    return windows.drain(windows.sessions(e, "30 minutes", "10 minutes", "user_id"), "complete")


def _files(s, d):
    """Documents as files: a path and the first bytes."""
    ext = F.element_at(F.array(F.lit(".ks"), F.lit(".txt"), F.lit(".TXT"), F.lit(".bin")), (F.col("doc_id") % 4 + 1).cast("int"))
    path = F.concat("source", F.lit("/"), F.when(F.col("doc_id") % 10 == 0, "backup/").otherwise(""), F.lit("n"), F.col("doc_id").cast("string"), ext)
    return load(s, d, "documents").select("doc_id", path.alias("path"), F.col("n_chars").alias("size"), F.encode(F.substring("text", 1, 64), "UTF-8").alias("head"))


def _hits(s, d):
    return scan.evidence(_files(s, d), [("the", b"The"), ("er", b"Er"), ("any-e", b"E")], [("script", ".ks"), ("plain", ".txt"), ("script", ".txt")], [("first", "n1.txt"), ("script", "n4.ks")])


def evidence_scan(s, d):
    return _hits(s, d)


def evidence_candidates(s, d):
    return scan.candidates(_hits(s, d), 3).withColumn("shown", F.array_join("shown", ","))


def scan_limits(s, d):
    return scan.limited(_files(s, d), 300, 2).select("path", F.col("depth").cast("long"), "kept", "reason")


def derived_paths(s, d):
    return _files(s, d).select("path", scan.derived(F.col("path")).alias("derived"))


def volume_sets(s, d):
    t = load(s, d, "documents").select(F.concat("source", F.lit(".pak"), F.when(F.col("doc_id") % 50 < 20, "").otherwise(F.concat(F.lit("."), F.lpad((F.col("doc_id") % 50).cast("string"), 3, "0")))).alias("path")).distinct()
    return scan.volumes(t)


def paired_files(s, d):
    t = load(s, d, "documents").select(F.concat("source", F.lit("/"), (F.col("doc_id") % 7).cast("string"), F.when(F.col("doc_id") % 3 == 0, ".idx").otherwise(".dat")).alias("path")).distinct()
    return scan.paired(t, ".idx", ".dat")


def strict_json(s, d):
    e = load(s, d, "events")
    v = F.when(F.col("event_id") % 5 == 0, '{"k": 1, "k": 2}').when(F.col("event_id") % 7 == 0, '{"k": NaN}').when(F.col("event_id") % 11 == 0, F.expr("left(props, 4)")).otherwise(F.col("props"))
    return e.select("event_id", structured.strict_json(v).alias("reason"))


def tree_nodes(s, d):
    k = load(s, d, "conversations").select("conv_id", "turn", "role").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role"))).alias("a"))
    k = k.select("conv_id", F.to_json(F.struct(F.lit("c").alias("t"), F.col("a"))).alias("j"))
    out = structured.tree_nodes(k, "conv_id", "j")
    return out.select("conv_id", "pos", "parent", F.array_join("path", "/").alias("path"), "tag", "value")


def event_leaves(s, d):
    c = load(s, d, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", F.when(F.col("role") == "user", 401).otherwise(102).alias("code"), F.array("role").alias("parameters")))).alias("l"))
    k = c.select("conv_id", F.to_json(F.struct(F.array(F.struct(F.transform("l", lambda x: F.struct(x.code.alias("code"), x.parameters.alias("parameters"))).alias("list"))).alias("events"))).alias("j"))
    return structured.selected_leaves(k, "conv_id", "j", [401])


def delimited_rows(s, d):
    p = load(s, d, "part").withColumn("g", F.floor(F.col("p_partkey") / 50))
    p = p.withColumn("l", F.concat_ws(",", F.col("p_partkey").cast("string"), "p_name", F.when(F.col("p_partkey") % 9 == 0, F.lit("x"))))
    g = p.groupBy("g").agg(F.sort_array(F.collect_list(F.struct("p_partkey", "l"))).alias("s"))
    k = g.select("g", F.concat(F.lit("id,Original text\n"), F.array_join(F.transform("s", lambda x: x.l), "\n")).alias("t"))
    return structured.delimited(k, "g", "t", ",", "Original text")


def xml_resources(s, d):
    n = load(s, d, "nation")
    k = n.groupBy("n_regionkey").agg(F.array_join(F.sort_array(F.collect_list(F.concat(F.lit('<Res id="'), F.col("n_nationkey").cast("string"), F.lit('">'), "n_name", F.lit("</Res>")))), "").alias("r"), F.array_join(F.transform(F.sort_array(F.collect_list("n_nationkey")), lambda x: F.concat(F.lit('<Log text="'), x.cast("string"), F.lit('" name="'), (x + 1).cast("string"), F.lit('"/>'))), "").alias("g"))
    x = k.select("n_regionkey", F.concat(F.lit("<Doc>"), "r", "g", F.lit('<Log text="999" name="0"/></Doc>')).alias("x"))
    return structured.text_resources(x, "n_regionkey", "x")


def grid_records(s, d):
    p = load(s, d, "part").withColumn("book", F.floor(F.col("p_partkey") / 100))
    cells = F.when(F.col("p_partkey") % 100 == 0, F.array(F.lit("Command"), F.lit("Arg1"), F.lit("Text"))).when(F.col("p_partkey") % 13 == 0, F.array(F.lit("//note"), F.lit(""), F.lit(""))).when(F.col("p_partkey") % 17 == 0, F.array(F.lit(""), F.lit(" "))).otherwise(F.array("p_type", F.lit("a"), "p_name"))
    return structured.grid_records(p.select("book", "p_partkey", cells.alias("cells")), "book", "p_partkey", "cells", ["ECONOMY"], ["STANDARD"])


def tag_lexer(s, d):
    t = structured.lex(load(s, d, "pages"), "page_id", "html")
    return t.groupBy("page_id").agg(F.count_if(F.col("kind") != "text").alias("n_tags"), F.max("end").alias("n_chars"), F.md5(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ordinal", "token"))), lambda x: x.token), "")).alias("digest"))


def tag_attributes(s, d):
    t = structured.lex(load(s, d, "pages"), "page_id", "html").where("token like '<a %'")
    return t.select("page_id", "ordinal", F.try_element_at(structured.attributes(F.col("token")), F.lit("href")).alias("href")).drop("ordinal").groupBy("page_id", "href").agg(F.count(F.lit(1)).alias("n"))


def handoff(s, d):
    """State of a job in one row a file: rows, edited rows, open items."""
    v = validate_rows(s, d)
    g = v.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(~F.col("valid")).alias("n_open"), F.min(F.when(~F.col("valid"), F.col("turn"))).alias("first_open"))
    return g.withColumn("state", F.when(F.col("n_open") == 0, "success").when(F.col("n_open") < F.col("n_rows"), "partial").otherwise("blocked"))


def path_check(s, d):
    k = load(s, d, "documents").select("doc_id", F.element_at(F.array(*[F.lit(x) for x in ("a\\b.ks", "../x", "/x", "C:/x", "a//b", "CON", "aux.txt", "x/a.", "x/b ", "ok/name.txt")]), (F.col("doc_id") % 10 + 1).cast("int")).alias("p"))
    return k.select("doc_id", paths.normal_path(F.col("p")).alias("r")).select("doc_id", "r.path", "r.reason")


def path_collisions(s, d):
    k = load(s, d, "documents").select(F.concat(F.when(F.col("doc_id") % 2 == 0, F.upper("source")).otherwise(F.col("source")), F.when(F.col("doc_id") % 25 == 0, "").otherwise(F.concat(F.lit("/"), (F.col("doc_id") % 40).cast("string")))).alias("p"))
    return paths.collisions(k, "p")


def pointer_repair(s, d):
    """Records of a u32 pointer to a text behind a 3-byte head that an edit widens."""
    b = load(s, d, "conversations").select(F.format_string("%d/%d", "conv_id", "turn").alias("k"), F.concat(F.unhex(F.lit("07000000")), F.encode(F.lit("abc"), "UTF-8"), F.encode("text", "UTF-8")).alias("content"))
    e = b.select("k", F.lit(4).cast("long").alias("start"), F.lit(7).cast("long").alias("end"), F.encode(F.lit("longer"), "UTF-8").alias("replacement"))
    out = binary.patch(b, e, b.select("k", F.lit(0).cast("long").alias("field")), "k", "content")
    return out.select("k", F.hex(F.substring("content", 1, 4)).alias("pointer"), F.sha2(F.substring("content", 11, 1 << 30), 256).alias("sha256"), "status")


# -- relational complement ---------------------------------------------------


def rel_pricing(s, d):
    k = load(s, d, "lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp"))
    disc = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return k.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(disc), 2).alias("sum_disc"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count(F.lit(1)).alias("n"))


def rel_cube(s, d):
    o = load(s, d, "orders")
    return o.cube("o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.grouping_id().cast("long").alias("gid"))


def rel_rollup(s, d):
    return load(s, d, "part").rollup("p_brand", "p_type").agg(F.count(F.lit(1)).alias("n"), F.max("p_size").alias("max_size"))


def rel_windows(s, d):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return load(s, d, "orders").select(
        "o_orderkey", F.row_number().over(w).cast("long").alias("rn"), F.lag("o_orderkey").over(w).alias("prev"),
        F.round(F.sum("o_totalprice").over(w.rowsBetween(Window.unboundedPreceding, 0)), 2).alias("running"), F.ntile(4).over(w).cast("long").alias("quart"),
    )


def rel_asof(s, d):
    """Last order of the same customer at or before each order's date plus 90 days."""
    o = load(s, d, "orders").select("o_custkey", "o_orderkey", F.col("o_orderdate").alias("ts"))
    left = o.select("o_custkey", F.col("o_orderkey").alias("lk"), (F.col("ts") + F.expr("interval 90 days")).alias("ts"), F.lit(None).cast("long").alias("rk"))
    right = o.select("o_custkey", F.lit(None).cast("long").alias("lk"), "ts", F.col("o_orderkey").alias("rk"))
    # one sort per customer instead of a join: right rows stand before left ones
    w = Window.partitionBy("o_custkey").orderBy("ts", F.col("rk").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    both = left.unionByName(right).withColumn("asof", F.last("rk", True).over(w))
    return both.where("lk is not null").select("lk", "asof")


def rel_sets(s, d):
    a = load(s, d, "customer").select(F.col("c_nationkey").alias("k"))
    b = load(s, d, "supplier").select(F.col("s_nationkey").alias("k"))
    only = a.distinct().exceptAll(b.distinct()).withColumn("side", F.lit("customer"))
    both = a.intersect(b).withColumn("side", F.lit("both"))
    return only.unionByName(both)


def rel_top_customers(s, d):
    o = load(s, d, "orders").groupBy("o_custkey").agg(F.round(F.sum("o_totalprice"), 2).alias("spent"))
    c = load(s, d, "customer").select("c_custkey", "c_name", "c_mktsegment")
    return o.join(c, F.col("o_custkey") == F.col("c_custkey")).orderBy(F.desc("spent"), "c_custkey").limit(20).select("c_custkey", "c_name", "c_mktsegment", "spent")


def rel_sessions(s, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    gap = F.coalesce(F.col("ts") - F.lag("ts").over(w) > F.expr("interval 30 minutes"), F.lit(True))
    e = load(s, d, "events").withColumn("s", F.sum(F.when(gap, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return e.groupBy("user_id", F.col("s").cast("long").alias("session")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("value"))


def rel_hourly(s, d):
    e = load(s, d, "events").groupBy(F.date_trunc("hour", "ts").alias("hour"), "event_type")
    return e.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 4).alias("mean"))


QUERIES = {f.__name__: f for f in [
    line_kind, content_kind, first_lines, paragraphs, tag_inventory, section_mask, speaker_ffill, one_shot_speaker, overlay_last_wins, override_chain, loose_or_packed, first_seen,
    missing_rows, present_rows, key_set_equality, dict_ambiguity, default_name, positional_join, two_hop_fk, range_tag, range_join_binned, char_entropy, byte_entropy, merge_hits, evidence_topk,
    ordered_counts, largest_per_group, refcount, series_extend, range_merge, cumulative_budget, dup_groups, pooled_values, conditional_counts, row_export, manifest, validate_rows,
    status_gate, rows_equal, token_multiset, offset_map, splice_text, map_addresses, overlap_check, consistent_rename, fixed_slot, pool_offsets, clone_references, paged_catalog,
    name_pattern, disambiguate, expand_refs, json_leaf, json_canonical, header_cells, preview, name_split, ruby_strip, letter_ranges, charset_plan, variants, quoted_tokens,
    utf16_units, break_policy, container_flat, container_chunked, container_tree, container_records, container_index, container_replace, incremental_patch, codec_roundtrip, codec_bounded,
    keyed_bytes, aes_roundtrip, charset_strict, charset_lacking, encoding_guess, publish_roundtrip, stream_tumbling, stream_sliding, stream_sessions,
    evidence_scan, evidence_candidates, scan_limits, derived_paths, volume_sets, paired_files, strict_json, tree_nodes, event_leaves, delimited_rows, xml_resources, grid_records, tag_lexer,
    tag_attributes, handoff, path_check, path_collisions, pointer_repair,
    rel_pricing, rel_cube, rel_rollup, rel_windows, rel_asof, rel_sets, rel_top_customers, rel_sessions, rel_hourly,
]}
QUERIES |= delivery.QUERIES
