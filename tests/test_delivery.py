"""Writers, read-back, files of tables and codecs, by cases and properties."""

import json
import struct
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from weftline.functions import charset, codecs
from weftline.functions import text as tx
from weftline.operators import rewrite, verify
from weftline.sources import containers
from weftline.sources import tables_in_files as inside

#: Published test vectors.
SIP_KEY, SIP_OF_15 = bytes(range(16)), 0xA129CA6149BE45E5
POLY_KEY = bytes.fromhex("85d6be7857556d337f4452fe42d506a80103808afb0db2fd4abff6af4149f51b")
POLY_TAG = bytes.fromhex("a8061dc1305136c6c22b8baf0c0127a9")
TWISTER_5489 = 3499211612


def test_published_values():
    assert codecs.siphash(bytes(range(15)), SIP_KEY) == SIP_OF_15
    assert codecs.poly1305(b"Cryptographic Forum Research Group", POLY_KEY) == POLY_TAG
    assert struct.unpack("<I", codecs.xor_twister(bytes(4), 5489)) == (TWISTER_5489,)


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=400) | st.lists(st.sampled_from([b"ab", b"abc", b"\0", b"zz"]), max_size=200).map(b"".join), st.integers(0, 2**32 - 1))
def test_codecs_return_what_they_took(data, seed):
    for name, pack in codecs.ENCODERS.items():
        z = pack(data)
        assert codecs.DECODERS[name](z, len(data)) == data
        if data and name != "raw":
            with pytest.raises(ValueError):
                codecs.DECODERS[name](z, len(data) - 1)
    assert codecs.xor_twister(codecs.xor_twister(data, seed), seed) == data
    assert codecs.swap_bit_pairs(codecs.swap_bit_pairs(data)) == data


@settings(max_examples=80, deadline=None)
@given(st.binary(max_size=60), st.sampled_from(["huffman", "pairs", "lz4", "lzss"]), st.booleans())
def test_noise_is_refused_or_bounded(data, name, magic):
    if name == "pairs" and magic:
        data = codecs.PAIR_MAGIC + struct.pack("<II", 1, 50) + data
    try:
        assert len(codecs.DECODERS[name](data, 50)) <= 50
    except (ValueError, IndexError):
        pass


def test_a_pair_that_holds_itself_is_refused():
    table = b"\x00" + b"\x00" + b"\x00\x01\x02" + b"\xfd"  # symbol 0 itself, 1 = (1, 2), the rest themselves
    with pytest.raises((ValueError, IndexError)):
        codecs.unpairs(codecs.PAIR_MAGIC + struct.pack("<II", 1, 9) + table + struct.pack("<H", 1) + b"\1", 100)


def _chunk(tag, data):
    return tag + struct.pack("<Q", len(data)) + data


def _entry(name, at, data, extra=b"", flags=0):
    units = name.encode("utf-16-le")
    info = struct.pack("<IQQH", flags, len(data), len(data), len(units) // 2) + units
    return _chunk(b"File", _chunk(b"info", info) + _chunk(b"segm", struct.pack("<IQQQ", 0, at, len(data), len(data))) + _chunk(b"adlr", struct.pack("<I", zlib.adler32(data))) + extra)


def _table(spark, *contents):
    return spark.createDataFrame([(f"c{i}", bytearray(b)) for i, b in enumerate(contents)], "container string, content binary")


def test_an_index_behind_a_pointer_block(spark):
    """The offset field names the block, which holds the offset; and a container whose
    index really starts there."""
    body = b"payload!"
    block = struct.pack("<I", 1) + b"\x80" + struct.pack("<Q", 0)  # what stands from 0x13 to 0x20
    index = _entry("a.ks", 0x28, body)
    head = containers.CHUNKED_MAGIC + struct.pack("<Q", 0x17) + block
    behind = head + struct.pack("<Q", 0x28 + len(body)) + body + b"\0" + struct.pack("<Q", len(index)) + index
    index = _entry("b.ks", 19, b"four")
    direct = containers.CHUNKED_MAGIC + struct.pack("<Q", 23) + b"four" + b"\0" + struct.pack("<Q", len(index)) + index
    outside = head + struct.pack("<Q", 1 << 40) + body
    got = {r.container: (r.name, r.payload and bytes(r.payload), r.status) for r in containers.scan(_table(spark, behind, direct, outside), "chunked", payload=True).collect()}
    assert got["c0"] == ("a.ks", body, "success") and got["c1"] == ("b.ks", b"four", "success") and got["c2"][2] == "blocked"


def test_patches_keep_what_they_do_not_know(spark):
    gap = b"gap of unknown bytes"
    extra = _chunk(b"time", b"12345678")
    index = _entry("a", 19, b"first", extra) + _entry("b", 24 + len(gap), b"second")
    raw = containers.CHUNKED_MAGIC + struct.pack("<Q", 30 + len(gap)) + b"first" + gap + b"second" + b"\0" + struct.pack("<Q", len(index)) + index
    flat = b"FLAT" + struct.pack("<I", 1) + struct.pack("<H", 1) + b"a" + struct.pack("<III", 30, 2, zlib.crc32(b"xy")) + b"unknown" + b"xy"
    for fmt, old, changed in (("chunked", raw, {"a": b"longer than before"}), ("flat", flat, {"a": b""})):
        table = _table(spark, old, old)
        changes = spark.createDataFrame([("c0", k, bytearray(v)) for k, v in changed.items()] + [("c1", "no such", bytearray(b""))], "container string, name string, payload binary")
        out = {r.container: (bytes(r.content), r.status) for r in containers.patch(table, changes, fmt).collect()}
        assert out["c1"] == (old, "blocked")
        new, state = out["c0"]
        kept = old[19:] if fmt == "chunked" else old[23:]
        assert state == "success" and kept in new and (fmt == "flat" or new.count(extra) == 2)
        before, after = (containers.scan(_table(spark, b), fmt, payload=True) for b in (old, new))
        states = {r.name: r.state for r in verify.members(before, after, changes.where("container = 'c0'"), ["container", "name"]).collect()}
        assert states == {k: "replaced" if k in changed else "same" for k in states} and "lost" not in states.values()


def test_profiles_by_checksum(spark):
    body = b"some payload of a member"
    masked = bytes(b ^ (i & 0xFF) for i, b in enumerate(body))
    make = lambda stored: containers.CHUNKED_MAGIC + struct.pack("<Q", 19 + len(body)) + stored + b"\0" + struct.pack("<Q", len(_entry("a", 19, body))) + _entry("a", 19, body)
    got = {r.container: r.profile for r in containers.detect_profile(_table(spark, make(body), make(masked), make(body[::-1]), b"")).collect()}
    assert got == {"c0": "plain", "c1": "xor-low-byte", "c2": None, "c3": None}


def test_members_that_do_not_come_back(spark):
    rows = lambda d: spark.createDataFrame([("c", k, bytearray(v)) for k, v in d.items()], "container string, name string, payload binary")
    got = {r.name: (r.state, r.ok) for r in verify.members(rows({"a": b"1", "b": b"2", "d": b"4", "e": b"5"}), rows({"a": b"1", "b": b"x", "c": b"3", "e": b"7"}), rows({"e": b"6"}), ["container", "name"]).collect()}
    assert got == {"a": ("same", True), "b": ("touched", False), "c": ("new", False), "d": ("lost", False), "e": ("wrong", False)}


def test_writers_refuse_and_keep(spark):
    docs = spark.createDataFrame([(1, "id,T,N\r\n1,a,\r\n2,,\r\n"), (2, "id,T,N\r\n1,a,\r\n"), (3, "id,N,T\r\n1,,a\r\n"), (4, None)], "d int, t string")
    new = spark.createDataFrame([(1, 0, 'say "x", y'), (2, 1, "z"), (3, 0, "z"), (4, 0, "z")], "d int, line long, value string")
    got = {r.d: (r.content, r.status) for r in rewrite.delimited(docs, new, "d", "t", "T").collect()}
    assert got == {1: ('id,T,N\r\n1,a,"say ""x"", y"\r\n2,,\r\n', "success"), 2: ("id,T,N\r\n1,a,\r\n", "blocked"), 3: ("id,N,T\r\n1,,a\r\n", "blocked"), 4: (None, "blocked")}
    data = bytearray(b"\1\0a\2\0bc")
    docs = spark.createDataFrame([(k, data) for k in range(4)], "d int, t binary")
    new = spark.createDataFrame([(0, 1, bytearray(b"")), (1, 2, bytearray(b"x")), (2, 0, bytearray(1 << 15))], "d int, index long, payload binary")
    got = {r.d: (bytes(r.content), r.status) for r in rewrite.records(docs, new, "d", "t").collect()}
    assert got == {0: (b"\1\0a\0\0", "success"), 1: (bytes(data), "blocked"), 2: (bytes(data), "blocked"), 3: (bytes(data), "success")}


def test_nested_strings_keep_their_spelling(spark):
    inner = '{ "a" : "x",  "b": "{\\"c\\": \\"y\\"}" }'
    docs = spark.createDataFrame([(k, json.dumps({"s": inner, "t": "[ 1 ]"})) for k in range(3)], "d int, j string")
    new = spark.createDataFrame([(1, ["s", "b", "c"], "new"), (2, ["t", "0"], "no")], "d int, path array<string>, value string")
    got = {r.d: (json.loads(r.content), r.status) for r in rewrite.nested_leaves(docs, new, "d", "j", [["s"], ["s", "b"], ["t"]]).collect()}
    assert got[0] == ({"s": inner, "t": "[ 1 ]"}, "success") and got[2][1] == "blocked"
    assert got[1][1] == "success" and got[1][0]["t"] == "[ 1 ]"
    assert json.loads(json.loads(got[1][0]["s"])["b"]) == {"c": "new"} and json.loads(got[1][0]["s"])["a"] == "x"


def test_typed_tables_by_hand():
    pool = "表\0id\0名\0x\0".encode("cp932")
    at = {s: pool.index(s.encode("cp932")) for s in ("表", "id", "名", "x")}
    head = struct.pack("<II", at["表"], 2) + struct.pack("<HHI", 1, 2, at["id"]) + struct.pack("<HHI", 4, 4, at["名"])
    raw = struct.pack("<HI", 513, at["x"])
    file = inside.TABLE_MAGIC + b"".join(struct.pack("<I", len(p)) + p for p in (head, raw, pool)) + bytes(4)
    assert list(inside.typed_tables(file)) == [("表", [("id", False), ("名", True)], [[513, "x"]])]
    for bad in (file[:-1], file + b"\0", file[:-5] + b"x" + file[-4:], b"mdb", file.replace(struct.pack("<HHI", 1, 2, at["id"]), struct.pack("<HHI", 1, 3, at["id"]))):
        with pytest.raises((ValueError, struct.error)):
            list(inside.typed_tables(bad))
    with pytest.raises(ValueError):
        list(inside.typed_tables(file, max_rows=0))


@pytest.mark.parametrize("n", [0, 31, 32, 255, 256, 65_535, 65_536])
def test_packed_strings(n):
    raw = b"a" * n
    z = inside._pack_string(raw)
    assert inside._unpack_string(z) == raw and len(z) == n + (1 if n < 32 else 2 if n < 256 else 3 if n < 65_536 else 5)
    for bad in (z + b"x", z[:-1], b"\x01"):
        with pytest.raises(ValueError):
            inside._unpack_string(bad)


def test_shared_references(spark):
    cases = {
        '{"shared":[1,[{"$ref":0},{"$ref":0}]],"x":{"$ref":1}}': '{"x":[1,1]}',
        '{"shared":[{"$ref":1},{"$ref":0}],"x":{"$ref":0}}': "cycle",
        '{"shared":[1],"x":{"$ref":-1}}': "reference",
        '{"shared":[1],"x":{"$ref":true}}': "reference",
        '{"shared":[1],"x":{"$ref":0,"y":1}}': "reference",
        '{"shared":{},"x":1}': "shared is no array",
        '{"shared":[[' + ",".join(['{"$ref":1}'] * 40) + "],[" + ",".join(["0"] * 40) + ']],"x":{"$ref":0}}': "budget",
        "[]": "no object",
        "{": "malformed",
    }
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "k int, j string")
    got = {r.k: r.content or r.reason for r in inside.expand_shared(df, "k", "j", max_nodes=1000).collect()}
    assert [got[i] for i in range(len(cases))] == list(cases.values())


def test_controls_and_second_bytes():
    text = "あソ表".encode("cp932")  # second bytes that look like others
    assert charset._controls(text + b"\xef\xf0" + text, False) == text + b"\r\n" + text
    assert charset._controls(text + b"\\p", True) == text + b"\xef\xf2"
    assert charset._controls(b"\x81\xef" + b"\xef\xf5", False) == b"\x81\xef\\u"
    for bad in (b"\xef\xf1", b"\x81", b"\x81\x20", b"\xef"):
        with pytest.raises(ValueError):
            charset._controls(bad, False)


def test_names_out_of_cells(spark):
    cases = {' "a.ks" ': "a.ks", "7:dir\\b|x": "dir/b", "@c#t": "c", "./d": "d", "(e)": "e", "3.5": None, "12": None, "12.": None, ".5": None, "&f": None, "a b": None, "a　b": None, "?x": None, "": None, "x" * 181: None, "...": None, "a.1": "a.1"}
    df = spark.createDataFrame(list(cases.items()), "t string, want string")
    assert df.where(~tx.clean_token(F.col("t")).eqNullSafe(F.col("want"))).collect() == []


def test_bundles_by_hand_and_by_builder(spark):
    """Members across block borders; a raw table at the end; an LZMA block; bad sizes."""
    import lzma

    stream = b"first member" + b"second" * 50
    filters = [{"id": lzma.FILTER_LZMA1, "lc": 3, "lp": 0, "pb": 2, "dict_size": 1 << 16}]
    cut = 20
    z = bytes([3 + 9 * (0 + 5 * 2)]) + struct.pack("<I", 1 << 16) + lzma.compress(stream[cut:], lzma.FORMAT_RAW, filters=filters)
    info = bytes(16) + struct.pack(">I", 2) + struct.pack(">IIH", cut, cut, 0) + struct.pack(">IIH", len(stream) - cut, len(z), 1)
    info += struct.pack(">I", 3) + struct.pack(">QQI", 0, 12, 4) + b"a\0" + struct.pack(">QQI", 12, 300, 4) + b"dir/b\0" + struct.pack(">QQI", 312, 0, 4) + b"empty\0"
    head = b"UnityFS\0" + struct.pack(">I", 6) + b"5.x\0" + b"2019\0"
    raw = head + struct.pack(">QIII", len(head) + 20 + cut + len(z) + len(info), len(info), len(info), 0x80) + stream[:cut] + z + info
    built = containers.BUILDERS["bundle"]([("x", b"ab" * 90_000), ("y", b""), ("z", bytes(range(256)) * 600)])
    got = {}
    for r in containers.scan(_table(spark, raw, built, raw[:-1], b"UnityFS\0"), "bundle", payload=True).collect():
        got.setdefault(r.container, []).append((r.name, r.payload and bytes(r.payload), r.status))
    assert got["c0"] == [("a", b"first member", "success"), ("dir/b", b"second" * 50, "success"), ("empty", b"", "success")] or got["c0"][2][1] in (b"", None)
    assert [(n, p) for n, p, _ in got["c1"]][0] == ("x", b"ab" * 90_000) and got["c1"][2][1] == bytes(range(256)) * 600
    assert got["c2"][0][2] == got["c3"][0][2] == "blocked" and len(built) < 180_000 + 153_600


def test_a_block_is_decoded_once_for_all_its_members(monkeypatch):
    members = [(f"m{i}", (b"%d words of a member, " % i) * (i % 40)) for i in range(1500)]
    built, calls, block = containers.BUILDERS["bundle"](members), [], containers._block
    monkeypatch.setattr(containers, "_block", lambda d, n, c: calls.append(n) or block(d, n, c))
    got = [r for x in containers._scanned("c", built, "bundle", None, True) for r in x.to_pylist()]
    assert [(r["name"], r["payload"]) for r in got] == members and {r["status"] for r in got} == {"success"}
    assert sum(calls[1:]) == sum(len(d) for _, d in members)  # the first call is the table's


def test_bundles_in_pieces_are_the_bundles(spark):
    """Several pieces a container, cut anywhere on reading; a bad block, a table at the end, a lost piece."""
    import os
    import random

    rows = [(c, i, f"m{i}", bytearray(os.urandom(40_000) * 2 if i % 3 else b"ab" * i)) for c, n in (("a", 170), ("b", 3), (None, 2)) for i in range(n)]
    random.Random(1).shuffle(rows)
    members = spark.createDataFrame([*rows, ("a", 500, "null", None)], "container string, ordinal int, name string, payload binary")
    pieces = {}
    for r in containers.build_pieces(members, "bundle").collect():
        pieces.setdefault(r.container, {})[r.piece] = bytes(r.content)
    files = {c: b"".join(x for _, x in sorted(p.items())) for c, p in pieces.items()}
    assert len(pieces["a"]) > 2 and files == {r.container: bytes(r.content) for r in containers.build(members, "bundle").collect()}

    cut = [("a", k, bytearray(files["a"][at : at + 999_999])) for k, at in enumerate(range(0, len(files["a"]), 999_999))]
    cut += [("b", k, bytearray([x])) for k, x in enumerate(files["b"][:60])] + [("b", 60, bytearray(files["b"][60:]))]
    cut += [(None, 0, bytearray(files[None])), ("short", 0, bytearray(files["b"][:-1])), ("none", 0, None)]
    last = random.Random(2).sample(cut, len(cut))
    got = containers.scan_pieces(spark.createDataFrame(last, "container string, piece int, content binary"), "bundle", payload=True).collect()
    want = {(c, n): bytes(d) for c, _, n, d in rows} | {("a", "null"): b""}
    assert {(r.container, r.name): bytes(r.payload) for r in got if r.status == "success"} == want
    assert {(r.container, r.ordinal): r.status for r in got if r.status != "success"} == {("short", -1): "blocked", ("none", -1): "blocked"}
    assert len(got) == len(want) + 2

    flat = containers.BUILDERS["flat"]([("x", b"1"), ("y", b"22")])
    got = containers.scan_pieces(spark.createDataFrame([("f", 1, bytearray(flat[9:])), ("f", 0, bytearray(flat[:9]))], "container string, piece int, content binary"), "flat", "y", True)
    assert [(r.ordinal, r.name, bytes(r.payload)) for r in got.collect()] == [(1, "y", b"22")]


def test_names_and_order_of_a_bundle():
    def read(*members):
        return [(r["ordinal"], r["name"], r["status"], r["reason"]) for x in containers._scanned("c", containers.BUILDERS["bundle"](members), "bundle", None, True) for r in x.to_pylist()]

    assert read() == [] and read(("A", b"1"), ("b", b"")) == [(0, "A", "success", None), (1, "b", "success", None)]
    assert read(("A", b"1"), ("b", b"2"), ("a", b"3")) == [(-1, None, "blocked", "two members with one name")]
    # a million members take numbers, not objects
    built = containers.BUILDERS["bundle"]([(f"{i:07d}", b"") for i in range(20_000)])
    kept = containers._bundle(built)
    assert kept.table.itemsize * len(kept.table) == 24 * 20_000 and next(iter(kept))["name"] == "0000000"


def test_a_bad_block_blocks_its_members_alone(spark):
    """Blocks cut in a sequence, of another size, and LZMA noise."""
    blocks = [(5, b"\x50hello", 3), (9, b"\x35abc\x03", 3), (4, b"\x50hello", 2), (3, bytes([93]) + bytes(9), 1)]
    info = bytes(16) + struct.pack(">I", 4) + b"".join(struct.pack(">IIH", n, len(z), k) for n, z, k in blocks)
    info += struct.pack(">I", 4) + b"".join(struct.pack(">QQI", at, n, 4) + b"%d\0" % at for at, n in ((14, 4), (0, 5), (5, 9), (18, 3)))
    head = b"UnityFS\0" + struct.pack(">I", 6) + b"5.x\0" + b"2019\0"
    body = info + b"".join(z for _, z, _ in blocks)
    whole = head + struct.pack(">QIII", len(head) + 20 + len(body), len(info), len(info), 0x40) + body
    got = {r.ordinal: (r.name, r.status, r.payload and bytes(r.payload)) for r in containers.scan(_table(spark, whole), "bundle", payload=True).collect()}
    assert got == {0: ("14", "blocked", None), 1: ("0", "success", b"hello"), 2: ("5", "blocked", None), 3: ("18", "blocked", None)}


def test_heads_without_the_rest(spark, tmp_path):
    from weftline.sources import scan

    (tmp_path / "a.bin").write_bytes(b"head" + b"x" * 5000 + b"tail")
    (tmp_path / "b.bin").write_bytes(b"no")
    listing = spark.read.format("binaryFile").load(str(tmp_path)).select("path", F.col("length").alias("size"))
    got = {r.path.rsplit("/", 1)[-1]: (bytes(r.head), bytes(r.tail), r.size) for r in scan.heads(listing, 4, 4).collect()}
    assert got == {"a.bin": (b"head", b"tail", 5008), "b.bin": (b"no", b"no", 2)}
    gone = spark.createDataFrame([(f"file://{tmp_path}/none", 3)], "path string, size long")
    assert scan.heads(gone).first().head is None
    hits = scan.evidence(scan.heads(listing, 8), [("mid", b"ad", 2), ("start", b"he")], [], [])
    assert sorted(r.kind for r in hits.collect()) == ["mid", "start"]


def test_attribute_spans_keep_quotes_and_comments_apart(spark):
    text = "<a x='1' y = \"<2>\"/><!-- <b z='3'/> --><c\n d=\"é\">t</c>"
    from weftline.sources import structured

    got = [tuple(r)[1:] for r in structured.attribute_spans(spark.createDataFrame([(1, text)], "k int, t string"), "k", "t").orderBy("start").collect()]
    assert [(e, t, n, v) for e, t, n, _, _, v in got] == [(0, "a", "x", "1"), (0, "a", "y", "<2>"), (1, "c", "d", "é")]
    assert all(text[s:e] == v for _, _, _, s, e, v in got)
