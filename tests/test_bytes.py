"""Codecs and containers against hand-made bytes and round trips."""

import hashlib
import lzma
import random
import struct
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from weftline.functions import charset, codecs
from weftline.sources import containers, publish


@settings(max_examples=80, deadline=None)
@given(st.binary(max_size=200), st.integers(0, 260), st.sampled_from(["whole", "cut", "longer"]), st.integers(1, 9))
def test_bounded_streams_are_whole_or_refused(data, limit, shape, n):
    for pack, unpack in ((zlib.compress, codecs.inflate), (lzma.compress, codecs.unlzma)):
        z = pack(data)
        z = {"whole": z, "cut": z[: len(z) - min(n, len(z))], "longer": z + b"\x01" * n}[shape]
        if shape == "whole" and len(data) <= limit:
            assert unpack(z, limit) == data
        else:
            with pytest.raises((ValueError, zlib.error, lzma.LZMAError)):
                unpack(z, limit)


def test_lz4_by_hand():
    # 3 literals, then a match of 9 that overlaps its own output, then literals
    block = bytes([0x35]) + b"abc" + struct.pack("<H", 3) + bytes([0x20]) + b"xy"
    assert codecs.unlz4(block, 100) == b"abc" + b"abcabcabc" + b"xy"
    with pytest.raises(ValueError):
        codecs.unlz4(block, 5)
    with pytest.raises(ValueError):
        codecs.unlz4(bytes([0x10]) + b"a" + struct.pack("<H", 9) + b"\0", 100)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from([b"a", b"abc", b"\0\0\0", b"0123456789abcdefghij", bytes(range(200, 256)), b"ab" * 300]), max_size=40))
def test_lz4_by_both_decoders(parts):
    data = b"".join(parts)
    z = codecs.lz4_block(data)
    assert codecs.unlz4(z, len(data)) == codecs._unlz4_tokens(z, len(data)) == data == codecs.unlz4(z, len(data) + 100)
    for bad in (z[:-1], z[: len(z) // 2]):
        for decoder in (codecs.unlz4, codecs._unlz4_tokens):
            try:
                assert data.startswith(decoder(bad, len(data)))
            except ValueError:
                pass


def test_lz4_at_its_edges():
    assert codecs.unlz4(b"\x10a\x01\x00", 5) == b"aaaaa"  # ends in a match
    text = b"abcd" * (3 << 19)
    assert codecs.unlz4(codecs.lz4_block(text), len(text)) == text  # more than a frame's block
    assert codecs.unlz4(b"", 3) == codecs.unlz4(b"\0", 0) == b""
    # an offset of 0, one before the start, an offset, a length and literals cut off
    for bad in (b"\x40abcd\x00\x00\x80abcdefgh", b"\x10a\x02\x00\x00", b"\x35abc\x03", b"\xf0", b"\x10"):
        with pytest.raises(ValueError):
            codecs.unlz4(bad, 100)
    with pytest.raises(ValueError):
        codecs.unlz4(b"\x50hello", 4)


def test_lzss_by_hand():
    # literals a b c, then a pair: ring position of the first literal, length 6
    pos = 4078
    pair = bytes([pos & 0xFF, (pos >> 4 & 0xF0) | 3])
    assert codecs.unlzss(bytes([0b0111]) + b"abc" + pair, 100) == b"abc" + b"abcabc"


@settings(max_examples=50, deadline=None)
@given(st.binary(max_size=300), st.binary(min_size=1, max_size=9), st.integers(0, 2**31))
def test_keyed_transforms_are_involutions(data, key, seed):
    assert codecs.xor_repeat(codecs.xor_repeat(data, key), key) == data
    assert codecs.xor_position(codecs.xor_position(data, seed), seed) == data
    assert codecs.xor_lcg(codecs.xor_lcg(data, seed), seed) == data
    assert codecs.swap_nibbles(codecs.swap_nibbles(data)) == data
    assert codecs.rotate_bits(codecs.rotate_bits(data, 3), 5) == data
    assert codecs.unlzss(codecs.lzss_literals(data), 300) == data
    assert codecs.unlzma(lzma.compress(data), 300) == data


def test_checksums_have_their_check_values():
    d = b"123456789"
    assert codecs.crc64(d) == 0x995DC9BBDF1939FA
    assert codecs.fnv1a(b"a") == 0xAF63DC4C8601EC8C
    assert codecs.fnv1a(b"a", 32) == 0xE40C292C
    assert codecs.murmur2(b"") == 0
    assert codecs.xor32(b"\1\0\0\0\2") == 3


def _flat(members):
    at = 8 + sum(14 + len(n) for n, _ in members)
    out = b"FLAT" + struct.pack("<I", len(members))
    for n, d in members:
        out += struct.pack("<H", len(n)) + n + struct.pack("<III", at, len(d), zlib.crc32(d))
        at += len(d)
    return out + b"".join(d for _, d in members)


def _table(spark, *contents):
    return spark.createDataFrame([(f"c{i}", bytearray(b)) for i, b in enumerate(contents)], "container string, content binary")


def test_flat_scan_reads_what_was_laid_out_by_hand(spark):
    raw = _flat([(b"a.txt", b"first"), ("dir/ü.txt".encode(), b"")])
    rows = containers.scan(_table(spark, raw), "flat", payload=True).orderBy("ordinal").collect()
    assert [(r.name, bytes(r.payload), r.status) for r in rows] == [("a.txt", b"first", "success"), ("dir/ü.txt", b"", "success")]
    index = containers.scan(_table(spark, raw), "flat", "*.TXT")
    assert "payload" not in index.columns and index.count() == 2


def test_bad_containers_are_blocked_whole_and_bad_members_alone(spark):
    good = _flat([(b"a", b"12345"), (b"b", b"678")])
    bad_crc = bytearray(good)
    bad_crc[-1] ^= 1
    rows = containers.scan(_table(spark, good[:20], b"", bytes(bad_crc), _flat([(b"A", b"x"), (b"a", b"y")])), "flat", payload=True).collect()
    by = {}
    for r in rows:
        by.setdefault(r.container, []).append((r.name, r.status))
    assert by["c0"] == [(None, "blocked")] and by["c1"] == [(None, "blocked")]
    assert sorted(by["c2"]) == [("a", "success"), ("b", "blocked")]
    assert by["c3"] == [(None, "blocked")]


def test_records_and_chunked_by_hand(spark):
    words = ["始まり", "同じ", "同じ"]
    raw = b"".join(struct.pack("<H", len(w.encode("cp932"))) + w.encode("cp932") for w in words)
    got = containers.scan(_table(spark, raw), "records", payload=True).select("ordinal", charset.decode_strict(F.col("payload"), "cp932").alias("w")).orderBy("ordinal")
    assert [r.w for r in got.collect()] == words
    body, name = b"hello hello", "s.ks".encode("utf-16-le")
    chunk = lambda t, b: t + struct.pack("<Q", len(b)) + b
    entry = chunk(b"info", struct.pack("<IQQH", 0, 11, 11, 4) + name) + chunk(b"segm", struct.pack("<IQQQ", 0, 19, 5, 5) + struct.pack("<IQQQ", 0, 24, 6, 6)) + chunk(b"adlr", struct.pack("<I", zlib.adler32(body)))
    index = chunk(b"File", entry)
    raw = containers.CHUNKED_MAGIC + struct.pack("<Q", 30) + body + b"\0" + struct.pack("<Q", len(index)) + index
    (r,) = containers.scan(_table(spark, raw), "chunked", payload=True).collect()
    assert (r.name, bytes(r.payload), r.size) == ("s.ks", body, 11)


@pytest.mark.parametrize("fmt", ["flat", "chunked", "tree"])
def test_build_and_replace(spark, fmt):
    rng = random.Random(7)
    data = [("x", i, f"d{i % 3}/n{i}", bytearray(rng.randbytes(i * 37))) for i in range(12)]
    m = spark.createDataFrame(data, "container string, ordinal long, name string, payload binary")
    back = containers.scan(containers.build(m, fmt), fmt, payload=True).select("container", "ordinal", "name", "payload")
    assert {r.name: bytes(r.payload) for r in back.collect()} == {n: bytes(b) for _, _, n, b in data}
    new = spark.createDataFrame([("x", "d1/n1", bytearray(b"new"))], "container string, name string, payload binary")
    again = containers.scan(containers.build(containers.replace_members(back, new), fmt), fmt, payload=True)
    want = {n: hashlib.sha256(b"new" if n == "d1/n1" else bytes(b)).hexdigest() for _, _, n, b in data}
    assert {r.name: r.h for r in again.select("name", F.sha2("payload", 256).alias("h")).collect()} == want


def test_publish_refuses_to_overwrite(spark, tmp_path):
    df = spark.range(10)
    publish.publish(df, f"{tmp_path}/t")
    assert publish.read_back(df, f"{tmp_path}/t") and not publish.read_back(spark.range(9), f"{tmp_path}/t")
    with pytest.raises(FileExistsError):
        publish.publish(df, f"{tmp_path}/t")


def test_charsets(spark):
    df = spark.createDataFrame([(bytearray("あ".encode("cp932")),), (bytearray(b"\x81\x20"),), (None,)], "b binary")
    assert [r[0] for r in df.select(charset.decode_strict(F.col("b"), "cp932")).collect()] == ["あ", None, None]
    with pytest.raises(ValueError):
        charset.substitute(F.lit("x"), {"a": "x", "b": "x"})


def test_codec_roundtrip_of_a_text_above_16_mib(spark, tmp_path):
    from weftline.plans import catalogue

    texts = {1: "abcdefg\n" * ((1 << 21) + 1), 2: "", 3: "é", 4: None}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = {k: t if t is None else hashlib.sha256(t.encode()).hexdigest() for k, t in texts.items()}
    assert {r.doc_id: r.sha256 for r in catalogue.codec_roundtrip(spark, str(tmp_path)).collect()} == want
