"""Paths and byte edits."""

import struct

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from weftline.operators import binary, paths


def test_paths():
    ok = {"folder\\scene.ks": "folder/scene.ks", "cafe\u0301.txt": "caf\u00e9.txt", "a/b": "a/b"}
    assert {k: paths._normal(k)[0] for k in ok} == ok
    for bad in ("../x", "/x", "C:/x", "a:b", "a//b", "CON", "aux.txt", "com¹.log", "a.", "b ", "x\0y", "", None):
        assert paths._normal(bad)[0] is None


def test_collisions(spark):
    df = spark.createDataFrame([(p,) for p in ("A.ks", "a.ks", "d", "d/b", "cafe\u0301", "CAFÉ", "z/y")], "p string")
    assert {(r.key, r.kind) for r in paths.collisions(df, "p").collect()} == {("a.ks", "same"), ("café", "same"), ("d", "prefix")}


@settings(max_examples=60, deadline=None)
@given(st.binary(min_size=8, max_size=60), st.lists(st.tuples(st.integers(0, 50), st.integers(1, 6), st.binary(max_size=9)), max_size=4), st.integers(0, 60))
def test_pointers_follow_their_bytes(data, raw, target):
    edits, at = [], 4
    for s, n, r in sorted(raw):
        s = max(s, at)
        if s + n <= len(data):
            edits.append((s, s + n, r))
            at = s + n
    target = min(target, len(data))
    data = struct.pack("<I", target) + data[4:]
    if any(s < target < e for s, e, _ in edits):
        with pytest.raises(ValueError):
            binary.repair(data, edits, [0])
        return
    out = binary.repair(data, edits, [0])
    (new,) = struct.unpack_from("<I", out)
    tail = binary.splice(data[target:], [(s - target, e - target, r) for s, e, r in edits if s >= target])
    assert out[new:] == tail or target < 4


def test_a_broken_document_is_blocked_alone(spark):
    docs = spark.createDataFrame([(1, bytearray(b"abcdef")), (2, bytearray(b"abcdef"))], "d int, content binary")
    e = spark.createDataFrame([(1, 1, 3, bytearray(b"")), (2, 1, 3, bytearray(b"x")), (2, 2, 4, bytearray(b"y"))], "d int, start long, end long, replacement binary")
    p = spark.createDataFrame([], "d int, field long")
    got = {r.d: (bytes(r.content), r.status) for r in binary.patch(docs, e, p, "d", "content").collect()}
    assert got == {1: (b"adef", "success"), 2: (b"abcdef", "blocked")}
