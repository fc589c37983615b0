"""Rules of lines, pointers, names, patches and splices, by cases and properties."""

import struct

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from weftline.operators import binary, catalog, edits, paths, resolve, spans
from weftline.sources import containers, publish, scan

KINDS = {
    "": "blank", " \t\r": "blank", "　": "blank", ";": "comment", "//": "comment", " ;*#[": "comment", "/ one": "text", "*": "label", "\t*#": "label", "*[x]": "label",
    "#": "linetag", "　# a": "linetag", "#;": "linetag", "[": "command", "[a] b": "command", " [a": "command", "]": "text", "@a": "text", "a;": "text", "a[b]": "text", "「a」": "text",
}


def test_line_kinds(spark):
    df = spark.createDataFrame(list(KINDS.items()), "body string, want string")
    assert df.where(spans.line_kind(F.col("body")) != F.col("want")).collect() == []


@settings(max_examples=80, deadline=None)
@given(st.integers(0, 12), st.integers(0, 12), st.integers(1, 4), st.binary(max_size=9), st.booleans())
def test_a_base_moves_with_its_bytes(base, units, unit, new, big):
    """One edit of bytes 4 to 6 before 30 others; the pointer counts from the base."""
    order = ">" if big else "<"
    data = struct.pack(order + "I", units) + b"ab" + bytes(range(30))
    target = base + units * unit
    by = len(new) - 2
    place = lambda a: a if a <= 4 else a + by
    if 5 in (base, target) or target > len(data) or base > len(data) or (place(target) - place(base)) % unit:
        with pytest.raises(ValueError):
            binary.repair(data, [(4, 6, new)], [0], base, unit, order)
        return
    out = binary.repair(data, [(4, 6, new)], [0], base, unit, order)
    (v,) = struct.unpack_from(order + "I", out)
    assert place(base) + v * unit == place(target) and out[4:] == new + bytes(range(30))


def test_pointers_are_checked():
    data = struct.pack("<II", 999, 4) + b"tail"
    for fields, unit in (([0], 1), ([4, 4], 1), ([4, 6], 1), ([4], 0), ([9], 1), ([-1], 1)):
        with pytest.raises(ValueError):
            binary.repair(data, [], fields, 0, unit)
    assert binary.repair(data, [], [4]) == data


def test_wildcards_and_devices_are_refused():
    for bad in ("a*b", "a?b", 'a"b', "a<b", "a>b", "a|b", "CLOCK$", "conin$.x", "d/CONOUT$"):
        assert paths._normal(bad)[0] is None
    assert paths._normal("clock.txt") == ("clock.txt", None)


def test_names_become_unique(spark):
    given_names = ["x", "x", "X_1", "y", "x", "x_3", "y_2", "Y", "y", "x_01", "x"]
    df = spark.createDataFrame(list(enumerate(given_names)), "i int, name string")
    got = [r.slot_name for r in catalog.disambiguate(df, "name", "i").orderBy("i").collect()]
    assert got == ["x", "x_2", "X_1", "y", "x_4", "x_3", "y_2", "Y_1", "y_3", "x_01", "x_5"]


@settings(max_examples=15, deadline=None)
@given(st.lists(st.sampled_from(["a", "A", "a_1", "a_2", "a_1_1", "b", "b_1"]), max_size=14))
def test_unique_names_never_meet(spark, names):
    rows = spark.createDataFrame(list(enumerate(names)), "i int, name string")
    got = [r.slot_name for r in catalog.disambiguate(rows, "name", "i").orderBy("i").collect()]
    assert len({g.lower() for g in got}) == len(names)
    assert all(g == n for k, (g, n) in enumerate(zip(got, names, strict=True)) if n.lower() not in {m.lower() for m in names[:k]})


def test_patches_compare_within_a_container(spark):
    old = spark.createDataFrame([("A", "a.txt", b"1"), ("B", "a.txt", b"2"), ("B", "d/s.ks", b"3"), ("B", "e/S.ks", b"4")], "container string, name string, payload binary")
    new = spark.createDataFrame([("A", "a.txt", b"1"), ("B", "a.txt", b"1"), ("B", "d/s.ks", b"9"), ("B", "e/S.ks", b"4")], "container string, name string, payload binary")
    out = containers.flat_patch(containers.changed_members(new, old), new)
    assert {(r.container, r.name, r.conflict, r.packed_as) for r in out.collect()} == {("B", "a.txt", False, "a.txt"), ("B", "d/s.ks", True, None)}
    assert containers.changed_members(old, old).count() == 0


def test_edits_that_overlap_block_their_text(spark):
    docs = spark.createDataFrame([(1, "abcdef"), (2, "abcdef"), (3, "abc"), (4, None), (5, "é😀z")], "d int, t string")
    e = spark.createDataFrame([(1, 0, 3, "x"), (1, 2, 4, "y"), (2, 1, 2, "--"), (2, 4, 6, ""), (3, 1, 9, "x"), (5, 1, 2, "uu")], "d int, start long, end long, replacement string")
    got = {r.d: (r.spliced, r.splice_status) for r in edits.splice(docs, e, "d", "t").collect()}
    assert got == {1: (None, "blocked"), 2: ("a--cd", "success"), 3: (None, "blocked"), 4: (None, "success"), 5: ("éuuz", "success")}


def test_addresses_at_the_edges_of_edits(spark):
    e = spark.createDataFrame([(1, 2, 4, "xyz"), (1, 4, 5, ""), (2, 0, 1, "ab")], "d int, start long, end long, replacement string")
    a = spark.createDataFrame([(d, p, "own") for d in (1, 3) for p in range(7)], "d int, a long, mapped0 string")
    got = {(r.d, r.a): (r.inside, r.mapped) for r in edits.map_addresses(a, e, "d", "a").collect()}
    assert [got[1, p] for p in range(7)] == [(False, 0), (False, 1), (False, 2), (True, None), (False, 5), (False, 5), (False, 6)]
    assert all(got[3, p] == (False, p) for p in range(7))


@pytest.mark.parametrize("cap", [0, 1, 2, 3, 5, 6, 9])
def test_scan_caps(spark, cap):
    names = ["b", "a", "d/b", "d/a", "d/c", "d/e/f"]
    out = scan.limited(spark.createDataFrame([(n,) for n in names], "path string"), cap, 1)
    order = sorted(names, key=lambda n: (n.count("/"), n))
    want = {n: "depth" if n.count("/") > 1 else None if k < cap else "files" for k, n in enumerate(order)}
    assert {r.path: r.reason for r in out.collect()} == want


def test_many_ranges_are_not_broadcast(spark):
    with pytest.raises(ValueError):
        resolve.in_ranges(spark.range(3), F.col("id"), spark.range(5).select(F.col("id").alias("lo"), (F.col("id") + 1).alias("hi")), "lo", "hi", 4)


def test_what_is_written_is_observed(spark, tmp_path):
    df = spark.range(7).select("id", F.when(F.col("id") % 2 == 0, F.col("id")).alias("k"))
    written = publish.publish(df, f"{tmp_path}/t")
    assert publish.holds(written, f"{tmp_path}/t", df.schema, spark)
    assert not publish.holds(written[:1] + (0,) + written[2:], f"{tmp_path}/t", df.schema, spark)
