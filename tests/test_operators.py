"""Operators on small hand-made tables."""

from pyspark.sql import functions as F

from weftline.functions import text as tx
from weftline.operators import contract, edits, resolve, spans, stats


def test_equal_length_swaps_are_not_detected(spark):
    a = spark.createDataFrame([(1, 0, None, "same a"), (1, 1, None, "same b")], "f int, p int, name string, message string")
    b = spark.createDataFrame([(1, 0, None, "same b"), (1, 1, None, "same a")], a.schema)
    assert contract.validate(a, b, ["f", "p"], r"\[[^\]]*\]").where("not valid").count() == 0


def test_validation_reasons(spark):
    s = "f int, p int, name string, message string"
    a = spark.createDataFrame([(1, 0, "G", "hello[n]world"), (1, 1, None, "same"), (1, 2, None, "x"), (1, 3, "N", "y")], s)
    b = spark.createDataFrame([(1, 0, "G", "bonjour world"), (1, 1, "X", "meme"), (1, 2, None, ""), (1, 9, None, "z")], s)
    got = {r.p: r.reason for r in contract.validate(a, b, ["f", "p"], r"\[[^\]]*\]").collect()}
    assert got == {0: "tokens", 1: "name", 2: "empty", 3: "missing", 9: "extra"}


def test_breaks_may_only_go(spark):
    rows = [(["a", "n", "n", "b"], ["a", "n", "b"], True), (["a", "n", "b"], ["a", "b"], True), (["a", "b"], ["a", "n", "b"], False), (["a", "n", "b", "c"], ["a", "b", "n", "c"], False), (["a", "n"], ["b", "n"], False), ([], [], True)]
    df = spark.createDataFrame(rows, "b array<string>, a array<string>, want boolean")
    assert df.select(tx.only_breaks_dropped(F.col("b"), F.col("a"), "n").alias("g"), "want").where("g <> want or g is null").count() == 0


def test_top_with_floor(spark):
    hits = [("e", "ext", i) for i in range(40)] + [("e", "probe", 50), ("e", "name", 60)]
    df = spark.createDataFrame(hits, "g string, kind string, seq int")
    rank = F.when(F.col("kind") == "probe", 0).when(F.col("kind") == "name", 1).otherwise(2)
    assert [(r.kind, r.place) for r in stats.top_with_floor(df, "g", rank, "seq", 1).orderBy("place").collect()] == [("probe", 1), ("name", 2), ("ext", 3)]
    assert stats.top_with_floor(df, "g", rank, "seq", 0).count() == 0
    assert stats.top_with_floor(df, "g", rank, "seq", 5).count() == 5


def test_section_nesting_and_one_shot(spark):
    lines = spark.createDataFrame([(1, i, b) for i, b in enumerate(["(", "x", "(", "y", ")", ")", "z"])], "doc int, line int, body string")
    got = spans.section_mask(lines, "doc", F.col("body") == "(", F.col("body") == ")").orderBy("line").collect()
    assert [r.depth for r in got] == [1, 1, 2, 2, 2, 1, 0] and [r.nested for r in got][2:5] == [True] * 3
    rows = spark.createDataFrame([(1, 0, "N", None), (1, 1, None, "m"), (1, 2, None, "m"), (1, 3, "A", None), (1, 4, "B", None), (1, 5, None, "m")], "d int, o int, name string, msg string")
    got = spans.one_shot(rows, ["d"], "o", F.col("name"), F.col("msg").isNotNull()).orderBy("o").collect()
    assert [r.speaker for r in got] == [None, "N", None, None, None, "B"]


def test_splice_and_addresses(spark):
    docs = spark.createDataFrame([(1, "abcdefghij"), (2, "xyz")], "doc int, text string")
    e = spark.createDataFrame([(1, 2, 4, "CCCC"), (1, 6, 9, "")], "doc int, start long, end long, replacement string")
    assert {r.doc: r.spliced for r in edits.splice(docs, e, "doc", "text").collect()} == {1: "abCCCCefj", 2: "xyz"}
    a = spark.createDataFrame([(1, i) for i in range(11)], "doc int, address long")
    got = {r.address: r.mapped for r in edits.map_addresses(a, e, "doc", "address").collect()}
    assert got == {0: 0, 1: 1, 2: 2, 3: None, 4: 6, 5: 7, 6: 8, 7: None, 8: None, 9: 8, 10: 9}
    assert edits.overlaps(e, "doc").count() == 0
    assert edits.overlaps(e.unionByName(spark.createDataFrame([(1, 3, 5, "")], e.schema)), "doc").count() == 1


def test_binned_ranges_equal_the_plain_condition(spark):
    p = spark.createDataFrame([(i,) for i in range(0, 300, 7)], "x long")
    r = spark.createDataFrame([(i, i * 13, i * 13 + (i % 5) * 30 + 1) for i in range(20)], "id int, lo long, hi long")
    want = p.join(r, (F.col("x") >= F.col("lo")) & (F.col("x") < F.col("hi")))
    got = resolve.in_binned_ranges(p, "x", r, "lo", "hi", 16)
    assert contract.same_rows(got.select("x", "id"), want.select("x", "id")).first().equal


def test_unescape_and_path_key(spark):
    df = spark.createDataFrame([(r"a\nb\\n\q", "Café.TXT")], "t string, p string")
    r = df.select(tx.unescape(F.col("t"), [("\\n", "\n"), ("\\\\", "\\")]).alias("u"), tx.path_key(F.col("p")).alias("k")).first()
    assert r.u == "a\nb\\n\\q" and r.k == "café.txt"


def test_a_blocked_record_empties_its_member(spark):
    df = spark.createDataFrame([("a", "success"), ("a", "blocked"), ("b", "success")], "m string, status string")
    assert [r.m for r in contract.gate(df, "m").collect()] == ["b"]
