"""Lexer, attributes, trees, pickles and scans on small inputs."""

import pickle

from pyspark.sql import functions as F

from weftline.sources import scan, structured


def test_lexer_keeps_every_character(spark):
    texts = ['a<b c="x>y" d=\'>\'>e<<f<g', "", "<>", "plain", "<a", "x<<", "é<p>ü</p>"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    got = {}
    for r in structured.lex(df, "id", "t").orderBy("id", "ordinal").collect():
        got.setdefault(r.id, []).append((r.kind, r.token))
        assert texts[r.id][r.start : r.end] == r.token
    assert {k: "".join(t for _, t in v) for k, v in got.items()} == {i: t for i, t in enumerate(texts) if t}
    assert got[0] == [("text", "a"), ("tag", "<b c=\"x>y\" d='>'>"), ("text", "e<<f"), ("open", "<g")]


def test_attributes(spark):
    df = spark.createDataFrame([('<a href="x y" id=7 class=\'q\'>',), ("[voice file=a.ogg]",), ("<br>",)], "t string")
    assert [r[0] for r in df.select(structured.attributes(F.col("t"))).collect()] == [{"href": "x y", "id": "7", "class": "q"}, {"file": "a.ogg"}, {}]


def test_strict_json_and_trees(spark):
    rows = [(1, '{"a": [1, {"b": null}], "c": "x"}'), (2, '{"a": 1, "a": 2}'), (3, "[NaN]"), (4, "{"), (5, None), (6, "[" * 50 + "]" * 50)]
    df = spark.createDataFrame(rows, "id int, j string")
    why = {r.id: r.w for r in df.select("id", structured.strict_json(F.col("j")).alias("w")).collect()}
    assert why == {1: None, 2: "duplicate", 3: "constant", 4: "malformed", 5: "null", 6: None}
    nodes = structured.tree_nodes(df, "id", "j", max_depth=10).collect()
    assert [(r.pos, r.parent, "/".join(r.path), r.tag, r.value) for r in nodes if r.id == 1] == [
        (0, None, "", "object", None), (1, 0, "a", "array", None), (2, 1, "a/0", "integer", "1"), (3, 1, "a/1", "object", None), (4, 3, "a/1/b", "null", None), (5, 0, "c", "string", "x"),
    ]
    assert {r.id for r in nodes if r.status == "blocked"} == {2, 3, 4, 5, 6}


def test_pickles_are_read_and_never_run(spark):
    class Boom:
        def __reduce__(self):
            return (exec, ("raise SystemExit",))

    df = spark.createDataFrame([(bytearray(pickle.dumps({"k": ["v", 1]}, 2)),), (bytearray(pickle.dumps(Boom(), 2)),), (bytearray(b"\x80\x02("),)], "b binary")
    got = [r[0] for r in df.select(structured.pickle_strings(F.col("b"))).collect()]
    assert [x.value for x in got[0]] == ["k", "v"] and [x.value for x in got[1]] == ["raise SystemExit"] and got[2] is None


def test_xml_with_a_dtd_is_not_read(spark):
    df = spark.createDataFrame([(1, '<!DOCTYPE x [<!ENTITY e "y">]><Doc><Res id="1">a</Res><Log text="1"/></Doc>'), (2, '<Doc><Res id="1">a</Res><Log text="1" name="2"/></Doc>')], "id int, x string")
    got = {r.id: (r.message, r.name, r.dangling) for r in structured.text_resources(df, "id", "x").collect()}
    assert got == {1: (None, None, True), 2: ("a", None, False)}


def test_scan_of_a_folder(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    for i in range(20):
        (tmp_path / "sub" / f"f{i}.dat").write_bytes(b"MAGIC" + bytes([i]))
    (tmp_path / "n.ks").write_bytes(b"text")
    hits = scan.evidence(scan.files(spark, str(tmp_path)), [("pack", b"MAGIC")], [("script", ".ks"), ("pack", ".dat")], [])
    got = {r.kind: r for r in scan.candidates(hits, 12).collect()}
    assert (got["pack"].n_files, got["pack"].n_hits, got["pack"].best, got["pack"].capped, len(got["pack"].shown)) == (20, 40, "probe", True, 12)
    assert (got["script"].n_hits, got["script"].best, got["script"].capped) == (1, "extension", False)
