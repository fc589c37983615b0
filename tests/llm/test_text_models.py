"""Quality rules, line CRF and toxicity."""

import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.llm import line_crf, quality_rules, queries, toxicity
from weftline.llm._spark import held

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    text = text or ""
    w = WORD.findall(text)
    lines, seen, dup = text.split("\n"), set(), 0
    for x in lines:
        if WORD.search(x):
            dup += x in seen
            seen.add(x)
    wins = {}
    for i in range(len(w) - 7):
        wins.setdefault(tuple(w[i : i + 8]), []).append(i)
    cover = {j for v in wins.values() if len(v) > 1 for i in v for j in range(i, i + 8)}
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(cover))


def test_base_counts(spark, documents, awkward, labels):
    for df in (documents, awkward):
        got = quality_rules.quality_rules(df, labels.where("quality = 1")).collect()
        texts = sorted((base(r.text) for r in df.collect()))
        assert sorted(tuple(r[f] for f in quality_rules.FIELDS) for r in got) == texts
        for r in got:
            assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
            assert r.kept == (not r.base_failed and r.llr >= quality_rules.THRESHOLD)


def test_ratio_by_brute_force(spark, documents, labels):
    n = 256
    good = {r.doc_id for r in labels.where("quality = 1").collect()}
    raw, target = quality_rules.multinomials(documents, labels.where("quality = 1"), n)
    grams = sum(max(2 * len(WORD.findall(r.text)) - 1, 0) for r in documents.collect())
    trusted = sum(max(2 * len(WORD.findall(r.text)) - 1, 0) for r in documents.collect() if r.doc_id in good)
    assert raw.sum() == grams and target.sum() == trusted and (target <= raw).all()
    ratio = quality_rules.log_ratio(raw, target, 10.0)
    assert math.isclose((np.exp(ratio) * (raw + 1) / (raw.sum() + n)).sum(), 1, rel_tol=1e-9)
    assert np.allclose(quality_rules.log_ratio(raw, raw * 0, 10.0), 0)


def test_rules_shuffle_path_equals_broadcast(spark, documents, labels, monkeypatch):
    ids = labels.where("quality = 1")
    a = quality_rules.multinomials(documents, ids, 64)
    join = quality_rules.sized_join
    monkeypatch.setattr(quality_rules, "sized_join", lambda *x: join(*x, max_rows=1))
    b = quality_rules.multinomials(documents, ids, 64)
    assert (a[0] == b[0]).all() and (a[1] == b[1]).all()


def test_junk_goes_and_clean_stays(spark, sf):
    sf = sf.replace("0.001", "0.01")
    out = queries.op1_quality_rules(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id")
    good = out.where("quality = 1 and not base_failed").agg(F.avg(F.col("kept").cast("int"))).first()[0]
    bad = out.where("quality = 0").agg(F.avg(F.col("kept").cast("int"))).first()[0]
    assert good > 0.99 and bad < 0.2


def brute_marginals(e, t, s0):
    n, z, p = len(e), 0.0, np.zeros(len(e))
    for m in range(2**n):
        y = [m >> i & 1 for i in range(n)]
        w = math.exp(sum(e[i] for i in range(n) if y[i]) + s0 * y[0] + sum(t[y[i], y[i + 1]] for i in range(n - 1)))
        z += w
        p += w * np.array(y)
    return p / z


def test_forward_backward_equals_enumeration():
    rng = np.random.default_rng(1)
    ld = np.repeat([0, 1, 2, 3], [1, 5, 8, 3])
    e, t = rng.normal(size=len(ld)), rng.normal(size=(2, 2))
    f, b = line_crf.forward_backward(e, ld, t, 0.3)
    got = 1 / (1 + np.exp(-(f + b)))
    for d in range(4):
        assert np.allclose(got[ld == d], brute_marginals(e[ld == d], t, 0.3))


def test_crf_held_out_accuracy(spark, sf):
    sf = sf.replace("0.001", "0.01")
    out = queries.op3_line_crf(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id")
    r = out.where("held_out").agg(F.avg((F.col("predicted") == F.col("quality")).cast("int"))).first()[0]
    assert r > 0.95


def test_held_is_crc32(spark):
    rows = spark.range(-5, 50).withColumnRenamed("id", "doc_id").select("doc_id", held("doc_id", 5, 0).alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)


def test_crf_awkward(spark, documents, awkward, labels):
    model = line_crf.train(documents, labels, "quality", ~held("doc_id", 5, 0))
    for df in (awkward, awkward.limit(0)):
        got = line_crf.score(df, model).collect()
        assert len(got) == df.count() and all(0 <= r.score <= 1 for r in got)
        assert line_crf.keep_good(df, model, 0.0).exceptAll(df).count() == 0
    marks = line_crf.line_labels(documents, model)
    want = sum(len([x for x in r.text.split("\n") if WORD.search(x)]) for r in documents.collect())
    assert marks.count() == want
    none = labels.withColumn("quality", F.lit(None).cast("int"))
    assert line_crf.score(awkward, line_crf.train(documents, none, "quality", F.lit(True))).select("score").distinct().count() == 1


def test_gru_gradients(monkeypatch):
    monkeypatch.setattr(toxicity, "F32", np.float64)
    rng = np.random.default_rng(0)
    m = toxicity.start_model([b"one two three idiot four", b"five six seven"], np.array([1, 0]), 3, 4, 2, least=1)
    m.p = {k: v.astype(np.float64) for k, v in m.p.items()}
    x = rng.normal(size=(9, m.p["wf"].shape[0]))
    x[-1] = 0
    length = np.array([4, 3, 0, 1])
    index = np.where(np.arange(4) < length[:, None], rng.integers(0, 8, (4, 4)), 8)
    go = rng.normal(size=4)
    _, kept = m.forward(x, index, length, True)
    g, gx = m.backward(x, index, length, kept, go)

    def slope(arr, i):
        old, out = arr[i], []
        for d in (1e-5, -1e-5):
            arr[i] = old + d
            out.append((m.forward(x, index, length) * go).sum())
        arr[i] = old
        return (out[0] - out[1]) / 2e-5

    for k in ("a", "v", "o", "wf", "uf", "cf", "wb", "ub", "cb"):
        for _ in range(4):
            i = tuple(rng.integers(0, n) for n in m.p[k].shape)
            assert abs(slope(m.p[k], i) - g[k][i]) < 1e-7
    for _ in range(10):
        i = tuple(rng.integers(0, n) for n in x[:-1].shape)
        assert abs(slope(x, i) - gx[i]) < 1e-7


def test_a_score_does_not_depend_on_its_neighbours(spark, detector):
    model, d, _ = detector
    texts = [r.text.encode() for r in d.orderBy("doc_id").limit(60).collect()] + [b"", b"?! ...", b"Idiot!!, IDIOT idiot&&&"]
    alone = np.concatenate([model.scores(np.frombuffer(t, np.uint8), np.array([0, len(t)])) for t in texts])
    offs = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    together = model.scores(np.frombuffer(b"".join(texts), np.uint8), offs)
    assert np.allclose(alone, together, atol=1e-4)


def test_windows_cover_every_word():
    m = toxicity.start_model([], np.array([], int), 2, 8, 6)
    for n in range(0, 60):
        first, length, doc = m.windows(np.zeros(n, int), 1)
        assert set(range(n)) == {w for f, k in zip(first, length, strict=True) for w in range(f, f + k)} and len(doc) >= 1
        assert (length <= 8).all()


@pytest.fixture(scope="module")
def detector(spark, sf):
    big = sf.replace("0.001", "0.1")
    d, y = (spark.read.parquet(f"{big}/{t}.parquet") for t in ("documents", "labels"))
    return toxicity.train(d, y, "toxic", ~held("doc_id", 3, 1), per_class=600), d, y


def test_toxicity_held_out(spark, detector):
    model, d, y = detector
    out = toxicity.score(d.join(y.where(held("doc_id", 3, 1)).select("doc_id"), "doc_id"), model).join(y, "doc_id")
    r = {x.toxic: x.p for x in out.groupBy("toxic").agg(F.avg((F.col("score") >= 0.7).cast("int")).alias("p")).collect()}
    assert r[1] > 0.7 and r[0] < 0.03


def test_toxic_passage_is_found_anywhere(spark, detector):
    model, d, _ = detector
    clean = d.where("doc_id = 9472").first().text
    bad = "you stupid idiot, worthless scum, pathetic loser and disgusting moron"
    rows = [(0, clean), (1, clean + "\n" + bad), (2, bad + "\n" + clean), (3, clean[:800] + " " + bad + " " + clean[800:])]
    got = {r.doc_id: r.score for r in toxicity.score(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    assert got[0] < 0.7 and min(got[1], got[2], got[3]) >= 0.7


def test_toxicity_awkward(spark, awkward, detector):
    for df in (awkward, awkward.limit(0)):
        got = toxicity.score(df, detector[0]).collect()
        assert len(got) == df.count() and all(0 <= r.score <= 1 for r in got)
    untrained = toxicity.fit([(b"only one class", 0)], 0.2)
    assert toxicity.score(awkward, untrained).select("score").distinct().collect()[0][0] == 0.2


def test_lines_of_mixed_documents_are_told_apart(spark):
    """Bad documents hold prose and junk lines; no line is ever labelled."""
    import random

    rng = random.Random(2)
    prose = lambda: " ".join(rng.choice("when the wind came over hills we saw that many of them had gone".split()) for _ in range(rng.randint(6, 14))).capitalize() + "."
    junk = lambda: " ".join(rng.choice(["BUY", "NOW", "$$$", "###", "cl1ck"]) + rng.choice(["!!!", "***", ""]) for _ in range(rng.randint(6, 14)))
    docs, labels = [], []
    for k in range(240):
        bad = k % 2 == 0
        lines = [junk() if bad and rng.random() < 0.5 else prose() for _ in range(rng.randint(3, 8))]
        if bad and not any("BUY" in x or "$" in x or "#" in x for x in lines):
            lines.append(junk())
        docs.append((k, "\n".join(lines)))
        labels.append((k, int(not bad)))
    d, y = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int")
    model = line_crf.train(d, y, "quality", F.col("doc_id") < 160)
    text = {k: t.split("\n") for k, t in docs}
    right = total = mixed = 0
    seen = {}
    for r in line_crf.line_labels(d.where("doc_id >= 160"), model).collect():
        right += r.good == text[r.doc_id][r.line].endswith(".")
        total += 1
        seen.setdefault(r.doc_id, set()).add(r.good)
    mixed = sum(len(v) == 2 for v in seen.values())
    assert right / total > 0.95 and mixed > 20
    got = line_crf.score(d, model).join(y, "doc_id").where("doc_id >= 160")
    assert got.where("(score >= 0.5) <> (quality = 1)").count() <= 4
