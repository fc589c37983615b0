"""SimHash, suffix dedup, and the pipeline's stages."""

import hashlib
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from weftline.llm import _text, ann, near_copies, simhash, site_style, suffix_dedup
from weftline.llm._spark import materialise

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def fingerprint(text):
    t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = WORD.findall(t)
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 4]).encode(), 42) for i in range(max(1, len(w) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def least_reachable(items, radius=4):
    """(id, fp) rows -> least id of each row's component."""
    fp = np.array([f for _, f in items], np.uint64)
    parent = list(range(len(items)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(items)):
        for j in np.flatnonzero(np.bitwise_count(fp ^ fp[i]) <= radius):
            parent[find(int(j))] = find(i)
    low = {}
    for i, (k, _) in enumerate(items):
        if k is not None:
            low[find(i)] = min(low.get(find(i), k), k)
    return [low.get(find(i)) for i in range(len(items))]


def test_simhash_by_brute_force(spark, documents, awkward):
    for df in (documents, awkward):
        rows = [(r.doc_id, fingerprint(r.text)) for r in df.collect()]
        want = sorted(((k, f, c) for (k, f), c in zip(rows, least_reachable(rows), strict=True)), key=repr)
        got = sorted(((r.doc_id, r.fp % 2**64, r.component_id) for r in simhash.near_duplicates(df).collect()), key=repr)
        assert got == want
    assert simhash.near_duplicates(awkward.limit(0)).count() == 0


@pytest.mark.parametrize("slice_rows", [4096, 7])
def test_links_in_chains_and_balls(spark, slice_rows):
    """Fingerprints at random distances around centres, sliced buckets included."""
    rng = random.Random(5)
    fps = set()
    for _ in range(12):
        c = rng.getrandbits(64)
        for _ in range(25):
            fps.add(c)
            nxt = c
            for b in rng.sample(range(64), rng.randint(1, 5)):
                nxt ^= 1 << b
            fps.add(nxt)
            c = nxt if rng.random() < 0.7 else c
    items = [(f - (1 << 64) if f >> 63 else f, f) for f in sorted(fps)]
    want = dict(zip([k for k, _ in items], least_reachable(items), strict=True))
    edges = simhash.links(spark.createDataFrame([(k,) for k, _ in items], "fp long"), 4, slice_rows)
    got = {r.v: r.root for r in simhash.components(edges).collect()}
    assert {k: got.get(k, k) for k in want} == want


def test_keep_one(spark, awkward):
    kept = simhash.keep_one(awkward)
    ids = [r.doc_id for r in kept.collect()]
    assert kept.schema.names == awkward.schema.names
    assert sorted(i for i in ids if i is not None) == [-8, 1, 4, 6, 7, 2**62] and ids.count(None) == 2


def removal(texts, n):
    starts = {}
    for t in texts:
        for i in range(len(t) - n + 1):
            starts[t[i : i + n]] = starts.get(t[i : i + n], 0) + 1
    out = []
    for t in texts:
        gone = np.zeros(len(t) + 1, bool)
        for i in range(len(t) - n + 1):
            if starts[t[i : i + n]] > 1:
                gone[i : i + n] = True
        gone = gone[: len(t)]
        kept = bytes(b for b, g in zip(t, gone, strict=True) if not g)
        runs = int((gone & ~np.concatenate([[False], gone[:-1]])).sum()) if len(t) else 0
        out.append((len(t), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return out


def corpus(seed):
    rng = random.Random(seed)
    part = [bytes(rng.choice(b"ab c") for _ in range(rng.randint(20, 90))) for _ in range(6)] + [b"a" * 70, b"abab" * 20]
    return [b"".join(rng.choice(part) if rng.random() < 0.6 else bytes(rng.choice(b"xyz\n") for _ in range(rng.randint(1, 40))) for _ in range(rng.randint(0, 9))) for _ in range(40)]


@pytest.mark.parametrize("options", [{}, {"hot_phrases": 1}, {"part_bytes": 200}])
def test_suffix_dedup_by_brute_force(spark, options):
    texts = corpus(len(options))
    df = spark.createDataFrame([(i, t.decode()) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    got = {r[0]: tuple(r[1:]) for r in suffix_dedup.removals(df, length=48, gram=12, **options).collect()}
    assert got == dict(enumerate(removal(texts, 48)))


def test_suffix_dedup_awkward(spark, awkward, documents, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "SEGMENT", 1000)
    for df in (awkward, documents):
        raw = [(r.doc_id, (r.text or "").encode()) for r in df.collect()]
        want = sorted(((k, *v) for (k, _), v in zip(raw, removal([t for _, t in raw], 200), strict=True)), key=repr)
        assert sorted((tuple(r) for r in suffix_dedup.removals(df).collect()), key=repr) == want
    assert suffix_dedup.removals(awkward.limit(0)).count() == 0
    out = suffix_dedup.remove_repeats(awkward)
    assert out.schema.names == awkward.schema.names and out.count() == awkward.count()
    for r in out.where("text is not null").collect():
        assert r.n_chars == len(r.text) or r.doc_id in (1, 3) or r.text in {x.text for x in awkward.collect()}


def test_suffix_classes():
    rng = np.random.default_rng(2)
    data = rng.integers(97, 99, 3000).astype(np.uint8)
    for n in (8, 13, 16, 48, 200):
        at = np.arange(len(data) - n + 1)
        cls = suffix_dedup.suffix_classes(data, at, n)
        by = {}
        for p, c in zip(at, cls, strict=True):
            by.setdefault(data[p : p + n].tobytes(), set()).add(int(c))
        assert all(len(v) == 1 for v in by.values()) and len(by) == len(set(cls.tolist()))


def test_phrases_hold_every_window_once():
    rng = np.random.default_rng(4)
    buf = rng.integers(97, 101, 5000).astype(np.uint8)
    offs = np.array([0, 0, 40, 1200, 1390, 5000])
    _, _, doc, lo, size = suffix_dedup.phrases(buf, offs, 60, 16)
    got = sorted((d, w) for d, a, n in zip(doc, lo, size, strict=True) for w in range(a, a + n - 60 + 1))
    assert got == sorted((d, w) for d in range(5) for w in range(offs[d + 1] - offs[d] - 60 + 1))


def test_hasher_and_runs():
    buf = np.frombuffer(b"ab cd ab", np.uint8)
    s, e, d = _text.words(buf, np.array([0, 4, 4, 8]))
    assert list(zip(s, e, d, strict=True)) == [(0, 2, 0), (3, 4, 0), (4, 5, 2), (6, 8, 2)]
    h = _text.Hasher(buf)
    assert h(np.array([0]), np.array([2])) == h(np.array([6]), np.array([8])) != h(np.array([3]), np.array([5]))


# -- pages -------------------------------------------------------------------

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var a="</p>";</script></head><body>
<header class="top">Site</header><nav><ul><li><a href="/x">menu {k}</a></ul></nav><div class="cookie-notice">We use {k} cookies</div>
<div class="ad">Buy {k}</div><article><h1>Title &amp; {k}</h1><p>First <b>bold</b>
 line {k}<p>Second&nbsp;&mdash; line {k}<aside>rel {k}</aside><div class="strip">Follow this site</div><form><input>Mail</form><div id="comments">comment {k}</div></article>
<div class="sidebar">side {k}</div><footer>foot {k}</footer></body></html>"""


def test_site_style(spark):
    rows = [(k, f"https://h.example/{k}", PAGE.format(k=k)) for k in range(12)] + [(99, None, None), (98, "http://solo.example/", "<p>only text<p>here"), (97, "http://h.example/e", "")]
    got = {r.page_id: r for r in site_style.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for k in range(12):  # the strip is the same on every page of the host
        assert got[k].text == f"Title & {k}\nFirst bold line {k}\nSecond — line {k}" and got[k].n_cut == 1
        assert got[k].n_chars == len(got[k].text)
    assert got[99].text == got[97].text == "" and got[98].text == "only text\nhere"


def test_mirrors_are_not_furniture(spark):
    rows = [(k, "http://m.example/a", "<article><p>the very same article</p></article>") for k in range(30)]
    assert {r.text for r in site_style.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()} == {"the very same article"}


# -- vectors -----------------------------------------------------------------


def brute_neighbours(ids, x, q, k=5):
    s = x @ x[q] / (np.linalg.norm(x, axis=1) * np.linalg.norm(x[q]))
    order = [i for i in np.lexsort((ids, -np.round(s, 12))) if ids[i] != ids[q]]
    return [int(ids[i]) for i in order[:k]]


def test_ann_recall_and_ties(spark):
    rng = np.random.default_rng(8)
    x = np.concatenate([rng.normal(size=(1500, 24)), np.tile(rng.normal(size=24), (300, 1))])
    ids = rng.permutation(len(x))
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x, strict=True)], "vec_id long, embedding array<double>")
    got = {}
    for r in ann.neighbours(df, F.col("vec_id") % 50 == 0, block_rows=200, block_queries=16).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    hit = total = 0
    for q in np.flatnonzero(ids % 50 == 0):
        want = brute_neighbours(ids, x, q)
        hit += len(set(want) & set(got[int(ids[q])]))
        total += 5
        if q >= 1500:  # copies of one vector: the least ids, exactly
            assert got[int(ids[q])] == want
    assert hit / total >= 0.9


def test_ann_awkward(spark):
    rows = [(0, [1.0, 0.0]), (50, [0.0, 0.0]), (1, None), (2, [float("nan"), 1.0]), (3, [None, 1.0]), (4, [2.0, 0.0]), (4, [2.0, 0.0]), (5, [1.0, 1.0]), (None, [1.0, 0.0]), (6, [1.0]), (7, [float("inf"), 1.0]), (0, [1.0, 0.0]), (8, [1e300, 1e300])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [(r.query_id, r.rank, r.vec_id, round(r.score, 12)) for r in ann.neighbours(df, F.col("vec_id") % 50 == 0).orderBy("rank").collect()]
    assert got == [(0, 1, 4, 1.0), (0, 2, 5, 0.707106781187), (0, 3, 8, 0.707106781187)]
    assert ann.neighbours(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0


# -- pipeline ----------------------------------------------------------------


def test_pipeline_stages(spark, sf):
    import corpus_pipeline as p

    assert [n for n, _ in p.STAGES] == ["quality", "near_dedup", "suffix_dedup", "mixing", "packing"]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    seen = [docs]
    for name, stage in p.STAGES:
        seen.append(materialise(stage(spark, seen[-1], sf), f"test-{name}"))
    start, good, one, cut, mixed, packed = seen
    assert all(x.columns == start.columns for x in seen[:5])
    assert good.exceptAll(start).count() == 0 and one.exceptAll(good).count() == 0
    rows = [(r.doc_id, fingerprint(r.text)) for r in good.collect()]
    assert sorted(r.doc_id for r in one.collect()) == sorted(set(least_reachable(rows)))
    raw = one.collect()
    want = {r.doc_id: v for r, v in zip(raw, removal([r.text.encode() for r in raw], 200), strict=True)}
    for r in cut.collect():  # whole code points stay at the borders
        n, gone, runs, _ = want[r.doc_id]
        assert n - gone <= len(r.text.encode()) <= n - gone + 6 * runs and r.n_chars == len(r.text)
    assert mixed.exceptAll(cut).count() == 0 and cut.exceptAll(mixed).count() == 0
    words = {r.doc_id: len(WORD.findall(r.text)) for r in mixed.collect()}
    assert {r.doc_id: r.n for r in packed.groupBy("doc_id").agg(F.sum("n_tokens").alias("n")).collect()} == words
    assert p.run(spark, sf).count() == packed.count()


def test_stages_take_rows_that_are_in_no_file(spark, awkward, sf):
    import corpus_pipeline as p

    for name, stage in p.STAGES:
        assert stage(spark, awkward, sf).count() > 0, name


def test_pipeline_awkward(spark, awkward, sf):
    import corpus_pipeline as p

    for start in (awkward, awkward.limit(0)):
        docs = materialise(start, "test-awkward")
        for name, stage in p.STAGES:
            docs = materialise(stage(spark, docs, sf), f"test-{name}")
            if name != "packing":
                assert docs.columns == start.columns


# -- near copies -------------------------------------------------------------


def shingles(text, width=5):
    w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {" ".join(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


def least_similar(items):
    """(id, text) rows -> least id of each row's component of similarity 0.8."""
    held = [shingles(t) for _, t in items]
    parent = list(range(len(items)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(held):
        for j, b in enumerate(held[:i]):
            if a == b or len(a & b) >= 0.8 * len(a | b):
                parent[find(i)] = find(j)
    low = {}
    for i, (k, _) in enumerate(items):
        if k is not None:
            low[find(i)] = min(low.get(find(i), k), k)
    return {low.get(find(i)) for i in range(len(items))} - {None}


def test_near_dedup_keeps_one_of_similarity_080(spark, documents, sf):
    """Copies with ever more words changed, the last below the similarity."""
    import corpus_pipeline as p

    rng = random.Random(3)
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    k = 10**6
    for _ in range(30):
        w = [rng.choice("abcdefgh") + str(rng.randint(0, 999)) for _ in range(rng.randint(60, 300))]
        rows.append((k, " ".join(w)))
        for share in (0.005, 0.01, 0.015, 0.02, 0.03, 0.06):
            k += 1
            rows.append((k, "  ".join(x.upper() if rng.random() > share else "new" + str(rng.random()) for x in w)))
        k += 1
    df = spark.createDataFrame([(a, t, "en", "s", len(t)) for a, t in rows], documents.schema)
    got = sorted(r.doc_id for r in p.near_dedup(spark, df, sf).collect())
    assert got == sorted(least_similar(rows))
    one = sorted(r.doc_id for r in near_copies.keep_one(df, slice_bytes=2000).collect())
    assert one == got


# -- the order of windows ----------------------------------------------------


def anchored(rng, n, length, gram):
    """Phrases around triggers: (bytes, place of the trigger, least and largest distance)."""
    part = [bytes(rng.choice(b"ab\0") for _ in range(length)) for _ in range(3)] + [b"a" * length]
    out = []
    for _ in range(n):
        text = rng.choice(part)[: rng.randint(0, length - gram)] + rng.choice([b"T" * gram, b"U" * gram]) + rng.choice(part)
        at = rng.randint(0, length - gram)
        low = rng.randint(0, at)
        left = (rng.choice(part) * 2)[-at:] if at else b""
        out.append(((left + text + b"zz" * length)[: at + length - low], at, low, at))
    return out


@pytest.mark.parametrize("seed", range(4))
def test_window_classes_by_brute_force(seed):
    """Triggers of several kinds in one part, as if their hashes had met."""
    rng, length, gram = random.Random(seed), 24, 6
    rows = anchored(rng, 60, length, gram)
    data, at, low, high = (list(c) for c in zip(*rows, strict=True))
    hit = suffix_dedup.window_classes(data, np.array(at), np.array(low), np.array(high), length, gram)
    seen = {}
    for i, (d, p, a, b) in enumerate(rows):
        for x in range(a, b + 1):
            seen.setdefault((d[p - x : p - x + length], x), []).append((i, x))
    want = np.zeros_like(hit)
    for v in seen.values():
        for i, x in v:
            want[i, x] = len(v) > 1
    assert (hit == want).all()


@pytest.mark.parametrize("seed", range(4))
def test_halves_hold_every_window_once_and_equal_ones_together(seed):
    rng, length, gram = random.Random(seed), 24, 6
    where = {}
    for d, at, low, high in anchored(rng, 50, length, gram):
        for shift in range(5):
            got = []
            for core, lo, place, a, b, part in suffix_dedup.split_entry(at, low, high, d, shift, length, length - gram):
                assert part == d[lo : lo + len(part)] and len(part) == b - a + length and place == at - lo
                for x in range(a, b + 1):
                    window = part[place - x : place - x + length]
                    assert window == d[at - x : at - x + length] and core[:-1] in window
                    where.setdefault((shift, x, window), set()).add(core)
                    got.append(x)
            assert got == list(range(low, high + 1))
    assert all(len(v) == 1 for v in where.values())


def test_a_passage_of_many_places(spark):
    """One passage in hundreds of texts, each with borders of its own, and copies."""
    rng = random.Random(6)
    passage = bytes(rng.choice(b"abcdefgh ") for _ in range(150))
    own = lambda n: bytes(rng.choice(b"ijklmnop ") for _ in range(n))
    texts = [own(rng.randint(0, 60)) + passage + own(rng.randint(0, 60)) for _ in range(300)] + [own(200)] * 3
    df = spark.createDataFrame([(i, t.decode()) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    for hot in (512, 16):
        got = {r[0]: tuple(r[1:]) for r in suffix_dedup.removals(df, length=48, gram=12, hot_phrases=hot).collect()}
        assert got == dict(enumerate(removal(texts, 48)))


def test_hash_of_many_ranges():
    rng = np.random.default_rng(1)
    data = rng.integers(0, 256, 20_000).astype(np.uint8)
    start, size = rng.integers(0, 19_500, 3000), rng.integers(0, 200, 3000)
    for seed in (0, 42, 2**63 + 5):
        got = _text.xxh64(data, start, start + size, seed)
        assert got.tolist() == [xxhash.xxh64_intdigest(data[s : s + n].tobytes(), seed) for s, n in zip(start, size, strict=True)]
    assert len(_text.xxh64(data, start[:0], start[:0])) == 0
