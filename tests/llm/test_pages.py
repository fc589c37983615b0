"""Site style trees: importance by brute force, decisions of the tree, awkward pages."""

import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from weftline.llm import queries, site_style

SCHEMA = "page_id long, url string, html string"


def site(rng, host, n, template=0):
    """Pages of one template: a menu of fixed shape, a slot that varies, an article
    of varying shape and, in it, one line that is the same everywhere."""
    word = lambda: rng.choice("abcdefghijklmnop") + str(rng.randint(0, 40))
    out = []
    for k in range(n):
        menu = "".join(f"<li>{word()}</li>" for _ in range(3))
        body = "".join(f"<p>{' '.join(word() for _ in range(rng.randint(1, 30)))}</p>" + ("<ul><li>x</li></ul>" if rng.random() < 0.2 else "") for _ in range(rng.randint(1, 9)))
        strip = "<div class=strip>Always the same</div>"
        main = f"<div class=c{template}>{body}{strip}</div>"
        out.append((f"http://{host}/{k}", f"<html><body><div class=m{template}><ul>{menu}</ul></div><div class=s>{word()} {word()}</div>{main}</body></html>"))
    return out


def corpus():
    rng = random.Random(4)
    pages = site(rng, "a.example", 14) + site(rng, "b.example", 5, 1) + site(rng, "c.example", 1) + site(rng, "A.EXAMPLE", 3)
    pages += [("http://b.example/x", pages[15][1]), ("no url", "<p>alone"), (None, None)]
    return [(k, u, h) for k, (u, h) in enumerate(pages)]


def importance(rows, gamma=0.5, threshold=0.75, prior=4.0):
    """(host, leaf) -> (pages, words, content, presentation, importance, low) by
    plain loops over the parsed pages."""
    hosts = defaultdict(dict)
    for _, url, html in rows:
        host = url.split("/")[2].lower() if url and "://" in url else ""
        p = site_style.parse_page(html or "")
        hosts[host]["\n".join(b[1] for b in p.blocks)] = p

    def contents(pages):
        shown, words = defaultdict(Counter), Counter()
        for p in pages:
            for leaf, text in {(b[0], b[1]) for b in p.blocks}:
                shown[leaf][text] += 1
            for b in p.blocks:
                words[b[0]] += b[2]
        n = {leaf: sum(any(b[0] == leaf for b in p.blocks) for p in pages) for leaf in shown}
        c = {leaf: 1.0 if n[leaf] == 1 else sum(1 - math.log(k) / math.log(n[leaf]) for k in v.values()) / len(v) for leaf, v in shown.items()}
        return n, words, c

    def shapes(pages):
        drawn = defaultdict(Counter)
        for p in pages:
            for node, shape in dict(p.shapes).items():
                drawn[node][shape] += 1
        h = {e: -sum(k / v.total() * math.log(k / v.total()) for k in v.values()) for e, v in drawn.items()}
        most = max(h.values(), default=0)
        return {e: v.total() for e, v in drawn.items()}, {e: x / most if most > 1e-9 else 1.0 for e, x in h.items()}

    settle = lambda own, n, pooled: (own * n + pooled * prior) / (n + prior)
    every = [p for pages in hosts.values() for p in pages.values()]
    pn, _, pc = contents(every)
    qn, qp = shapes(every)
    out = {}
    for host, pages in hosts.items():
        n, words, c = contents(pages.values())
        en, ep = shapes(pages.values())
        p = {e: settle(x, en[e], settle(qp[e], qn[e], 1.0)) for e, x in ep.items()}
        held = {leaf: v for page in pages.values() for leaf, v in page.leaves.items()}
        got = {}
        for leaf in n:
            content = settle(c[leaf], n[leaf], settle(pc[leaf], pn[leaf], 1.0))
            shape = 1.0 if held[leaf][1] == 2 else max([p.get(e, 0.0) for e in held[leaf][0]], default=0.0)
            got[leaf] = (content, shape, gamma * content + (1 - gamma) * shape)
        whole = sum(words[x] * v[2] for x, v in got.items()) / max(sum(words[x] for x in got), 1)
        up = defaultdict(list)
        for leaf in got:
            for e in (*held[leaf][0], leaf):
                up[e].append(leaf)
        branch = {e: sum(words[x] * got[x][2] for x in v) / sum(words[x] for x in v) for e, v in up.items()}
        for leaf, v in got.items():
            out[host, leaf] = (n[leaf], words[leaf], *v, any(branch[e] < threshold * whole for e in (*held[leaf][0], leaf)))
    return out


def test_importance_by_brute_force(spark):
    rows = corpus()
    got = site_style.style_tree(site_style.parse(spark.createDataFrame(rows, SCHEMA))).collect()
    want = importance(rows)
    assert {(r.host, r.leaf) for r in got} == set(want)
    for r in got:
        assert (r.n, r.w, r.content, r.presentation, r.importance) == pytest.approx(want[r.host, r.leaf][:5], abs=1e-9) and r.low == want[r.host, r.leaf][5]


@pytest.mark.parametrize("max_low", [200_000, 0])
def test_the_tree_decides(spark, max_low):
    rows = corpus()
    got = {r.page_id: r for r in site_style.extract(spark.createDataFrame(rows, SCHEMA), max_low=max_low).collect()}
    want = importance(rows)
    for k, url, html in rows:
        host = url.split("/")[2].lower() if url and "://" in url else ""
        page = site_style.parse_page(html or "")
        assert got[k].text == "\n".join(b[1] for b in page.blocks if not want[host, b[0]][5])
        assert got[k].n_tree == sum(want[host, b[0]][5] for b in page.blocks) and got[k].n_listed == got[k].n_outside == 0
    for k in range(14):  # a site of many pages loses its menu, its slot and its strip
        assert got[k].n_tree >= 5 and "Always" not in got[k].text
    assert got[len(rows) - 2].text == "alone" and got[len(rows) - 1].text == ""


def test_the_lists_change_nothing_where_the_tree_speaks(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    with_lists = site_style.extract(pages).select("page_id", "text")
    none = site_style.extract(pages, noise_words=frozenset(), furniture=frozenset())
    assert none.select("page_id", "text").exceptAll(with_lists).count() == 0
    assert none.where("n_tree = 0").count() == 0


def test_comments_and_forms_go_by_name(spark):
    page = "<body><article><h1>T{k}</h1><p>{p}</p><div class='user-comments'><p>c{k} d</p></div><p>e{k} <label>Mail</label><span class=ad>buy</span> f</p></article></body>"
    rows = [(k, "http://x.example/", page.format(k=k, p="</p><p>".join(["w"] * (k % 5 + 1)))) for k in range(9)]
    for r in site_style.extract(spark.createDataFrame(rows, SCHEMA)).collect():
        assert r.text == f"T{r.page_id}\n" + "w\n" * (r.page_id % 5 + 1) + f"e{r.page_id} f" and r.n_listed == 1


AWKWARD = [
    (1, None, None),
    (2, "http://h.example/", ""),
    (None, "http://h.example/a", "<p>no id</p>"),
    (3, "http://h.example/b", "<p>twice</p>"),
    (3, "http://h.example/b", "<p>twice</p>"),
    (4, "::::", "<<<>>> <p a='>' b=\"'\">odd &amp &#x41; &bogus; </p></div></p>"),
    (5, "http://h.example/c", "<div>" * 3000 + "deep" + "</div>" * 3000),
    (6, "http://h.example/d", "<article>" + "<p>word word</p>" * 20_000 + "</article>"),
    (7, "http://h.example/e", "<script>var x = '<p>no</p>'"),
    (8, "http://h.example/f", "é  ü<br>x y<p>\n\t </p><p>z"),
]


def test_awkward_pages(spark):
    df = spark.createDataFrame(AWKWARD, SCHEMA).select("*", *[F.lit("own").alias(c) for c in ("text", "host", "page", "blocks", "low", "leaf", "n_chars", "k")])
    got = site_style.extract(df).collect()
    assert len(got) == len(AWKWARD)
    by = {r.page_id: r.text for r in got}
    assert by[1] == by[2] == by[7] == "" and by[None] == "no id" and by[3] == "twice"
    assert by[5] == "deep" and by[8] == "é ü x y\nz" and by[6].count("\n") == 19_999
    assert by[4] == "<<<>>>\nodd & A &bogus;"
    assert all(r.n_chars == len(r.text) for r in got)
    assert site_style.extract(df.limit(0)).count() == 0


def test_the_query_returns_every_page(spark, sf):
    out = queries.op8_site_style(spark, sf)
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    assert out.select("page_id", "url").exceptAll(pages.select("page_id", "url")).count() == 0 and out.count() == pages.count()
    for r in out.join(pages, "page_id").collect():  # the article's own words, in order
        inside = r.html.split("<article>")[1].split("</article>")[0]
        want = site_style.parse_page(f"<article>{inside}</article>")
        assert r.text == "\n".join(b[1] for b in want.blocks)
