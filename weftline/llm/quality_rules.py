"""Quality rules: hashed n-gram log-likelihood ratio between a trusted target
and the raw corpus.

Word unigrams and bigrams are hashed into ``n_buckets``.  One multinomial is
estimated over all documents, and one over each half of the trusted ones (by a
hash of the id), smoothed with ``share`` of its own size from the raw
distribution.  A document's ratio is the sum of log(target/raw) over its n-grams
divided by their number, averaged over both halves.

The threshold comes from the trusted documents: each is scored by the half that
it is not in, as an unseen clean document would be, and the ``quantile`` of these
scores, less its distance from their median over the root of their number, is the
level.  ``llr`` is measured from it, and a document is kept if its base rules hold
and ``llr`` reaches ``threshold`` (0).  Smoothing and level follow the trusted set,
so that the rule is as strict on a small one as on a large one; the verdict on a
text depends on nothing but the three multinomials and the level.

Base rules read the whole text: see ``FIELDS`` for the counts.  All passes are
per-document Arrow maps; what meets in between is one row per bucket and task,
summed by Spark into a table of ``n_buckets`` rows, and a histogram of the trusted
scores in thousandths, the only things the driver sees; it sends out the ratios
(1 MB, whatever the input).

Nulls: a null text has no words (all counts 0) and fails the base rules; a null
id stands for an untrusted document.  Without trusted documents in both halves
every ratio is 0 and the base rules alone decide.  Empty table: empty result.
Repeated rows count and are returned each.  Further columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._spark import sized_join
from ._text import BASE, U64, Hasher, chunks, later_equal, lines, mix, owner, repeated, runs, word_table

SYMBOLS = b"#*$%&|<>"
WINDOW = 8
#: Smoothing as a share of the trusted n-grams; share of unseen trusted documents
#: that may fall below the level; least score, measured from the level.
SHARE, QUANTILE, THRESHOLD = 0.03, 0.001, 0.0
FIELDS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def base_counts(buf: np.ndarray, offs: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray]:
    """The counts of FIELDS per text, and the hash and text of every word.

    word_chars: code points in words.  n_dup_lines: \\n-split lines with a word
    that equal an earlier line of the text.  n_repeat_words: words inside an
    8-word window that occurs at least twice in the text.
    """
    n = len(offs) - 1
    table = word_table()
    is_word = table[buf]
    ws, we = runs(is_word, offs)
    wd = owner(ws, offs)
    h = Hasher(buf)
    count = lambda pos: np.bincount(owner(pos, offs), minlength=n)
    symbol = np.zeros(256, bool)
    symbol[list(SYMBOLS)] = True
    out = {
        "n_words": np.bincount(wd, minlength=n),
        "word_chars": count(np.flatnonzero(is_word & ((buf & 0xC0) != 0x80))),
        "n_symbols": count(np.flatnonzero(symbol[buf])),
    }
    ls, le, _ = lines(buf, offs)
    with_word = np.searchsorted(ws, le) > np.searchsorted(ws, ls)
    ls, le = ls[with_word], le[with_word]
    ld = owner(ls, offs)
    dup = later_equal([ld, h(ls, le)])
    out["n_dup_lines"] = np.bincount(ld[dup], minlength=n)
    wh = h(ws, we)
    m = len(wh) - WINDOW + 1
    covered = np.zeros(len(wh) + 1, np.int64)
    if m > 0:
        at = np.flatnonzero(wd[:m] == wd[WINDOW - 1 :])
        acc = np.zeros(len(at), U64)
        for k in range(WINDOW):
            acc = acc * BASE + wh[at + k]
        hit = at[repeated([wd[at], mix(acc)])]
        np.add.at(covered, hit, 1)
        np.add.at(covered, hit + WINDOW, -1)
    inside = np.cumsum(covered[:-1]) > 0
    out["n_repeat_words"] = np.bincount(wd[inside], minlength=n)
    return out, wh, wd


def ngram_buckets(wh: np.ndarray, wd: np.ndarray, n_buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and text of every unigram and bigram."""
    if len(wh) == 0:
        return np.zeros(0, np.int64), wd
    pair = np.flatnonzero(wd[1:] == wd[:-1])
    two = mix(wh[pair] * BASE + wh[pair + 1])
    both = np.concatenate([wh, two]) % U64(n_buckets)
    return both.astype(np.int64), np.concatenate([wd, wd[pair]])


def half(doc_id: str) -> Column:
    """0 or 1: the half of the trusted set that a document falls in."""
    return (F.crc32(F.col(doc_id).cast("string")) % 2).cast("int")


def multinomials(docs: DataFrame, trusted: DataFrame, n_buckets: int, doc_id: str = "doc_id", text: str = "text", halves: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Bucket counts over all documents and over the trusted ones, with ``halves``
    as one row for each half of them.

    ``trusted``: a table of ids in column ``doc_id``.
    """
    ids = trusted.select(F.col(doc_id)).where(F.col(doc_id).isNotNull()).distinct().withColumn("__t", half(doc_id))
    marked = sized_join(docs.select(doc_id, text), ids, doc_id, "left").select(F.col(text).alias("text"), F.coalesce("__t", F.lit(-1)).alias("t"))

    def count(batches):
        raw, target = np.zeros(n_buckets, np.int64), np.zeros((2, n_buckets), np.int64)
        for batch, buf, offs in chunks(batches):
            ws, we = runs(word_table()[buf], offs)
            b, d = ngram_buckets(Hasher(buf)(ws, we), owner(ws, offs), n_buckets)
            raw += np.bincount(b, minlength=n_buckets)
            t = batch.column(batch.schema.get_field_index("t")).to_numpy(zero_copy_only=False)
            for k in (0, 1):
                target[k] += np.bincount(b[t[d] == k], minlength=n_buckets)
        at = np.flatnonzero(raw)
        yield pa.RecordBatch.from_pydict({"b": at.astype(np.int64), "raw": raw[at], "one": target[0, at], "two": target[1, at]})

    rows = marked.mapInArrow(count, "b long, raw long, one long, two long").groupBy("b").agg(F.sum("raw"), F.sum("one"), F.sum("two")).collect()
    raw, target = np.zeros(n_buckets), np.zeros((2, n_buckets))
    for b, r, one, two in rows:
        raw[b], target[:, b] = r, (one, two)
    return raw, target if halves else target.sum(axis=0)


def log_ratio(raw: np.ndarray, target: np.ndarray, alpha: float) -> np.ndarray:
    """log(target/raw) per bucket, both smoothed by ``alpha`` counts spread in
    proportion to the raw distribution (uniform where that is empty)."""
    p = (raw + 1.0) / (raw.sum() + len(raw))
    q = (target + alpha * p) / (target.sum() + alpha)
    return np.log(q) - np.log(p)


def ratios(raw: np.ndarray, target: np.ndarray, share: float) -> np.ndarray:
    """The log-ratio of each half, zeros if one of them is empty."""
    size = target.sum(axis=1)
    if size.min() == 0:
        return np.zeros_like(target)
    return np.stack([log_ratio(raw, t, share * n) for t, n in zip(target, size, strict=True)])


def _judged(batches, ratio: np.ndarray, min_words: int, max_repeat_percent: int):
    """(batch, counts, failed, llr of each half) of chunks of documents."""
    n_buckets = ratio.shape[1]
    for batch, buf, offs in chunks(batches):
        base, wh, wd = base_counts(buf, offs)
        b, d = ngram_buckets(wh, wd, n_buckets)
        n = len(offs) - 1
        grams = np.maximum(np.bincount(d, minlength=n), 1)
        llr = np.stack([np.bincount(d, weights=r[b], minlength=n) / grams for r in ratio])
        failed = (base["n_words"] < min_words) | (100 * base["n_repeat_words"] > max_repeat_percent * base["n_words"])
        yield batch, base, failed, llr


def level(docs: DataFrame, trusted: DataFrame, ratio: np.ndarray, quantile: float, min_words: int = 20, max_repeat_percent: int = 30, doc_id: str = "doc_id", text: str = "text") -> float:
    """Score that unseen clean documents reach: see the module's text."""
    ids = trusted.select(F.col(doc_id)).where(F.col(doc_id).isNotNull()).distinct().withColumn("__t", half(doc_id))
    shared = docs.sparkSession.sparkContext.broadcast(ratio)
    marked = sized_join(docs.select(doc_id, text), ids, doc_id, "inner").select(F.col("__t").alias("t"), F.col(text).alias("text"))

    def run(batches):
        seen: dict[int, int] = {}
        for batch, _, failed, llr in _judged(batches, shared.value, min_words, max_repeat_percent):
            t = batch.column(0).to_numpy(zero_copy_only=False)
            unseen = np.floor(llr[1 - t, np.arange(len(t))][~failed] * 1000).astype(np.int64)
            for v, n in zip(*np.unique(unseen, return_counts=True), strict=True):
                seen[int(v)] = seen.get(int(v), 0) + int(n)
        yield pa.RecordBatch.from_pydict({"v": pa.array(list(seen), pa.int64()), "n": pa.array(list(seen.values()), pa.int64())})

    rows = sorted((r[0], r[1]) for r in marked.mapInArrow(run, "v long, n long").groupBy("v").agg(F.sum("n")).collect())
    if not rows:
        return 0.0
    value, upto = np.array([v for v, _ in rows]) / 1000, np.cumsum([n for _, n in rows])
    low, middle = (value[np.searchsorted(upto, q * (upto[-1] - 1), "right")] for q in (quantile, 0.5))
    return float(low - (middle - low) / np.sqrt(upto[-1]))


def score(docs: DataFrame, ratio: np.ndarray, at: float, threshold: float, min_words: int = 20, max_repeat_percent: int = 30, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Counts, base_failed, llr (measured from ``at``) and kept for every document."""
    shared = docs.sparkSession.sparkContext.broadcast(ratio)
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches):
        for batch, base, failed, llr in _judged(batches, shared.value, min_words, max_repeat_percent):
            own = llr.mean(axis=0) - at
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(base[f].astype(np.int64)) for f in FIELDS], pa.array(failed), pa.array(own), pa.array(~failed & (own >= threshold))],
                [doc_id, *FIELDS, "base_failed", "llr", "kept"],
            )

    counts = ", ".join(f"{f} long" for f in FIELDS)
    return docs.select(doc_id, F.col(text).alias("text")).mapInArrow(run, f"{doc_id} {kind}, {counts}, base_failed boolean, llr double, kept boolean")


def quality_rules(docs: DataFrame, trusted: DataFrame, n_buckets: int = 1 << 16, share: float = SHARE, quantile: float = QUANTILE, threshold: float = THRESHOLD, **names) -> DataFrame:
    """The whole operator: estimate the multinomials and the level, then judge
    every document."""
    raw, target = multinomials(docs, trusted, n_buckets, **names, halves=True)
    ratio = ratios(raw, target, share)
    at = level(docs, trusted, ratio, quantile, **names) if ratio.any() else 0.0
    return score(docs, ratio, at, threshold, **names)
