"""Quality classifier: a linear-chain conditional random field over lines.

Every line with a word is a node with a state, bad or good; its emission reads
features of the line itself and of the lines before and after, transitions tie
neighbouring states.  Only documents are labelled, so the states of lines are
latent: training maximises the likelihood that all lines of a good document are
good and at least one of a bad one is not (see ``fit``), and a document can hold
lines of both kinds.  For a document, forward-backward gives each
line's marginal of being good; the marginals' mean, weighted by line length, is
mapped to a score by a logistic calibration learnt on the same sample.

The model is fitted in numpy on at most ``per_class`` documents of each label
(least hash of the id first) of at most ``max_bytes`` bytes; both bounds are
parameters.  Only the line features of that sample reach the driver.  Scoring
is a per-document Arrow map with a model of a few hundred numbers and reads
whole texts.

Nulls: a null text is the empty text, which has no lines and gets the training
prior as its score; a null id or label never takes part in training.  Without
training rows of both labels every score is the prior (0.5 without any).
Empty table: empty result.  Repeated rows are scored each.  Columns other than
the id and the text are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._text import Hasher, byte_table, chunks, lines, owner, ranges, repeated, runs, word_table

N_OWN = 14


def line_features(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features, text index, length in bytes) of every line with a word."""
    is_word = word_table()[buf]
    ws, we = runs(is_word, offs)
    ls, le, _ = lines(buf, offs)
    w0, w1 = np.searchsorted(ws, ls), np.searchsorted(ws, le)
    keep = w1 > w0
    ls, le, w0, w1 = ls[keep], le[keep], w0[keep], w1[keep]
    ld = owner(ls, offs)
    n_bytes, n_words = (le - ls).astype(float), (w1 - w0).astype(float)

    def share(table, of):
        c = np.concatenate([[0], np.cumsum(table[buf], dtype=np.int64)])
        return (c[le] - c[ls]) / of

    upper, lower = byte_table(bytes(range(65, 91))), byte_table(bytes(range(97, 123)) + bytes(range(128, 256)))
    h = Hasher(buf)
    wh = h(ws, we)
    wl = (we - ws).astype(float)
    # per word: equals the one before; is one symbol; ends in a symbol; seen among the last 8
    before = np.zeros(len(ws), bool)
    before[1:] = wh[1:] == wh[:-1]
    recent = before.copy()
    for k in range(2, 9):
        recent[k:] |= wh[k:] == wh[:-k]
    symbol = byte_table(b"#*$%&|<>@^~_=+\\/")
    last = buf[we - 1]
    one = (we - ws == 1) & symbol[last]
    tail = (we - ws > 1) & (symbol[last] | (last == 33))

    def per_word(v):
        c = np.concatenate([[0.0], np.cumsum(v, dtype=float)])
        return (c[w1] - c[w0]) / n_words

    letters = share(upper | lower, n_bytes)
    own = np.stack(
        [
            np.log1p(n_words) / 3,
            per_word(wl) / 10,
            share(upper, n_bytes) / np.maximum(letters, 0.05),
            letters,
            share(byte_table(b"0123456789"), n_bytes),
            share(symbol, n_bytes),
            share(byte_table(b"!?"), n_bytes),
            share(byte_table(b".,;:"), n_bytes),
            per_word(before),
            per_word(recent),
            per_word(one),
            per_word(tail),
            repeated([ld, h(ls, le)]).astype(float),
            np.isin(buf[le - 1], list(b".!?:;\"'")).astype(float),
        ],
        axis=1,
    ) if len(ls) else np.zeros((0, N_OWN))
    return own.astype(np.float32), ld, le - ls


def with_neighbours(own: np.ndarray, ld: np.ndarray) -> np.ndarray:
    """Own features, those of the previous and the next line of the same text
    (zeros where there is none), and two flags for the ends."""
    n = len(ld)
    prev, nxt = np.zeros_like(own), np.zeros_like(own)
    first, last = np.ones(n, bool), np.ones(n, bool)
    if n > 1:
        same = ld[1:] == ld[:-1]
        first[1:], last[:-1] = ~same, ~same
        prev[1:][same] = own[:-1][same]
        nxt[:-1][same] = own[1:][same]
    return np.concatenate([own, prev, nxt, first[:, None], last[:, None]], axis=1)


def _pack(ld: np.ndarray):
    """Lines laid out by step: chains sorted by length, longest first, so that
    step t holds the first ``active[t]`` chains.  Returns (chain starts in that
    order, chain lengths)."""
    start = np.flatnonzero(np.concatenate([[True], ld[1:] != ld[:-1]])) if len(ld) else np.zeros(0, np.int64)
    length = np.diff(np.concatenate([start, [len(ld)]]))
    order = np.argsort(-length, kind="stable")
    return start[order], length[order]


def forward_backward(e: np.ndarray, ld: np.ndarray, t: np.ndarray, s0: float):
    """Log-odds of the forward and of the backward messages for every line.

    Two states need only the difference of their log messages.  ``e``: emission
    log-odds of good; ``t``: 2x2 transition scores, from row to column; ``s0``:
    start log-odds.
    """
    fwd, bwd = np.zeros(len(e)), np.zeros(len(e))
    start, length = _pack(ld)
    if len(start) == 0:
        return fwd, bwd
    steps = int(length[0])
    active = np.searchsorted(-length, -np.arange(steps), "left")
    a = e[start] + s0
    fwd[start] = a
    for k in range(1, steps):
        at = start[: active[k]] + k
        a = a[: active[k]]
        a = e[at] + np.logaddexp(a + t[1, 1], t[0, 1]) - np.logaddexp(a + t[1, 0], t[0, 0])
        fwd[at] = a
    for k in range(steps - 2, -1, -1):
        at = start[: active[k + 1]] + k
        m = e[at + 1] + bwd[at + 1]
        bwd[at] = np.logaddexp(m + t[1, 1], t[1, 0]) - np.logaddexp(m + t[0, 1], t[0, 0])
    return fwd, bwd


def _sigmoid(x):
    return 0.5 * (1 + np.tanh(0.5 * x))


@dataclass
class LineCrf:
    """Weights of a fitted field; see ``fit``."""

    mean: np.ndarray
    scale: np.ndarray
    w: np.ndarray
    bias: float
    trans: np.ndarray
    start: float
    calib: tuple[float, float]
    prior: float

    def marginals(self, own: np.ndarray, ld: np.ndarray) -> np.ndarray:
        e = ((with_neighbours(own, ld) - self.mean) / self.scale) @ self.w + self.bias
        fwd, bwd = forward_backward(e, ld, self.trans, self.start)
        return _sigmoid(fwd + bwd)

    def raw(self, own: np.ndarray, ld: np.ndarray, weight: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Length-weighted mean marginal per text, and which texts have lines."""
        total = np.bincount(ld, weights=weight, minlength=n)
        good = np.bincount(ld, weights=weight * self.marginals(own, ld), minlength=n)
        return good / np.maximum(total, 1), total > 0

    def scores(self, own: np.ndarray, ld: np.ndarray, weight: np.ndarray, n: int) -> np.ndarray:
        raw, some = self.raw(own, ld, weight, n)
        return np.where(some, _sigmoid(self.calib[0] * _logit(raw) + self.calib[1]), self.prior)


def _logit(p):
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


def constant(prior: float) -> LineCrf:
    n = 3 * N_OWN + 2
    return LineCrf(np.zeros(n), np.ones(n), np.zeros(n), 0.0, np.zeros((2, 2)), 0.0, (0.0, float(_logit(prior))), prior)


def all_good(e: np.ndarray, bwd: np.ndarray, fwd: np.ndarray, ld: np.ndarray, t: np.ndarray, n: int) -> np.ndarray:
    """Log-probability that every line of a chain is good: the first line's
    marginal times the chances to stay good."""
    step = -np.logaddexp(0, -(fwd + bwd))
    follows = np.flatnonzero(ld[1:] == ld[:-1]) + 1
    step[follows] = -np.logaddexp(0, -(e[follows] + bwd[follows] + t[1, 1] - t[1, 0]))
    return np.bincount(ld, weights=step, minlength=n)


def fit(chains: list[tuple[np.ndarray, np.ndarray, int]], prior: float, steps: int = 400, latent: int = 300, l2: float = 1e-3, rate: float = 0.1) -> LineCrf:
    """Fit on ``chains`` of (own features, line lengths, label) by full-batch
    Adam, classes weighted alike.

    Only documents are labelled, so the states of lines are latent.  The first
    steps take every line for its document's label; the last ``latent`` ones
    maximise the likelihood of what a label says: all lines of a good document are
    good, at least one of a bad one is not.  With q the probability that all are
    good, the gradient of log(1 - q) is -q / (1 - q) times that of log(q), and both
    come from one forward-backward pass.
    """
    chains = [c for c in chains if len(c[0])]
    y_doc = np.array([c[2] for c in chains])
    if len(chains) == 0 or y_doc.min() == y_doc.max():
        return constant(prior)
    own = np.concatenate([c[0] for c in chains])
    size = np.array([len(c[0]) for c in chains])
    ld = np.repeat(np.arange(len(chains)), size)
    weight = np.concatenate([c[1] for c in chains]).astype(float)
    x = with_neighbours(own, ld).astype(float)
    mean, scale = x.mean(0), x.std(0) + 1e-3
    x = (x - mean) / scale
    y = np.repeat(y_doc, size).astype(float)
    # each chain counts alike within its class, both classes together alike
    cw = np.where(y_doc == 1, 0.5 / max((y_doc == 1).sum(), 1), 0.5 / max((y_doc == 0).sum(), 1)) / size
    full = np.repeat(cw, size)
    pair = np.flatnonzero(ld[1:] == ld[:-1])
    theta = np.zeros(x.shape[1] + 1 + 4 + 1)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    d = x.shape[1]
    for step in range(1, steps + 1):
        w, bias, t, s0 = theta[:d], theta[d], theta[d + 1 : d + 5].reshape(2, 2), theta[-1]
        e = x @ w + bias
        fwd, bwd = forward_backward(e, ld, t, s0)
        p = _sigmoid(fwd + bwd)
        aim, lw = y, full
        if step > steps - latent:
            q = np.minimum(all_good(e, bwd, fwd, ld, t, len(chains)), -1e-3)
            pull = np.where(y_doc == 1, 1.0, -np.exp(q) / -np.expm1(q))
            aim, lw = np.ones_like(y), full * pull[ld]
        g_e = (aim - p) * lw
        g = np.zeros_like(theta)
        g[:d] = x.T @ g_e - l2 * w
        g[d] = g_e.sum()
        if len(pair):
            # joint of neighbours from the forward message left and emission + backward right
            r = e[pair + 1] + bwd[pair + 1]
            s = np.stack([np.zeros(len(pair)) + t[0, 0], r + t[0, 1], fwd[pair] + t[1, 0], fwd[pair] + r + t[1, 1]])
            s = np.exp(s - s.max(0))
            s /= s.sum(0)
            yy = (2 * aim[pair] + aim[pair + 1]).astype(int)
            seen = np.bincount(yy, weights=lw[pair], minlength=4)
            g[d + 1 : d + 5] = seen - (s * lw[pair]).sum(1) - l2 * theta[d + 1 : d + 5]
        first = np.concatenate([[True], ld[1:] != ld[:-1]])
        g[-1] = g_e[first].sum() - l2 * s0
        m = 0.9 * m + 0.1 * g
        v = 0.99 * v + 0.01 * g * g
        theta = theta + rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    model = LineCrf(mean, scale, theta[:d].copy(), float(theta[d]), theta[d + 1 : d + 5].reshape(2, 2).copy(), float(theta[-1]), (1.0, 0.0), prior)
    # logistic calibration of the aggregated logit; classes in their own shares
    raw, _ = model.raw(own, ld, weight, len(chains))
    z = _logit(raw)
    cw = np.where(y_doc == 1, prior / max((y_doc == 1).sum(), 1), (1 - prior) / max((y_doc == 0).sum(), 1))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = _sigmoid(a * z + b)
        r = cw * p * (1 - p)
        g = np.array([(cw * (y_doc - p) * z).sum() - 1e-3 * (a - 1), (cw * (y_doc - p)).sum() - 1e-3 * b])
        hess = np.array([[(r * z * z).sum() + 1e-3, (r * z).sum()], [(r * z).sum(), r.sum() + 1e-3]])
        step = np.linalg.solve(hess, g)
        a, b = a + step[0], b + step[1]
    model.calib = (float(max(a, 0.05)), float(b))
    return model


def training_sample(docs: DataFrame, labels: DataFrame, label: str, usable: Column, per_class: int, max_bytes: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, label, text) of at most ``per_class`` labelled documents of each
    class, those with the least hash of the id first.

    The chosen ids are at most 2 * ``per_class`` rows and are broadcast.
    """
    ids = labels.where(usable & F.col(doc_id).isNotNull() & F.col(label).isin(0, 1)).select(doc_id, F.col(label).cast("int").alias("label"))
    ids = ids.groupBy(doc_id).agg(F.min("label").alias("label"))
    h = F.xxhash64(F.col(doc_id))
    some = [ids.where(F.col("label") == k).orderBy(h, doc_id).limit(per_class) for k in (0, 1)]
    picked = some[0].unionByName(some[1])
    small = docs.select(doc_id, F.coalesce(F.col(text), F.lit("")).alias("text")).where(F.octet_length("text") <= max_bytes)
    return small.join(F.broadcast(picked), doc_id).select(doc_id, "label", "text")


def class_share(labels: DataFrame, label: str, usable: Column) -> float:
    """Share of label 1 among the usable labels, smoothed."""
    n, one = labels.where(usable & F.col(label).isin(0, 1)).agg(F.count(F.lit(1)), F.sum(label)).first()
    return ((one or 0) + 1) / (n + 2)


def train(docs: DataFrame, labels: DataFrame, label: str, usable: Column, per_class: int = 2000, max_bytes: int = 1 << 15, doc_id: str = "doc_id", text: str = "text") -> LineCrf:
    """Fit on a bounded sample of the labelled documents."""
    sample = training_sample(docs, labels, label, usable, per_class, max_bytes, doc_id, text)

    def featurise(batches):
        for batch, buf, offs in chunks(batches):
            own, ld, size = line_features(buf, offs)
            at = np.searchsorted(ld, np.arange(len(offs)))
            y = batch.column(1).to_pylist()
            yield pa.RecordBatch.from_pydict({
                "id": batch.column(0).cast(pa.string()), "y": pa.array(y, pa.int32()),
                "x": pa.array([own[at[i] : at[i + 1]].tobytes() for i in range(len(y))], pa.binary()),
                "n": pa.array([size[at[i] : at[i + 1]].astype(np.int32).tobytes() for i in range(len(y))], pa.binary()),
            })

    rows = sorted((r.id, r.y, bytes(r.x), bytes(r.n)) for r in sample.mapInArrow(featurise, "id string, y int, x binary, n binary").collect())
    chains = [(np.frombuffer(x, np.float32).reshape(-1, N_OWN), np.frombuffer(n, np.int32), y) for _, y, x, n in rows]
    return fit(chains, class_share(labels, label, usable))


def score(docs: DataFrame, model: LineCrf, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, score) of every document."""
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches):
        for batch, buf, offs in chunks(batches):
            own, ld, size = line_features(buf, offs)
            s = model.scores(own, ld, size.astype(float), len(offs) - 1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s)], [doc_id, "score"])

    return docs.select(doc_id, F.col(text).alias("text")).mapInArrow(run, f"{doc_id} {kind}, score double")


def keep_good(docs: DataFrame, model: LineCrf, threshold: float, text: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text scores ``threshold`` or more, in one map
    over the documents."""
    schema = docs.schema

    def run(batches):
        for batch, buf, offs in chunks(batches, text):
            own, ld, size = line_features(buf, offs)
            yield batch.filter(pa.array(model.scores(own, ld, size.astype(float), len(offs) - 1) >= threshold))

    return docs.mapInArrow(run, schema)


def line_labels(docs: DataFrame, model: LineCrf, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, line, start, end, good, marginal): one row per line with a word;
    ``line`` counts those lines from 0, start and end are byte offsets."""
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches):
        for batch, buf, offs in chunks(batches):
            own, ld, size = line_features(buf, offs)
            p = model.marginals(own, ld)
            ls, le, _ = lines(buf, offs)
            ws, _ = runs(word_table()[buf], offs)
            keep = np.searchsorted(ws, le) > np.searchsorted(ws, ls)
            first = np.searchsorted(ld, np.arange(len(offs)))
            at = ranges(np.zeros(len(offs) - 1, np.int64), np.diff(first))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(ld)), pa.array(at), pa.array(ls[keep] - offs[ld]), pa.array(le[keep] - offs[ld]), pa.array(p >= 0.5), pa.array(p)],
                [doc_id, "line", "start", "end", "good", "marginal"],
            )

    return docs.select(doc_id, F.col(text).alias("text")).mapInArrow(run, f"{doc_id} {kind}, line long, start long, end long, good boolean, marginal double")
