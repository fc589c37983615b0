"""Toxicity: a bidirectional gated recurrent network with attention pooling.

Every word enters as two vectors side by side: a word embedding (of its letters,
A-Z lower-cased; words outside the learnt vocabulary share one entry) and a
character vector (mean of the embeddings of its letters' hashed trigrams).  A
window of ``window`` words runs through a GRU in both directions; attention
pools the steps and a logistic unit gives the window's logit.  Windows start
every ``stride`` words and cover the whole text.  A text's score is logistic in its
largest window logit, the largest among windows that share no word with that
one, and the logarithm of its number of windows, which is learnt on a quarter of
the sample that the network does not see: a passage counts wherever it stands,
and one odd window weighs less in a long text.

Training (numpy, full back-propagation through time) takes documents as bags of
windows: each round scores all windows of the sample and learns from each
document's largest and one drawn at random (the largest is looked up anew every
few rounds).  One entry of each word's and trigram's vector is fixed: its smoothed
log-odds between the classes; in training those that the other half of the sample
gives, so that a word of a few documents does not give their labels away.  The sample is at most
``per_class`` documents of each label (least hash of the id first) of at most
``max_bytes`` bytes; both bounds are parameters.  Scoring is a per-document
Arrow map over whole texts with a model of fixed size.

Nulls: a null text is the empty text; a text without words is scored as one
window without words, by the bias alone.  A null id or label never takes part
in training; without both classes every score is the prior.  Empty table: empty
result.  Repeated rows are scored each.  Columns other than the id and the text
are not read.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._text import BASE, U64, chunks, mix, powers, ranges, words
from .line_crf import class_share, training_sample

F32 = np.float32
N_GRAMS = 4096
#: Second logit of texts without a second, separate window.
LOWEST = -5.0


def letter_words(buf: np.ndarray, offs: np.ndarray):
    """(hash of the letters, first byte, last byte, text) of every word.

    Letters are A-Z (lower-cased), a-z and all bytes from 128; a word without
    letters has hash 0.
    """
    ws, we, wd = words(buf, offs)
    low = np.where((buf >= 65) & (buf <= 90), buf + 32, buf)
    keep = ((low >= 97) & (low <= 122)) | (low >= 128)
    rank = np.concatenate([[0], np.cumsum(keep)])
    pw, inv = powers(len(buf))
    c = np.zeros(len(buf) + 1, U64)
    np.cumsum(np.where(keep, (low.astype(U64) + U64(1)) * pw[rank[:-1]], U64(0)), out=c[1:])
    n = rank[we] - rank[ws]
    h = mix((c[we] - c[ws]) * inv[rank[ws]] + n.astype(U64))
    return np.where(n > 0, h, U64(0)), ws, we, wd


def trigram_ids(buf: np.ndarray, ws: np.ndarray, we: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed trigram buckets of the given words and where each word's begin.

    The trigrams are those of the word's letters with a blank before and after,
    so they depend on what the word's hash depends on; a word without letters
    has one trigram of its own.
    """
    low = np.where((buf >= 65) & (buf <= 90), buf + 32, buf).astype(np.int64)
    at = ranges(ws, we - ws)
    letter = ((low[at] >= 97) & (low[at] <= 122)) | (low[at] >= 128)
    word = np.repeat(np.arange(len(ws)), we - ws)[letter]
    n = np.bincount(word, minlength=len(ws))
    none = np.flatnonzero(n == 0)
    mid = np.insert(low[at[letter]], (np.cumsum(n) - n)[none], 0)
    n = np.maximum(n, 1)
    starts = np.cumsum(n) - n
    left, right = np.full(len(mid), 32), np.full(len(mid), 32)
    left[1:], right[:-1] = mid[:-1], mid[1:]
    left[starts] = 32
    right[starts + n - 1] = 32
    code = ((left << 16) | (mid << 8) | right).astype(U64)
    return (mix(code + U64(1)) % U64(N_GRAMS)).astype(np.int64), starts


def sigmoid(x):
    return F32(0.5) * (np.tanh(F32(0.5) * x) + F32(1))


@dataclass
class BiGru:
    """Parameters ``p`` and the sorted hashes of the vocabulary (entry i + 1)."""

    vocab: np.ndarray
    p: dict[str, np.ndarray]
    hidden: int
    window: int
    stride: int
    prior: float = 0.5
    trained: bool = True
    scale: np.ndarray = field(default_factory=lambda: np.array([1.0, 0, 0, 0]))

    def inputs(self, buf: np.ndarray, offs: np.ndarray):
        """Distinct words of a chunk: (vocabulary entry, trigram ids, trigram
        starts), the distinct word of every word, and the words' texts."""
        h, ws, we, wd = letter_words(buf, offs)
        _, first, inverse = np.unique(h, return_index=True, return_inverse=True)
        hu = h[first]
        e = np.searchsorted(self.vocab, hu)
        e = np.where((e < len(self.vocab)) & (self.vocab[np.minimum(e, len(self.vocab) - 1)] == hu), e + 1, 0) if len(self.vocab) else np.zeros(len(hu), np.int64)
        ids, starts = trigram_ids(buf, ws[first], we[first])
        return e, ids, starts, inverse, wd

    def vectors(self, e, ids, starts):
        """Input vectors of distinct words, with a row of zeros at the end."""
        p = self.p
        d = p["char"].shape[1]
        size = np.diff(np.concatenate([starts, [len(ids)]]))
        chars = np.add.reduceat(p["char"][ids], starts, axis=0) / size[:, None] if len(starts) else np.zeros((0, d))
        x = np.concatenate([p["word"][e], chars], axis=1).astype(F32)
        return np.concatenate([x, np.zeros((1, x.shape[1]), F32)])

    def windows(self, wd: np.ndarray, n: int):
        """(first word, number of words, text) of every window; texts without
        words have one of length 0."""
        per = np.bincount(wd, minlength=n)
        begin = np.concatenate([[0], np.cumsum(per)])[:-1]
        count = np.maximum(1, -(-(per - self.window) // self.stride) + 1)
        doc = np.repeat(np.arange(n), count)
        k = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
        start = k * self.stride
        return begin[doc] + start, np.clip(per[doc] - start, 0, self.window), doc

    def forward(self, x: np.ndarray, index: np.ndarray, length: np.ndarray, keep: bool = False):
        """Logits of windows given as rows of word indexes into ``x``; cells at
        or after ``length`` are the last row of ``x`` and leave the state."""
        p, hd = self.p, self.hidden
        n, t = index.shape
        outs, cache = [], []
        for side in ("f", "b"):
            gate = x @ p["w" + side] + p["c" + side]
            h = np.zeros((n, hd), F32)
            hs = np.empty((t, n, hd), F32)
            steps = range(t) if side == "f" else range(t - 1, -1, -1)
            mem = {}
            u = p["u" + side]
            for k in steps:
                g = gate[index[:, k]]
                a = h @ u[:, : 2 * hd]
                zr = sigmoid(g[:, : 2 * hd] + a)
                z, r = zr[:, :hd], zr[:, hd:]
                rh = r * h
                c = np.tanh(g[:, 2 * hd :] + rh @ u[:, 2 * hd :])
                live = (k < length)[:, None]
                new = np.where(live, h + z * (c - h), h)
                if keep:
                    mem[k] = (h, z, r, c, live)
                h = new
                hs[k] = h
            outs.append(hs)
            cache.append(mem)
        hcat = np.concatenate(outs, axis=2)
        score = np.tanh(hcat @ p["a"]) @ p["v"]
        score = np.where(np.arange(t)[:, None] < length[None, :], score, F32(-1e9))
        att = np.exp(score - score.max(0))
        att /= att.sum(0)
        att = att * (length > 0)
        pooled = np.einsum("tn,tnd->nd", att, hcat)
        logit = pooled @ p["o"] + p["ob"]
        return (logit, (hcat, att, pooled, cache)) if keep else logit

    def backward(self, x, index, length, kept, g_logit):
        """Gradients of the parameters and of ``x``."""
        p, hd = self.p, self.hidden
        hcat, att, pooled, cache = kept
        t, n, _ = hcat.shape
        g = {k: np.zeros_like(v) for k, v in p.items()}
        g["o"] = pooled.T @ g_logit
        g["ob"] = np.array(g_logit.sum(), F32)
        gp = g_logit[:, None] * p["o"]
        gh = att[:, :, None] * gp[None]
        ga = np.einsum("tnd,nd->tn", hcat, gp)
        gs = att * (ga - (att * ga).sum(0))
        th = np.tanh(hcat @ p["a"])
        g["v"] = np.einsum("tnk,tn->k", th, gs)
        gt = gs[:, :, None] * p["v"] * (1 - th * th)
        g["a"] = np.einsum("tnd,tnk->dk", hcat, gt)
        gh = gh + gt @ p["a"].T
        gx = np.zeros_like(x)
        for side, lo in (("f", 0), ("b", hd)):
            u, w, mem = p["u" + side], p["w" + side], cache[0 if side == "f" else 1]
            gg = np.zeros((len(x), 3 * hd), F32)
            dh = np.zeros((n, hd), F32)
            gu = np.zeros_like(u)
            steps = range(t - 1, -1, -1) if side == "f" else range(t)
            for k in steps:
                h, z, r, c, live = mem[k]
                dh = dh + gh[k, :, lo : lo + hd]
                d = dh * live
                dz = d * (c - h) * z * (1 - z)
                dc = d * z * (1 - c * c)
                drh = dc @ u[:, 2 * hd :].T
                dr = drh * h * r * (1 - r)
                da = np.concatenate([dz, dr], axis=1)
                gu[:, : 2 * hd] += h.T @ da
                gu[:, 2 * hd :] += (r * h).T @ dc
                np.add.at(gg, index[:, k], np.concatenate([da, dc], axis=1))
                dh = dh * ~live + d * (1 - z) + drh * r + da @ u[:, : 2 * hd].T
            g["u" + side] = gu
            g["w" + side] = x.T @ gg
            g["c" + side] = gg.sum(0)
            gx += gg @ w.T
        return g, gx

    def window_logits(self, buf: np.ndarray, offs: np.ndarray, block: int = 4096):
        """(logit, text) of every window, in order."""
        e, ids, starts, inverse, wd = self.inputs(buf, offs)
        x = self.vectors(e, ids, starts)
        first, length, doc = self.windows(wd, len(offs) - 1)
        word = np.concatenate([inverse, [len(x) - 1]])
        out = np.empty(len(first))
        for a in range(0, len(first), block):
            index = self.cells(word, first[a : a + block], length[a : a + block])
            out[a : a + block] = self.forward(x, index, length[a : a + block])
        return out, doc

    def features(self, buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """What the score of a text is logistic in, with a column of ones."""
        logit, doc = self.window_logits(buf, offs)
        n = len(offs) - 1
        begin = np.searchsorted(doc, np.arange(n))
        top = np.maximum.reduceat(logit, begin) if n else np.zeros(0)
        at = np.flatnonzero(logit == top[doc])
        best = at[np.searchsorted(doc[at], np.arange(n))]
        reach = -(-self.window // self.stride)
        apart = np.abs(np.arange(len(logit)) - best[doc]) >= reach
        second = np.full(n, -np.inf)
        np.maximum.at(second, doc[apart], logit[apart])
        second = np.maximum(second, np.minimum(top, LOWEST))
        count = np.bincount(doc, minlength=n)
        return np.stack([top, second, np.log(np.maximum(count, 1)), np.ones(n)], axis=1)

    def cells(self, word, first, length):
        k = np.arange(self.window)
        at = np.where(k < length[:, None], first[:, None] + k, len(word) - 1)
        return word[at]

    def scores(self, buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
        if not self.trained:
            return np.full(len(offs) - 1, self.prior)
        return 1 / (1 + np.exp(-np.clip(self.features(buf, offs) @ self.scale, -30, 30)))


def holders(texts: list[bytes], y: np.ndarray) -> tuple[dict[int, np.ndarray], np.ndarray]:
    """Documents of each label that hold a word, by the word's hash, and those that
    hold a trigram bucket."""
    df: dict[int, np.ndarray] = {}
    grams = np.zeros((N_GRAMS, 2))
    for t, label in zip(texts, y, strict=True):
        b = np.frombuffer(t, np.uint8)
        h, ws, we, _ = letter_words(b, np.array([0, len(b)]))
        h, first = np.unique(h, return_index=True)
        for k in h.tolist():
            df.setdefault(k, np.zeros(2))[label] += 1
        grams[np.unique(trigram_ids(b, ws[first], we[first])[0]), label] += 1
    return df, grams


def log_odds(c: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Smoothed log-odds of words held by ``c`` of ``n`` documents of each label; a
    word of few documents says little, however one-sided."""
    raw = np.log((c[..., 1] + 0.5) / (n[1] + 1)) - np.log((c[..., 0] + 0.5) / (n[0] + 1))
    return np.clip(raw * c.sum(-1) / (c.sum(-1) + 4), -4, 4)


def halved_model(texts: list[bytes], y: np.ndarray, hidden: int, window: int, stride: int, dim: int = 6, vocab: int = 8192, least: int = 3):
    """Untrained model whose vocabulary are the words found in ``least`` or more
    sample documents, the most telling ``vocab`` of them; and, for each half of the
    sample (every other document of a label), the log-odds of words and trigrams by
    that half; and the half of each document."""
    place = np.zeros(len(y), int)
    for k in (0, 1):
        place[y == k] = np.arange((y == k).sum()) % 2
    (one, some), (two, more) = (holders([t for t, p in zip(texts, place, strict=True) if p == k], y[place == k]) for k in (0, 1))
    parts, none = (one, two), np.zeros(2)
    df = {h: parts[0].get(h, none) + parts[1].get(h, none) for h in parts[0].keys() | parts[1].keys()}
    n = np.array([np.bincount(y[place == k], minlength=2) for k in (0, 1)])
    known = [h for h in df if h and df[h].sum() >= least]
    odds = dict(zip(known, log_odds(np.array([df[h] for h in known]).reshape(-1, 2), np.maximum(n.sum(0), 1)), strict=True))
    best = sorted(odds, key=lambda h: (-abs(odds[h]) * np.sqrt(df[h].sum()), h))[:vocab]
    keys = np.array(sorted(best), U64)
    by_half = np.zeros((2, len(keys) + 1))
    for k in (0, 1):
        by_half[k, 1:] = log_odds(np.array([parts[k].get(int(h), none) for h in keys]).reshape(-1, 2), np.maximum(n[k], 1))
    grams = [log_odds(c, np.maximum(m, 1)) for c, m in ((some, n[0]), (more, n[1]), (some + more, n.sum(0)))]
    rng = np.random.default_rng(7)
    small = lambda *s: rng.normal(0, 0.1, s).astype(F32)
    wide = lambda *s: (rng.normal(0, 1, s) / np.sqrt(s[0])).astype(F32)
    word = small(len(keys) + 1, dim)
    word[0] = 0
    word[:, 0] = [0, *(odds[int(h)] for h in keys)]
    d = 2 * dim
    char = small(N_GRAMS, dim)
    char[:, 0] = grams[2]
    p = {"word": word, "char": char, "a": wide(2 * hidden, hidden), "v": wide(hidden), "o": wide(2 * hidden), "ob": np.array(0, F32)}
    for s in "fb":
        p |= {"w" + s: wide(d, 3 * hidden), "u" + s: wide(hidden, 3 * hidden), "c" + s: np.zeros(3 * hidden, F32)}
    return BiGru(keys, p, hidden, window, stride), (by_half, grams), place


def start_model(texts: list[bytes], y: np.ndarray, hidden: int, window: int, stride: int, **options) -> BiGru:
    """The untrained model alone."""
    return halved_model(texts, y, hidden, window, stride, **options)[0]


def buffers(texts: list[bytes], size: int = 1 << 20):
    """(bytes, offsets) of the texts in groups of about ``size`` bytes."""
    at = 0
    while at < len(texts):
        to, total = at, 0
        while to < len(texts) and (to == at or total + len(texts[to]) <= size):
            total += len(texts[to])
            to += 1
        yield np.frombuffer(b"".join(texts[at:to]), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts[at:to]])]).astype(np.int64)
        at = to


def sample_inputs(model: BiGru, texts: list[bytes]):
    """``inputs`` of all texts, group by group, so that memory is bounded."""
    z = np.zeros(0, np.int64)
    parts, words, grams, docs = [(z, z, z, z, z)], 0, 0, 0
    for buf, offs in buffers(texts):
        e, ids, starts, inverse, wd = model.inputs(buf, offs)
        parts.append((e.astype(np.int32), ids.astype(np.int32), starts + grams, (inverse + words).astype(np.int32), wd + docs))
        words, grams, docs = words + len(e), grams + len(ids), docs + len(offs) - 1
    return tuple(np.concatenate(c) for c in zip(*parts, strict=True))


def fit(sample: list[tuple[bytes, int]], prior: float, hidden: int = 8, window: int = 32, stride: int = 16, epochs: int = 12, batch: int = 64, rate: float = 0.02, blank: float = 0.4, l2: float = 3e-4, least_steps: int = 80, refresh: int = 3, tables: float = 0.1, seed: int = 11) -> BiGru:
    """Train on (UTF-8 text, label) pairs; every fourth of a class calibrates.

    Each document's largest window is looked up anew every ``refresh`` epochs;
    the tables of words and trigrams learn at ``tables`` of the rate.
    """
    rank = {0: 0, 1: 0}
    held, rest = [], []
    for t, v in sample:
        rank[v] += 1
        (held if rank[v] % 4 == 0 else rest).append((t, v))
    sample = rest
    y = np.array([v for _, v in sample], int)
    model, (by_half, by_grams), place = halved_model([t for t, _ in sample], y, hidden, window, stride)
    # a document's words carry the log-odds that the other half gives them
    order = np.argsort(place, kind="stable")
    sample, y, place = [sample[i] for i in order], y[order], place[order]
    if len(y) == 0 or y.min() == y.max():
        model.trained, model.prior = False, prior
        return model
    rng = np.random.default_rng(seed)
    p = model.p
    m = {k: np.zeros_like(v) for k, v in p.items()}
    v = {k: np.zeros_like(q) for k, q in p.items()}
    sides = [sample_inputs(model, [t for (t, _), k in zip(sample, place, strict=True) if k == side]) for side in (0, 1)]
    own_odds = np.concatenate([by_half[1 - k][x[0]] for k, x in enumerate(sides)]).astype(F32)
    mean_of = lambda odds, ids, starts: np.add.reduceat(odds[ids], starts) / np.diff(np.concatenate([starts, [len(ids)]])) if len(starts) else np.zeros(0)
    own_grams = np.concatenate([mean_of(by_grams[1 - k], x[1], x[2]) for k, x in enumerate(sides)]).astype(F32)
    one, two = sides
    e, ids, starts = np.concatenate([one[0], two[0]]), np.concatenate([one[1], two[1]]), np.concatenate([one[2], two[2] + len(one[1])])
    inverse, wd = np.concatenate([one[3], two[3] + len(one[0])]), np.concatenate([one[4], two[4] + (place == 0).sum()])
    first, length, doc = model.windows(wd, len(y))
    size = np.diff(np.concatenate([starts, [len(ids)]]))
    word = np.concatenate([inverse, [len(e)]])
    begin = np.searchsorted(doc, np.arange(len(y) + 1))
    cw = np.where(y == 1, 0.5 / (y == 1).mean(), 0.5 / (y == 0).mean()).astype(F32)
    slow = {"word": tables, "char": tables}
    step, n_mean, mean = 0, 0, {k: np.zeros_like(q) for k, q in p.items()}
    epochs = max(epochs, least_steps * batch // len(y))
    for epoch in range(epochs):
        if epoch % refresh == 0:
            x = model.vectors(e, ids, starts)
            x[:-1, 0], x[:-1, p["word"].shape[1]] = own_odds, own_grams
            every = np.empty(len(first))
            for a in range(0, len(first), 4096):
                every[a : a + 4096] = model.forward(x, model.cells(word, first[a : a + 4096], length[a : a + 4096]), length[a : a + 4096])
            top = np.array([begin[i] + every[begin[i] : begin[i + 1]].argmax() for i in range(len(y))])
        other = begin[:-1] + (rng.random(len(y)) * np.diff(begin)).astype(int)
        order = rng.permutation(len(y))
        for a in range(0, len(order), batch):
            docs = order[a : a + batch]
            neg = docs[y[docs] == 0]
            pick = np.concatenate([top[docs], other[neg]])
            target, weight = np.concatenate([y[docs], np.zeros(len(neg))]).astype(F32), np.concatenate([cw[docs], 0.5 * cw[neg]])
            cells = model.cells(word, first[pick], length[pick])
            used, local = np.unique(cells, return_inverse=True)
            real = used[used < len(e)]
            # some known words are shown as unknown, so that their letters count
            hidden_words = rng.random(len(p["word"])) < blank
            seen = np.where(hidden_words[e[real]], 0, e[real])
            span = ranges(starts[real], size[real])
            x = model.vectors(seen, ids[span], np.concatenate([[0], np.cumsum(size[real])])[:-1])
            x[: len(real), 0] = np.where(hidden_words[e[real]], 0, own_odds[real])
            x[: len(real), p["word"].shape[1]] = own_grams[real]
            local = local.reshape(cells.shape)
            logit, kept = model.forward(x, local, length[pick], keep=True)
            g, gx = model.backward(x, local, length[pick], kept, ((sigmoid(logit) - target) * weight / len(pick)).astype(F32))
            dim = p["word"].shape[1]
            gx = gx[: len(real)]
            np.add.at(g["word"], seen, gx[:, :dim])
            g["word"][0] = 0
            np.add.at(g["char"], ids[span], np.repeat(gx[:, dim:] / size[real][:, None], size[real], axis=0))
            step += 1
            lr = rate * min(1.0, step / 20) * (1 - 0.8 * epoch / epochs)
            for k in p:
                q = g[k] + F32(l2) * p[k]
                if k in ("word", "char"):  # the log-odds stay
                    q[:, 0] = 0
                m[k] = 0.9 * m[k] + 0.1 * q
                v[k] = 0.99 * v[k] + 0.01 * q * q
                p[k] = (p[k] - lr * slow.get(k, 1.0) * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-7)).astype(F32)
            if epoch >= epochs // 2:  # the mean of the later steps is steadier than the last
                n_mean += 1
                for k in p:
                    mean[k] += (p[k] - mean[k]) / n_mean
    model.p = {k: np.asarray(q, F32) for k, q in mean.items()}
    calibrate(model, held, prior)
    return model


def calibrate(model: BiGru, sample: list[tuple[bytes, int]], prior: float, shy: float = 30.0) -> None:
    """Logistic regression of the label on ``features``, classes in their share
    ``prior`` of the labels.  ``shy`` is the ridge on the number of windows:
    length counts against a text only as far as the sample insists."""
    y = np.array([v for _, v in sample], float)
    if len(y) == 0 or y.min() == y.max():
        return
    x = np.concatenate([model.features(*part) for part in buffers([t for t, _ in sample])])
    cw = np.where(y == 1, prior / y.mean(), (1 - prior) / (1 - y.mean()))
    origin, ridge = np.array([1.0, 0, 0, 0]), np.array([1.0, 1.0, shy, 1e-2])

    def loss(w):
        z = x @ w
        return (cw * (np.logaddexp(0, z) - y * z)).sum() + 0.5 * (ridge * (w - origin) ** 2).sum()

    w, now = origin.copy(), loss(origin)
    for _ in range(100):
        q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (cw * (y - q)) - ridge * (w - origin)
        step = np.linalg.solve((x * (cw * q * (1 - q))[:, None]).T @ x + np.diag(ridge), g)
        while (then := loss(w + step)) > now and np.abs(step).max() > 1e-9:
            step = step / 2
        if now - then < 1e-9:
            break
        w, now = w + step, then
    model.scale = w


def train(docs: DataFrame, labels: DataFrame, label: str, usable: Column, per_class: int = 2000, max_bytes: int = 1 << 14, doc_id: str = "doc_id", text: str = "text", **options) -> BiGru:
    """Fit on a bounded sample: at most 2 * ``per_class`` texts of at most
    ``max_bytes`` bytes reach the driver."""
    rows = training_sample(docs, labels, label, usable, per_class, max_bytes, doc_id, text).collect()
    sample = sorted((str(r[0]), r[1], r[2]) for r in rows)
    return fit([(t.encode(), y) for _, y, t in sample], class_share(labels, label, usable), **options)


def score(docs: DataFrame, model: BiGru, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, score) of every document."""
    kind = docs.schema[doc_id].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        net = shared.value
        for batch, buf, offs in chunks(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(net.scores(buf, offs))], [doc_id, "score"])

    return docs.select(doc_id, F.col(text).alias("text")).mapInArrow(run, f"{doc_id} {kind}, score double")
