"""Vectorised byte and word primitives over Arrow batches (numpy only).

Texts of a batch are handled as one UTF-8 byte buffer and an offset array.  A
word is a maximal run of bytes outside {0x20, 0x09-0x0D}; all separators are
ASCII, so the byte view and the code point view agree.  A null text counts as
the empty text everywhere.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
BASE = U64(0x9E3779B97F4A7C15)


def byte_table(chars: bytes) -> np.ndarray:
    """Boolean table over the 256 byte values, true for ``chars``."""
    t = np.zeros(256, bool)
    t[list(chars)] = True
    return t


def word_table() -> np.ndarray:
    return ~byte_table(b" \t\n\x0b\x0c\r")


def mix(h: np.ndarray) -> np.ndarray:
    """64-bit finaliser (xor-shift-multiply), wrapping."""
    h = h ^ (h >> U64(30))
    h = h * U64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> U64(27))
    h = h * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


def _inverse(b: int) -> int:
    return pow(b, -1, 1 << 64)


def powers(n: int, base: int = int(BASE), cache: dict = {}) -> tuple[np.ndarray, np.ndarray]:  # noqa: B006
    """base**i and base**-i modulo 2**64 for i <= n (grown and kept per worker)."""
    have = cache.get(base)
    if have is None or len(have[0]) <= n:
        m = max(n + 1, 1 << 16)
        out = []
        for b in (base, _inverse(base)):
            a = np.full(m, U64(b))
            a[0] = 1
            out.append(np.multiply.accumulate(a))
        cache[base] = have = tuple(out)
    return have


class Hasher:
    """Polynomial hashes of arbitrary byte ranges of one buffer."""

    def __init__(self, buf: np.ndarray, base: int = int(BASE)):
        n = len(buf)
        pw, self.inv = powers(n, base)
        c = np.empty(n + 1, U64)
        c[0] = 0
        np.cumsum((buf.astype(U64) + U64(1)) * pw[:n], out=c[1:])
        self.c = c

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.c[end] - self.c[start]) * self.inv[start] + (end - start).astype(U64))


#: The five primes of XXH64.
XX = (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5)


def xxh64(data: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    """XXH64 of many byte ranges of one buffer at once.

    Every step of the hash runs over all ranges that are still long enough for it.
    """
    one, two, three, four, five = map(U64, XX)
    turn = lambda x, n: (x << U64(n)) | (x >> U64(64 - n))
    mixed = lambda acc, lane: turn(acc + lane * two, 31) * one
    buf = np.concatenate([data, np.zeros(8, np.uint8)])
    word = np.ndarray((len(buf) - 7,), "<u8", buf, strides=(1,))  # a word at every byte
    half = np.ndarray((len(buf) - 3,), "<u4", buf, strides=(1,))
    at, size = start.astype(np.int64), (end - start).astype(np.int64)
    left = size % 32
    full = lambda n, *parts: np.full(n, U64(sum(parts) & 0xFFFFFFFFFFFFFFFF))
    h = full(len(at), seed, XX[4])
    long = np.flatnonzero(size >= 32)
    if len(long):
        acc = [full(len(long), *x) for x in ((seed, XX[0], XX[1]), (seed, XX[1]), (seed,), (seed, -XX[0]))]
        stripes, p, live = size[long] // 32, at[long], np.arange(len(long))
        for k in range(int(stripes.max())):
            live = live[stripes[live] > k]
            for i, a in enumerate(acc):
                a[live] = mixed(a[live], word[p[live] + 8 * i])
            p[live] += 32
        x = turn(acc[0], 1) + turn(acc[1], 7) + turn(acc[2], 12) + turn(acc[3], 18)
        for a in acc:
            x = (x ^ mixed(U64(0), a)) * one + four
        h[long], at[long] = x, p
    h += size.astype(U64)
    for least, step, rounds in ((8, lambda x, p: turn(x ^ mixed(U64(0), word[p]), 27) * one + four, 3), (4, lambda x, p: turn(x ^ half[p].astype(U64) * one, 23) * two + three, 1), (1, lambda x, p: turn(x ^ buf[p].astype(U64) * five, 11) * one, 3)):
        for _ in range(rounds):
            i = np.flatnonzero(left >= least)
            h[i] = step(h[i], at[i])
            at[i] += least
            left[i] -= least
    h ^= h >> U64(33)
    h *= two
    h ^= h >> U64(29)
    h *= three
    return h ^ (h >> U64(32))


def column_buffer(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; null is empty."""
    if pa.types.is_null(col.type):
        col = col.cast(pa.string())
    if col.null_count:
        col = pc.fill_null(col, b"" if pa.types.is_binary(col.type) or pa.types.is_large_binary(col.type) else "")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    n = len(col)
    _, off, data = col.buffers()
    if n == 0 or off is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    o = np.frombuffer(off, np.int64 if wide else np.int32)[col.offset : col.offset + n + 1].astype(np.int64)
    b = np.frombuffer(data, np.uint8)[o[0] : o[-1]] if data is not None else np.zeros(0, np.uint8)
    return b, o - o[0]


def chunks(batches, text: str = "text", max_bytes: int = 1 << 20):
    """Yield (slice of the batch, bytes, offsets) of about ``max_bytes`` of text.

    A longer single text is a chunk of its own; nothing is cut.
    """
    for batch in batches:
        if batch.num_rows == 0:
            continue
        buf, offs = column_buffer(batch.column(batch.schema.get_field_index(text)))
        at = 0
        while at < batch.num_rows:
            to = int(np.searchsorted(offs, offs[at] + max_bytes, "right")) - 1
            to = min(max(to, at + 1), batch.num_rows)
            yield batch.slice(at, to - at), buf[offs[at] : offs[to]], offs[at : to + 1] - offs[at]
            at = to


def runs(mask: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of maximal true runs that do not cross a text boundary."""
    n = len(mask)
    if n == 0:
        z = np.zeros(0, np.int64)
        return z, z
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = mask[:-1]
    first = offs[:-1]
    before[first[first < n]] = False
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = mask[1:]
    last = offs[1:]
    after[last[last > 0] - 1] = False
    return np.flatnonzero(mask & ~before), np.flatnonzero(mask & ~after) + 1


def owner(pos: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Index of the text that holds each byte position."""
    return np.searchsorted(offs, pos, "right") - 1


def words(buf: np.ndarray, offs: np.ndarray, table: np.ndarray | None = None):
    """(start, end, text index) of every word."""
    s, e = runs((word_table() if table is None else table)[buf], offs)
    return s, e, owner(s, offs)


def lines(buf: np.ndarray, offs: np.ndarray):
    """(start, end, text index) of every non-empty \\n-split line."""
    s, e = runs(buf != 10, offs)
    return s, e, owner(s, offs)


def ranges(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Concatenation of arange(start[i], start[i] + length[i])."""
    total = int(length.sum())
    if total == 0:
        return np.zeros(0, np.int64)
    keep = length > 0
    start, length = start[keep], length[keep]
    out = np.ones(total, np.int64)
    at = np.cumsum(length)[:-1]
    out[0] = start[0]
    out[at] = start[1:] - (start[:-1] + length[:-1] - 1)
    return np.cumsum(out)


def repeated(keys: list[np.ndarray]) -> np.ndarray:
    """True where the tuple of ``keys`` occurs at least twice."""
    n = len(keys[0])
    if n == 0:
        return np.zeros(0, bool)
    order = np.lexsort(keys[::-1])
    same = np.ones(n - 1, bool)
    for k in keys:
        k = k[order]
        same &= k[1:] == k[:-1]
    hit = np.zeros(n, bool)
    hit[1:] |= same
    hit[:-1] |= same
    out = np.empty(n, bool)
    out[order] = hit
    return out


def later_equal(keys: list[np.ndarray]) -> np.ndarray:
    """True where an equal tuple of ``keys`` stands earlier in the arrays."""
    n = len(keys[0])
    out = np.zeros(n, bool)
    if n:
        order = np.lexsort((np.arange(n), *keys[::-1]))
        same = np.ones(n - 1, bool)
        for k in keys:
            k = k[order]
            same &= k[1:] == k[:-1]
        out[order[1:]] = same
    return out
