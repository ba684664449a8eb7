"""Whole text columns as byte buffers, so that word work is array work.

A batch's strings lie end to end in one byte buffer. Words are found by a table of separator bytes and hashed to 64 bits
without making one Python object per word.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Bytes worked on at once; bounds the temporary arrays (about 40 bytes for each byte). A longer word is taken whole.
CHUNK = 1 << 20
_BASE = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1

#: White space of the word and normalisation contracts: blank and U+0009 to U+000D.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes of words of letters and digits after lower-casing: 0-9, a-z and every byte of a character beyond ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
#: Lower-cases A-Z and nothing else.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null is an empty text."""
    if col.null_count:
        col = col.fill_null("")
    n = len(col)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(col.type)
    _, off, data = col.buffers()
    offsets = np.frombuffer(off, np.int64 if wide else np.int32)[col.offset : col.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: equal stays equal, all bits depend on all bits."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class _Powers:
    up = np.ones(1, np.uint64)
    down = np.ones(1, np.uint64)

    @classmethod
    def upto(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            n = max(n, CHUNK + 1)
            for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
                p = np.ones(n, np.uint64)
                size, b = 1, base
                while size < n:  # doubles the filled part
                    k = min(size, n - size)
                    p[size : size + k] = p[:k] * np.uint64(b)
                    size, b = size + k, b * b & _MASK
                setattr(cls, name, p)
        return cls.up[:n], cls.down[:n]


def _cuts(inside: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Places at which no word is cut, about CHUNK bytes apart."""
    n = len(inside)
    out, at = [0], 0
    while n - at > CHUNK:
        to = at + CHUNK
        back = offsets[np.searchsorted(offsets, to, "right") - 1]
        gap = np.flatnonzero(~inside[at:to])
        cut = max(int(back), at + int(gap[-1]) + 1 if len(gap) else 0)
        if cut <= at:  # one word fills the chunk: go on to its end
            later = np.flatnonzero(~inside[to:])
            ends = offsets[np.searchsorted(offsets, to, "left"):]
            cut = min(to + int(later[0]) if len(later) else n, int(ends[0]) if len(ends) else n)
        out.append(cut)
        at = cut
    return np.array([*out, n])


def words(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, first word of each text and the total, start byte, end byte) of the maximal runs of `inside` bytes of each text."""
    if lower:
        data = LOWER[data]
    flags = inside[data]
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True
    starts, ends, hashes = [], [], []
    cuts = _cuts(flags, offsets)
    for a, b in zip(cuts[:-1], cuts[1:]):
        if a == b:
            continue
        f = flags[a:b]
        s = f.copy()
        s[1:] &= ~f[:-1] | first[a + 1 : b]
        e = f.copy()
        e[:-1] &= ~f[1:] | first[a + 1 : b]
        s, e = np.flatnonzero(s), np.flatnonzero(e) + 1
        up, down = _Powers.upto(b - a)
        total = np.zeros(b - a + 1, np.uint64)
        np.cumsum((data[a:b].astype(np.uint64) + np.uint64(1)) * up[: b - a], out=total[1:])
        hashes.append(mix((total[e] - total[s]) * down[s] + (e - s).astype(np.uint64)))
        starts.append(s + a)
        ends.append(e + a)
    none = np.zeros(0, np.int64)
    starts = np.concatenate(starts) if starts else none
    ends = np.concatenate(ends) if ends else none
    hashes = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
    return hashes, np.searchsorted(starts, offsets), starts, ends


def shingles(hashes: np.ndarray, bounds: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of k consecutive words, bounds by text). A text of fewer words, but not none, gives its whole sequence as one."""
    n = len(hashes)
    counts = np.diff(bounds)
    width = np.uint64(0x8CB92BA72F3D8DD7)
    out = np.zeros(max(n - k + 1, 0), np.uint64)
    for i in range(k):
        out = mix(out * width + hashes[i : i + len(out)] + np.uint64(k))
    many = np.where(counts >= k, counts - k + 1, (counts > 0).astype(np.int64))
    to = np.concatenate([[0], np.cumsum(many)])
    res = np.empty(to[-1], np.uint64)
    full = counts >= k
    if full.any():
        m = many[full]
        at = np.repeat(bounds[:-1][full] - np.concatenate([[0], np.cumsum(m)[:-1]]), m) + np.arange(m.sum())
        put = np.repeat(to[:-1][full] - np.concatenate([[0], np.cumsum(m)[:-1]]), m) + np.arange(m.sum())
        res[put] = out[at]
    for d in np.flatnonzero((counts > 0) & ~full):
        h = np.zeros(1, np.uint64)
        for w in hashes[bounds[d] : bounds[d + 1]]:
            h = mix(h * width + w + np.uint64(int(counts[d])))
        res[to[d]] = h[0]
    return res, to


def distinct(values: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values of each segment."""
    seg = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    order = np.lexsort((values, seg))
    v, s = values[order], seg[order]
    new = np.ones(len(v), bool)
    new[1:] = (v[1:] != v[:-1]) | (s[1:] != s[:-1])
    return v[new], np.searchsorted(s[new], np.arange(len(bounds)))


def distinct_counts(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """How many distinct values each segment has."""
    out = np.zeros(len(bounds) - 1, np.int64)
    for i in np.flatnonzero(np.diff(bounds)):
        own = np.sort(values[bounds[i] : bounds[i + 1]])
        out[i] = 1 + np.count_nonzero(own[1:] != own[:-1])
    return out


def byte_slices(offsets: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Runs of rows of at most `most` bytes; a longer text is a run of its own."""
    out, a, n = [], 0, len(offsets) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + most, "right")) - 1)
        out.append((a, min(b, n)))
        a = min(b, n)
    return out
