"""A static 3-wise binary fuse filter over 64-bit keys, built and queried by array operations."""

from __future__ import annotations

import math

import numpy as np

from .textbuf import mix


def _places(keys: np.ndarray, seed: int, seg: int, segments: int) -> tuple[np.ndarray, np.ndarray]:
    h = mix(keys + np.uint64(seed))
    base = ((h >> np.uint64(32)) * np.uint64(segments * seg)) >> np.uint64(32)
    m = np.uint64(seg - 1)
    g = mix(h)
    p = np.stack([base, (base + np.uint64(seg)) ^ (g & m), (base + np.uint64(2 * seg)) ^ ((g >> np.uint64(24)) & m)]).astype(np.int64)
    return p, (g >> np.uint64(48)).astype(np.uint16)


def build(keys: np.ndarray) -> dict:
    """keys: uint64, any order, repeats allowed. False positives: 2^-16; no false negatives."""
    keys = np.unique(keys)
    n = len(keys)
    if not n:
        return {"seed": 0, "seg": 0, "segments": 0, "cells": np.zeros(0, np.uint16)}
    seg = 1 << min(18, max(2, int(math.log(n) / math.log(3.33) + 2.25)))
    for attempt in range(100):
        factor = max(1.125, 0.875 + 0.25 * math.log(1e6) / math.log(max(n, 2))) * (1 + 0.05 * attempt)
        segments = max(1, math.ceil(n * factor / seg) - 2)
        seed = 0x9E3779B9 * (attempt + 1)
        places, prints = _places(keys, seed, seg, segments)
        order = _peel(places, n, (segments + 2) * seg)
        if order is not None:
            cells = np.zeros((segments + 2) * seg, np.uint16)
            for ks, slots in reversed(order):  # keys of one round don't touch each other's slots
                p = places[:, ks]
                cells[slots] = 0
                cells[slots] = prints[ks] ^ cells[p[0]] ^ cells[p[1]] ^ cells[p[2]]
            return {"seed": seed, "seg": seg, "segments": segments, "cells": cells}
    raise RuntimeError("no seed gave a peelable filter")


def _peel(places: np.ndarray, n: int, size: int):
    flat = places.ravel()
    who = np.tile(np.arange(n), 3)
    count = np.bincount(flat, minlength=size)
    total = np.bincount(flat, weights=who, minlength=size).astype(np.int64)
    frontier, out, done = np.flatnonzero(count == 1), [], 0
    while len(frontier):
        ks, at = np.unique(total[frontier], return_index=True)
        out.append((ks, frontier[at]))
        done += len(ks)
        p = places[:, ks].ravel()
        np.subtract.at(count, p, 1)
        np.subtract.at(total, p, np.tile(ks, 3))
        frontier = np.unique(p[count[p] == 1])
    return out if done == n else None


def contains(f: dict, keys: np.ndarray) -> np.ndarray:
    if not len(f["cells"]):
        return np.zeros(len(keys), bool)
    p, prints = _places(keys, f["seed"], f["seg"], f["segments"])
    c = f["cells"]
    return prints == c[p[0]] ^ c[p[1]] ^ c[p[2]]
