"""Token ids of whole texts by the tokenizers library, each distinct piece encoded once per worker.

A byte-level vocabulary splits a text into pieces by a fixed pattern and merges within a piece only. The pieces are found here by
array work over character classes; a piece that the worker has met before is looked up, the others are encoded by the library.
Texts with characters whose class this table does not settle are given to the library whole, so ids always are the library's.
"""

from __future__ import annotations

import os
import sys
import unicodedata

import numpy as np
import pyarrow as pa

from . import textbuf

#: Pieces that a worker keeps; beyond them it starts anew (bounds its memory, about 60 bytes a piece).
KEPT = 1 << 21
#: Characters classed by table; texts with others go to the library whole.
TABLE = 0x3000
LETTER, NUMBER, OTHER, WHITE = 1, 2, 3, 4

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _classes() -> np.ndarray:
    out = np.full(TABLE + 1, OTHER, np.uint8)
    for c in range(TABLE):
        kind = unicodedata.category(chr(c))
        if kind == "Cn":
            out[c] = 0  # may be assigned in a later edition
        elif kind[0] == "L":
            out[c] = LETTER
        elif kind[0] == "N":
            out[c] = NUMBER
        if chr(c).isspace() and c not in (0x1C, 0x1D, 0x1E, 0x1F):
            out[c] = WHITE
    out[TABLE] = 0
    return out


def piece_starts(codes: np.ndarray, kinds: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Flags of the characters at which a piece starts. first: flags of the texts' first characters."""
    n = len(codes)
    last = np.zeros(n, bool)  # last of a text
    last[:-1] = first[1:]
    last[-1:] = True
    white = kinds == WHITE
    same = np.zeros(n, bool)
    same[1:] = (kinds[1:] == kinds[:-1]) & ~first[1:]
    white_before = np.zeros(n, bool)
    white_before[1:] = white[:-1] & ~first[1:]
    blank_before = np.zeros(n, bool)
    blank_before[1:] = (codes[:-1] == 0x20) & ~first[1:]
    white_after = np.zeros(n, bool)
    white_after[:-1] = white[1:]
    start = np.where(white, ~white_before | (~white_after & ~last), ~same & ~blank_before)
    # 's 't 'm 'd 're 've 'll where a piece may start at the apostrophe and letters follow
    tick = np.flatnonzero((codes == 0x27) & start & ~last)
    if len(tick):
        pad = np.concatenate([codes, [0, 0]])
        stop = np.concatenate([first, [True, True]])
        a, b = pad[tick + 1], np.where(stop[tick + 2], 0, pad[tick + 2])
        one = np.isin(a, [ord(x) for x in "stmd"])
        two = ((a == ord("r")) & (b == ord("e"))) | ((a == ord("v")) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l")))
        for hit, size in ((one, 2), (two & ~one, 3)):
            t = tick[hit]
            start[t + 1] = False
            start[(t + size)[(t + size) < n]] |= ~(white | blank_before)[(t + size)[(t + size) < n]] | white[(t + size)[(t + size) < n]] & start[(t + size)[(t + size) < n]]
    return start | first


class Encoder:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        self.lib.encode_special_tokens = True
        self.kinds = _classes()
        self.size = self.lib.get_vocab_size()
        self.dtype = np.uint16 if self.size <= 1 << 16 else np.uint32
        letters = _byte_letters()
        lengths = np.zeros(self.size, np.int64)
        for token, i in self.lib.get_vocab().items():
            lengths[i] = len(token) if all(c in letters for c in token) else len(token.encode())
        self.lengths = lengths
        self._clear()

    def _clear(self):
        self.slots = np.zeros(1 << 16, np.uint64)
        self.where = np.zeros(1 << 16, np.int32)
        self.count, self.filled = 0, 0
        self.at = np.zeros(1 << 12, np.int64)  # ids of piece i: ids[at[i] : at[i + 1]]
        self.ids = np.zeros(1 << 14, self.dtype)

    def _find(self, keys: np.ndarray) -> np.ndarray:
        """Number of each known key, -1 for others. Open addressing, all keys at once."""
        mask = np.uint64(len(self.slots) - 1)
        out = np.full(len(keys), -1, np.int64)
        todo, pos = np.arange(len(keys)), keys & mask
        while len(todo):
            held = self.slots[pos]
            hit = held == keys[todo]
            out[todo[hit]] = self.where[pos[hit]]
            go = ~hit & (held != 0)
            todo, pos = todo[go], (pos[go] + np.uint64(1)) & mask
        return out

    def _put(self, keys: np.ndarray, numbers: np.ndarray):
        mask = np.uint64(len(self.slots) - 1)
        todo, pos = np.arange(len(keys)), keys & mask
        while len(todo):
            free = self.slots[pos] == 0
            p, t = pos[free], todo[free]
            self.slots[p] = keys[t]  # of several for one slot the last stays
            self.where[p] = numbers[t]
            lost = self.slots[pos] != keys[todo]
            todo, pos = todo[lost], (pos[lost] + np.uint64(1)) & mask

    def _learn(self, keys: np.ndarray, pieces: list[bytes]):
        """Encode pieces new to the cache; those of a blank and one run of a class are encoded many in one text."""
        joined = np.array([p[:1] == b" " and len(p) > 1 and p[1:2] != b" " for p in pieces])
        many, rest = np.flatnonzero(joined), np.flatnonzero(~joined)
        flat, sizes = [], []
        for g in range(0, len(many), 512):
            part = [pieces[i] for i in many[g : g + 512]]
            got = np.array(self.lib.encode(b"".join(part).decode(), add_special_tokens=False).ids, self.dtype)
            ends = np.cumsum([len(x) for x in part])
            have = np.cumsum(self.lengths[got])
            cuts = np.searchsorted(have, ends) + 1
            if not np.array_equal(have[cuts - 1], ends):
                raise RuntimeError("a token crosses pieces")
            flat.append(got)
            sizes.append(np.diff(cuts, prepend=0))
        if len(rest):
            for e in self.lib.encode_batch_fast([pieces[i].decode() for i in rest], add_special_tokens=False):
                flat.append(np.array(e.ids, self.dtype))
                sizes.append([len(e.ids)])
        keys, sizes = keys[np.concatenate([many, rest])], np.concatenate(sizes)
        total = int(self.at[self.count] + sizes.sum())
        while total > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while self.count + len(keys) + 1 > len(self.at):
            self.at = np.concatenate([self.at, np.zeros_like(self.at)])
        self.ids[self.at[self.count] : total] = np.concatenate(flat)
        self.at[self.count + 1 : self.count + 1 + len(keys)] = self.at[self.count] + np.cumsum(sizes)
        if 2 * (self.count + len(keys)) > len(self.slots):
            old = np.flatnonzero(self.slots)
            k, w = self.slots[old], self.where[old]
            size = len(self.slots)
            while 2 * (self.count + len(keys)) > size:
                size *= 2
            self.slots, self.where = np.zeros(size, np.uint64), np.zeros(size, np.int32)
            self._put(k, w)
        self._put(keys, np.arange(self.count, self.count + len(keys)))
        self.count += len(keys)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, bounds by text) of UTF-8 texts lying end to end."""
        outs, counts = [], []
        for a, b in textbuf.byte_slices(offsets, textbuf.CHUNK):
            i, c = self._slice(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            outs.append(i)
            counts.append(c)
        ids = np.concatenate(outs) if outs else np.zeros(0, self.dtype)
        return ids, np.concatenate([[0], np.cumsum(np.concatenate(counts))]) if counts else np.zeros(1, np.int64)

    def _slice(self, data, offsets):
        n = len(offsets) - 1
        if not len(data):
            return np.zeros(0, self.dtype), np.zeros(n, np.int64)
        if self.count > KEPT:
            self._clear()
        codes = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
        lead = np.flatnonzero((data & 0xC0) != 0x80)  # byte of each character
        kinds = self.kinds[np.minimum(codes, TABLE)]
        bounds = np.searchsorted(lead, offsets)
        first = np.zeros(len(codes) + 1, bool)
        first[bounds] = True
        starts = lead[piece_starts(codes, kinds, first[:-1])]
        ends = np.append(starts[1:], len(data))
        up, down = textbuf._Powers.upto(len(data) + 1)
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=total[1:])
        keys = textbuf.mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))
        keys[keys == 0] = 1
        numbers = self._find(keys)
        new = np.flatnonzero(numbers < 0)
        if len(new):
            k, at = np.unique(keys[new], return_index=True)
            raw = data.tobytes()
            self._learn(k, [raw[s:e] for s, e in zip(starts[new[at]].tolist(), ends[new[at]].tolist())])
            numbers[new] = self._find(keys[new])
        sizes = self.at[numbers + 1] - self.at[numbers]
        to = np.concatenate([[0], np.cumsum(sizes)])
        ids = self.ids[np.repeat(self.at[numbers] - to[:-1], sizes) + np.arange(to[-1])]
        at = to[np.searchsorted(starts, offsets)]
        counts = np.diff(at)
        odd = np.unique(np.searchsorted(bounds, np.flatnonzero(kinds == 0), "right") - 1)
        if len(odd):
            parts = [ids[at[i] : at[i + 1]] for i in range(n)]
            for i in odd:
                text = data[offsets[i] : offsets[i + 1]].tobytes().decode()
                parts[i] = np.array(self.lib.encode(text, add_special_tokens=False).ids, self.dtype)
            counts = np.array([len(p) for p in parts])
            ids = np.concatenate(parts)
        return ids, counts


def _byte_letters() -> set:
    """The characters that stand for bytes in the vocabulary: printable ones for themselves, the rest from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    return {chr(c) for c in plain} | {chr(0x100 + i) for i in range(256 - len(plain))}


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One per worker process and vocabulary, kept between tasks."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
