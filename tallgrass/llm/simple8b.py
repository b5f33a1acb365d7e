"""Simple-8b word-aligned coding of unsigned 64-bit ids, in blocks, without a Python step for each id.

A word is 64 bits: a selector in the top 4, and as many ids as the selector says in the other 60, the first in the lowest
bits. Selector 1 is the escape: the next word is one id as it is, for ids of over 60 bits. Ids are coded in blocks of
`BLOCK`; no word crosses a block's end, and the last word of a block may hold fewer ids than its selector says. The
offset of each block's first word is kept, so that blocks are coded and decoded side by side, a word of every block in
one NumPy step.
"""

from __future__ import annotations

import numpy as np

#: Fixed values of the format: by selector, how many ids a word holds, and the bits of each.
COUNTS = np.array([120, 1, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
BITS = np.array([0, 64, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60])
ESCAPE = 1
BLOCK = 512


def bit_lengths(ids: np.ndarray) -> np.ndarray:
    if len(ids) and ids.max() < 1 << 16:
        return _SHORT[ids]
    out = np.zeros(ids.shape, np.uint8)
    for b in range(64):
        out += (ids >> np.uint64(b)) > 0
    return out


_SHORT = np.array([x.bit_length() for x in range(1 << 16)], np.uint8)
#: From one id a word to most: the selectors, of which each fits wherever a later one does.
_ORDER = np.argsort(COUNTS + (BITS == 64) * -1, kind="stable")


def encode(ids: np.ndarray, sizes: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """ids: those of many documents in a row, sizes: of each. Words, words of each document, block offsets within its document's words, blocks of each document."""
    ids = ids.astype(np.uint64, copy=False)
    blocks = -(-sizes // block)
    lanes = int(blocks.sum())
    owner = np.repeat(np.arange(len(sizes)), blocks)
    first = np.arange(lanes) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    start = np.repeat(np.cumsum(sizes) - sizes, blocks) + first * block
    length = np.minimum(block, np.repeat(sizes, blocks) - first * block)
    if not lanes:
        return np.zeros(0, np.uint64), np.zeros(len(sizes), np.int64), np.zeros(0, np.int64), blocks
    pad = int(COUNTS.max())
    table = np.zeros((lanes, block + pad), np.uint64)
    lane = np.repeat(np.arange(lanes), length)
    inside = np.arange(len(ids)) - np.repeat(start, length)
    table[lane, inside] = ids
    bits = np.zeros((lanes, block + pad), np.uint8)
    bits[lane, inside] = bit_lengths(ids)
    best = selectors(bits, block)
    at, live = np.zeros(lanes, np.int64), np.arange(lanes)
    got_lane, got_at, got_sel = [], [], []
    while len(live):
        p = at[live]
        s = _ORDER[best[live, p]]
        got_lane.append(live)
        got_at.append(p)
        got_sel.append(s)
        at[live] = p + COUNTS[s]
        live = live[at[live] < length[live]]
    l, p, s = (np.concatenate(x) for x in (got_lane, got_at, got_sel))
    order = np.argsort(l, kind="stable")  # within a lane, steps stay in order
    l, p, s = l[order], p[order], s[order]
    flat, cell = table.ravel(), l * (block + pad) + p
    width = 1 + (s == ESCAPE)
    place = np.cumsum(width) - width
    words = np.zeros(int(width.sum()), np.uint64)
    for k in np.unique(s):
        own = s == k
        at, to = cell[own], place[own]
        word = np.full(len(at), np.uint64(k) << np.uint64(60))
        if k == ESCAPE:
            words[to + 1] = flat[at]
        elif BITS[k]:
            for j in range(COUNTS[k]):  # beyond a block's end the table has zeros
                word |= flat[at + j] << np.uint64(j * BITS[k])
        words[to] = word
    by_lane = np.bincount(l, weights=width, minlength=lanes).astype(np.int64)
    by_doc = np.bincount(owner, weights=by_lane, minlength=len(sizes)).astype(np.int64)
    offsets = np.cumsum(by_lane) - by_lane - (np.cumsum(by_doc) - by_doc)[owner]
    return words, by_doc, offsets, blocks


def selectors(bits: np.ndarray, block: int) -> np.ndarray:
    """For each place, the number in _ORDER of the selector whose word holds most of the ids from there on."""
    out = np.zeros((len(bits), block), np.uint8)
    widest = {1: bits}  # by count, the most bits of any id among so many
    for s in _ORDER[1:]:
        count, half = COUNTS[s], 1
        while half * 2 <= count:
            half *= 2
            if half not in widest:
                w = widest[half // 2]
                widest[half] = np.maximum(w[:, : w.shape[1] - half // 2], w[:, half // 2 :])
        w = widest[half]
        fits = (w[:, :block] if half == count else np.maximum(w[:, :block], w[:, count - half : count - half + block])) <= BITS[s]
        if not fits.any():
            break
        out += fits
    return out


def decode(words: np.ndarray, by_doc: np.ndarray, offsets: np.ndarray, sizes: np.ndarray, block: int = BLOCK) -> np.ndarray:
    """The ids of all documents in a row."""
    blocks = -(-sizes // block)
    first = np.arange(int(blocks.sum())) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    length = np.minimum(block, np.repeat(sizes, blocks) - first * block)
    out_at = np.repeat(np.cumsum(sizes) - sizes, blocks) + first * block
    cursor = np.repeat(np.cumsum(by_doc) - by_doc, blocks) + offsets
    done, live = np.zeros(len(length), np.int64), np.flatnonzero(length > 0)
    got_word, got_out, got_take = [], [], []
    while len(live):
        c = cursor[live]
        s = (words[c] >> np.uint64(60)).astype(np.int64)
        take = np.minimum(COUNTS[s], length[live] - done[live])
        got_word.append(c)
        got_out.append(out_at[live] + done[live])
        got_take.append(take)
        done[live] += take
        cursor[live] = c + 1 + (s == ESCAPE)
        live = live[done[live] < length[live]]
    out = np.zeros(int(sizes.sum()), np.uint64)
    if not got_word:
        return out
    c, o, t = (np.concatenate(x) for x in (got_word, got_out, got_take))
    w = words[c]
    s = (w >> np.uint64(60)).astype(np.int64)
    for k in np.unique(s):
        own = s == k
        if k == ESCAPE:
            out[o[own]] = words[c[own] + 1]
        elif BITS[k]:
            mask, ww, oo, tt = np.uint64((1 << int(BITS[k])) - 1), w[own], o[own], t[own]
            for j in range(COUNTS[k]):
                full = tt > j
                out[oo[full] + j] = (ww[full] >> np.uint64(j * BITS[k])) & mask
    return out
