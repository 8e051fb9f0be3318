"""Hashed word and character n-gram features in numpy, many texts at once."""

from __future__ import annotations

import numpy as np

from benchtide.llm.common import code_points

_MULT = np.uint64(0x100000001B3)
_SPREAD = np.uint64(0x9E3779B97F4A7C15)
# texts are hashed in pieces of at most this many code points
BLOCK_CHARS = 500_000


def char_ngrams(cps: np.ndarray, sizes: tuple[int, ...], bits: int):
    """(size, bucket of the n-gram at each start) for every size."""
    values = cps.astype(np.uint64) + np.uint64(1)
    h = np.zeros(len(values), np.uint64)
    shift = np.uint64(64 - bits)
    for size in range(1, max(sizes) + 1):
        if len(values) < size:
            return
        h = h[:len(values) - size + 1] * _MULT + values[size - 1:]
        if size in sizes:
            salted = (h ^ np.uint64(size * 0x51ED2701)) * _SPREAD
            yield size, (salted >> shift).astype(np.int64)


def word_hashes(cps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start of each white-space separated word, its 64-bit hash)."""
    blank = (cps == 32) | ((cps >= 9) & (cps <= 13))
    inside = ~blank
    starts = np.flatnonzero(inside & np.concatenate([[True], blank[:-1]]))
    if not len(starts):
        return starts, np.empty(0, np.uint64)
    marks = np.zeros(len(cps), np.int64)
    marks[starts] = starts
    rank = np.arange(len(cps)) - np.maximum.accumulate(marks)
    powers = np.cumprod(np.full(int(rank.max()) + 1, _MULT, np.uint64))
    terms = np.where(inside, (cps.astype(np.uint64) + np.uint64(1)) * powers[rank], np.uint64(0))
    return starts, np.add.reduceat(terms, starts)


def text_pieces(text: str, overlap: int):
    """Code points of a text in pieces; neighbours share ``overlap`` of them."""
    cps = code_points(text)
    if len(cps) <= BLOCK_CHARS:
        yield cps
        return
    for at in range(0, len(cps), BLOCK_CHARS):
        yield cps[at:at + BLOCK_CHARS + overlap]


def text_char_ngrams(text: str, sizes: tuple[int, ...], bits: int):
    """Buckets of the character n-grams of a whole text, piece by piece; each
    belongs to the piece that it starts in, so that none counts twice."""
    for cps in text_pieces(text, max(sizes) - 1):
        for _, bucket in char_ngrams(cps, sizes, bits):
            yield bucket[:BLOCK_CHARS]


def text_word_hashes(text: str):
    """Hashes of the words of a whole text, piece by piece; a word that a cut
    divides is put together again (its hash is a sum over its characters)."""
    open_hash, open_length = np.uint64(0), 0
    for cps in text_pieces(text, 0):
        starts, hashes = word_hashes(cps)
        if not len(starts):
            if open_length and len(cps):
                yield np.array([open_hash], np.uint64)
                open_hash, open_length = np.uint64(0), 0
            continue
        if open_length:
            if starts[0] == 0:
                power = np.uint64(pow(int(_MULT), open_length, 1 << 64))
                hashes[:1] = hashes[:1] * power + open_hash
            else:
                yield np.array([open_hash], np.uint64)
        length = len(cps) - int(starts[-1]) + (open_length if len(starts) == 1 and starts[0] == 0 else 0)
        if cps[-1] == 32 or 9 <= cps[-1] <= 13:
            open_hash, open_length = np.uint64(0), 0
        else:
            open_hash, open_length = hashes[-1], length
            hashes = hashes[:-1]
        yield hashes
    if open_length:
        yield np.array([open_hash], np.uint64)
