"""Word shingles of texts as 64-bit hashes, and MinHash bands, in numpy."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np

from locusframe.llm.byte_bpe import blocks

#: Bytes of a text that are hashed at once; a longer word is still hashed whole.
PART = 1 << 20
_BASE = 0x9E3779B97F4A7C13  # odd, so that its powers can be divided by


@lru_cache(maxsize=8)
def odd_numbers(n: int, seed: int, bits: int = 64) -> np.ndarray:
    """``n`` fixed odd multipliers."""
    kind = np.uint64 if bits == 64 else np.uint32
    return np.random.default_rng(seed).integers(0, 2**bits - 1, n, dtype=kind, endpoint=True) | kind(1)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit over the others."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


@lru_cache(maxsize=8)
def _powers(n: int, base: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


@lru_cache(maxsize=1)
def _bytes() -> tuple[np.ndarray, np.ndarray]:
    """A random number for each byte, and which bytes part words."""
    blank = np.zeros(256, bool)
    blank[[9, 10, 11, 12, 13, 32]] = True
    return odd_numbers(256, 3), blank


def word_hashes(text: str) -> np.ndarray:
    """One 64-bit hash per word, in text order: words are split on ASCII white space after lower-casing A-Z.

    A hash is a polynomial of the word's bytes, taken as a difference of
    running sums, so a text costs a few passes over its bytes.
    """
    return _hashed(text.encode())[0]


def _hashed(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words, and where they start."""
    numbers, blank = _bytes()
    data = np.frombuffer(text.lower(), np.uint8)
    parting = np.concatenate([[True], blank[data], [True]])
    starts = np.flatnonzero(parting[:-2] & ~parting[1:-1])
    ends = np.flatnonzero(~parting[1:-1] & parting[2:]) + 1
    out, at = np.empty(len(starts), np.uint64), 0
    while at < len(starts):
        base = starts[at]
        to = max(at + 1, int(np.searchsorted(ends, base + PART, "right")))
        size = int(ends[to - 1] - base)
        room = max(PART, 1 << (size - 1).bit_length())
        sums = np.zeros(size + 1, np.uint64)
        np.cumsum(numbers[data[base:base + size]] * _powers(room, _BASE)[:size], out=sums[1:])
        first = starts[at:to] - base
        out[at:to] = (sums[ends[at:to] - base] - sums[first]) * _powers(room, pow(_BASE, -1, 2**64))[first]
        at = to
    return mix(out), starts


def words_of(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Word hashes of many texts behind each other, a bounded part at a time, and where each text begins and the last one ends."""
    for block in blocks(texts, PART // 4):
        raw = [text.encode() for text in block]
        words, starts = _hashed(b"\n".join(raw))
        yield words, np.searchsorted(starts, np.cumsum([0, *(len(r) + 1 for r in raw)]))


def shingle_blocks(texts: list[str], width: int = 5) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The sorted sets of shingle hashes of the texts behind each other, a bounded part at a time, and their sizes."""
    for words, cuts in words_of(texts):
        whole, size = shingles(words, width), np.diff(cuts)
        n = np.where(size < width, np.minimum(size, 1), size - width + 1)
        ends = np.cumsum(n)
        place = np.arange(ends[-1]) + np.repeat(cuts[:-1] - ends + n, n)
        values = whole[np.minimum(place, len(whole) - 1)]
        for k in np.flatnonzero((size > 0) & (size < width)).tolist():
            values[ends[k] - 1] = shingles(words[cuts[k]:cuts[k + 1]], width)[0]
        for at, to in zip((ends - n).tolist(), ends.tolist()):
            values[at:to].sort()
        row = np.repeat(np.arange(len(n)), n)
        new = np.ones(len(row), bool)
        new[1:] = (row[1:] != row[:-1]) | (values[1:] != values[:-1])
        yield values[new], np.bincount(row[new], minlength=len(size))


def shingle_sets(texts: list[str], width: int = 5) -> Iterator[np.ndarray]:
    """The sorted set of shingle hashes of each text; many short texts are hashed together."""
    for values, sizes in shingle_blocks(texts, width):
        yield from np.split(values, np.cumsum(sizes)[:-1])


def shingles(words: np.ndarray, width: int = 5) -> np.ndarray:
    """One hash per run of ``width`` words, in text order; a shorter text is one shingle, no words none."""
    n = len(words)
    if not n:
        return words
    size = min(n, width)
    factors = odd_numbers(width, 5)
    out = np.full(n - size + 1, size, np.uint64)
    for k in range(size):
        out += words[k:n - size + 1 + k] * factors[k]
    return mix(out)


def distinct(values: np.ndarray) -> np.ndarray:
    """The set of the values, sorted."""
    values = np.sort(values)
    return values[np.concatenate([[True], values[1:] != values[:-1]])] if len(values) else values


def minhash(values: np.ndarray, count: int) -> np.ndarray:
    """Smallest of each of ``count`` 32-bit permutations over the set."""
    factors, shifts = odd_numbers(count, 32, 32)[:, None], odd_numbers(count, 33, 32)[:, None]
    short = (values >> np.uint64(32)).astype(np.uint32)
    out = np.full(count, 2**32 - 1, np.uint32)
    for at in range(0, len(short), 2048):
        np.minimum(out, (short[None, at:at + 2048] * factors + shifts).min(axis=1), out=out)
    return out


def minhashes(values: np.ndarray, starts: np.ndarray, count: int) -> np.ndarray:
    """``minhash`` of many sets: ``values`` holds them behind each other, none empty, from ``starts`` on."""
    factors, shifts = odd_numbers(count, 32, 32)[:, None], odd_numbers(count, 33, 32)[:, None]
    short, ends = (values >> np.uint64(32)).astype(np.uint32), np.append(starts[1:], len(values))
    out, at = np.empty((len(starts), count), np.uint32), 0
    while at < len(starts):
        to = max(at + 1, int(np.searchsorted(ends, starts[at] + 2048, "right")))
        if to == at + 1:
            out[at] = minhash(values[starts[at]:ends[at]], count)
        else:
            part = short[None, starts[at]:ends[to - 1]] * factors + shifts
            out[at:to] = np.minimum.reduceat(part, starts[at:to] - starts[at], axis=1).T
        at = to
    return out


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key per band (last axis of the signature), distinct between bands."""
    part = signature.reshape(*signature.shape[:-1], bands, rows).astype(np.uint64)
    keys = (part * odd_numbers(rows, 34)).sum(axis=-1, dtype=np.uint64)
    return mix(keys + np.arange(bands, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)
