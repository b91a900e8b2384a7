"""Runs of windows that share a sampled anchor, the routing key of repeat finding.

A window is ``width`` consecutive symbols of one document (bytes or words).  Its
anchor is the smallest hash of the ``gram``-symbol strings in it, the leftmost one
of equals.  Equal windows hold equal strings and so choose the same anchor: grouping
windows by anchor loses no pair of equal windows.  Neighbouring windows mostly
choose the same place, so a document of n symbols has about ``2n / (width - gram)``
runs rather than n windows.

Everything here works on numpy arrays of a few hundred thousand symbols at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Stretches are hashed as polynomials modulo this prime.  Modulo a power of two, some
#: different texts would have one hash under every base.
PRIME = (1 << 61) - 1
_BASE = 0x1E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, PRIME)
#: Bits of a packed value that hold a place; the others hold the hash.
_PLACE_BITS = 28
#: Numbers that are multiplied at a time.
SLICE = 1 << 13
_POWERS: dict[str, np.ndarray] = {}

BYTE_CODES = np.random.default_rng(20240229).integers(1, PRIME, 256, dtype=np.uint64)
WORD_BREAK = np.zeros(256, dtype=bool)
WORD_BREAK[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit moves every output bit."""
    x = x ^ (x >> np.uint64(33))
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(32)
    return x


def reduced(x: np.ndarray) -> np.ndarray:
    """64-bit numbers modulo the prime."""
    x = (x & np.uint64(PRIME)) + (x >> np.uint64(61))
    return np.minimum(x, x - np.uint64(PRIME))  # a negative difference wraps to a large number


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products modulo the prime, from four products of halves; 2**64 is 8 there.

    Slices that stay in the processor's cache are multiplied one after the other.
    """
    half, low = np.uint64(32), np.uint64(0xFFFFFFFF)
    out = np.empty(len(a), dtype=np.uint64)
    for start in range(0, len(a), SLICE):
        part = slice(start, start + SLICE)
        x, y = a[part], b if len(b) == 1 else b[part]
        x_high, x_low, y_high, y_low = x >> half, x & low, y >> half, y & low
        middle = x_high * y_low
        middle += x_low * y_high
        x_low = x_low * y_low
        x_high *= y_high
        x_high <<= np.uint64(3)
        x_high += middle >> np.uint64(29)
        middle &= np.uint64((1 << 29) - 1)
        middle <<= half
        x_high += middle
        x_high += x_low & np.uint64(PRIME)
        x_high += x_low >> np.uint64(61)
        out[part] = reduced(x_high)
    return out


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse, modulo the prime."""
    have = _POWERS.get("base")
    if have is None or len(have) < n:
        size = max(n, 1 << 18)
        for name, base in (("base", _BASE), ("inverse", _INVERSE)):
            row = np.ones(1, dtype=np.uint64)
            while len(row) < size:
                step = np.array([pow(base, len(row), PRIME)], dtype=np.uint64)
                row = np.concatenate([row, times(row, step)])
            _POWERS[name] = row
    return _POWERS["base"][:n], _POWERS["inverse"][:n]


def prefix_sums(symbols: np.ndarray) -> np.ndarray:
    """Prefix sums, modulo the prime, from which the hash of any stretch follows."""
    base, _ = powers(len(symbols))
    terms = times(reduced(symbols), base)
    sums = np.zeros(len(symbols) + 1, dtype=np.uint64)
    # Halves are added up apart, as sums of whole terms would leave 64 bits.
    high = reduced(np.cumsum(terms >> np.uint64(32)))
    low = reduced(np.cumsum(terms & np.uint64(0xFFFFFFFF)))
    sums[1:] = reduced(times(high, np.array([1 << 32], dtype=np.uint64)) + low)
    return sums


def between(sums: np.ndarray, starts: np.ndarray | slice, ends: np.ndarray | slice) -> np.ndarray:
    return reduced(sums[ends] + (np.uint64(PRIME) - sums[starts]))


def stretch_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the stretches [start, end); equal content gives equal hashes."""
    _, inverse = powers(len(sums))
    return mix(times(between(sums, starts, ends), inverse[starts]) + (ends - starts).astype(np.uint64))


def gram_hashes(sums: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all stretches of one size."""
    n = len(sums) - size
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    _, inverse = powers(n)
    return mix(times(between(sums, slice(n), slice(size, None)), inverse) + np.uint64(size))


def sliding_least(values: np.ndarray, size: int) -> np.ndarray:
    """The least of every ``size`` consecutive values, in two passes."""
    n = len(values) - size + 1
    if n <= 0:
        return np.empty(0, dtype=values.dtype)
    blocks = -(-len(values) // size)
    padded = np.full(blocks * size, np.iinfo(values.dtype).max, dtype=values.dtype)
    padded[: len(values)] = values
    grid = padded.reshape(blocks, size)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[size - 1 : size - 1 + n])


def words_of(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words ``[^\\x20\\x09-\\x0D]+`` in UTF-8 bytes."""
    inside = np.empty(len(data) + 2, dtype=np.int8)
    inside[0] = inside[-1] = 0
    np.logical_not(WORD_BREAK[data], out=inside[1:-1].view(bool))
    step = np.diff(inside)
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


def batches(lengths: np.ndarray, most: int) -> Iterator[slice]:
    """Slices of consecutive rows of about ``most`` symbols; a longer row is alone."""
    start, total = 0, 0
    for row, length in enumerate(lengths.tolist()):
        if row > start and total + length > most:
            yield slice(start, row)
            start, total = row, 0
        total += length
    if start < len(lengths):
        yield slice(start, len(lengths))


def window_runs(
    symbols: np.ndarray, lengths: np.ndarray, width: int, gram: int
) -> dict[str, np.ndarray]:
    """Runs of windows with one anchor, of documents laid end to end.

    One entry per run: ``row`` (document), ``first`` (its first window in the
    document), ``windows`` (how many), ``anchor``, ``content`` (hash of all its
    symbols) and ``places`` (in how many places the anchor was found).  Documents of
    fewer than ``width`` symbols have no run.
    """
    ends = np.cumsum(lengths)
    starts = ends - lengths
    sums = prefix_sums(symbols)
    grams = gram_hashes(sums, gram)
    span = width - gram + 1
    if len(grams) < span:
        none = np.empty(0, dtype=np.int64)
        return dict.fromkeys(("row", "first", "windows", "places"), none) | dict.fromkeys(
            ("anchor", "content"), none
        )
    places = np.arange(len(grams), dtype=np.uint64)
    low = np.uint64((1 << _PLACE_BITS) - 1)
    least = sliding_least((grams & ~low) | (places & low), span)
    # Windows lie within one document.
    counts = np.maximum(lengths - width + 1, 0)
    rows = np.repeat(np.arange(len(lengths)), counts)
    firsts = np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)
    at = starts[rows] + firsts
    least = least[at]
    fresh = np.empty(len(least), dtype=bool)
    fresh[:1] = True
    np.not_equal(least[1:], least[:-1], out=fresh[1:])
    fresh[1:] |= rows[1:] != rows[:-1]
    begins = np.flatnonzero(fresh)
    # The place may have wrapped: take the one at or after the window's start.
    start = at[begins].astype(np.uint64)
    offset = ((least[begins] & low) - start) & low
    anchors = grams[(start + offset).astype(np.int64)]
    row = rows[begins]
    # Periodic text finds one anchor again and again: those places are one run.
    joined = np.zeros(len(begins), dtype=bool)
    joined[1:] = (anchors[1:] == anchors[:-1]) & (row[1:] == row[:-1])
    heads = np.flatnonzero(~joined)
    found = np.diff(np.append(heads, len(begins)))
    begins = begins[heads]
    windows = np.diff(np.append(begins, len(least)))
    begin = at[begins]
    return {
        "row": row[heads],
        "first": firsts[begins],
        "windows": windows,
        "anchor": anchors[heads].view(np.int64),
        "content": stretch_hashes(sums, begin, begin + windows + width - 1).view(np.int64),
        "places": found,
    }
