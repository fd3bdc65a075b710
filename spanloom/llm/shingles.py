"""Hashed words and word shingles of a text, in numpy."""

from __future__ import annotations

import hashlib

import numpy as np

_draw = np.random.default_rng(20_240_501)
#: Random odd factors.
PLACES = _draw.integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Masks of the first n bytes of an 8-byte piece.
_FIRST = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
#: Words of more bytes than this are hashed one by one.
LONG = 64
_WHITE = np.zeros(256, bool)
_WHITE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype="uint8")
_LOWER[65:91] += 32


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads all bits."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def paired(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A 64-bit name of each pair. It is mixed at every pairing: sums of powers alone have texts that collide whatever
    the base."""
    x = a * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(32)
    x += b
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xC2B2AE3D27D4EB4F)
    x ^= x >> np.uint64(32)
    return x


def pieces(raw: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place, as numbers; zeros follow the end."""
    return np.ndarray((len(raw),), "<u8", np.concatenate([raw, np.zeros(8, "uint8")]), strides=(1,))


def word_places(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of words: runs of anything but ASCII white space."""
    step = np.diff((~_WHITE[raw]).view("int8"), prepend=0, append=0)
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of words, from their length and 8-byte pieces."""
    size = ends - starts
    out = mixed(size.astype(np.uint64))
    eight = pieces(raw)
    at, left, own = starts, size, np.flatnonzero(size <= LONG)
    at, left = at[own], left[own]
    while len(own):
        out[own] = paired(out[own], eight[at] & _FIRST[np.minimum(left, 8)])
        more = left > 8
        own, at, left = own[more], at[more] + 8, left[more] - 8
    for k in np.flatnonzero(size > LONG):
        out[k] = int.from_bytes(hashlib.blake2b(raw[starts[k] : ends[k]].tobytes(), digest_size=8).digest(), "little")
    return out


def shingles(text: str | None, width: int) -> np.ndarray:
    """The set of a text's word shingles, as sorted 64-bit hashes.

    A-Z are lower-cased. Fewer words than the width make one shingle, none make none.
    """
    raw = _LOWER[np.frombuffer((text or "").encode("utf-8", "surrogatepass"), "uint8")]
    starts, ends = word_places(raw)
    if not len(starts):
        return np.zeros(0, np.uint64)
    words = word_hashes(raw, starts, ends)
    size = min(width, len(words))
    n = len(words) - size + 1
    out = np.full(n, size, np.uint64)
    for k in range(size):
        out += words[k : k + n] * PLACES[k]
    return np.unique(mixed(out))
