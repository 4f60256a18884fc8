"""Hashes of words and of runs of words for many texts at once, in numpy."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are hashed together.
BLOCK = 400_000
#: Bytes of a word that is hashed with the others.
LONG = 256
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_BYTES, _WORDS = 0xD6E8FEB86659FD93, 0x9E3779B97F4A7C15
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base^0 ... base^(n-1) mod 2^64."""
    have = _powers.get(base, np.ones(1, np.uint64))
    while len(have) < n:
        have = np.concatenate([have, have * np.uint64(pow(base, len(have), 1 << 64))])
    _powers[base] = have
    return have[:n]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def blocks(raws: list[bytes]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about BLOCK bytes; a longer text stands alone."""
    at = 0
    while at < len(raws):
        end, size = at, 0
        while end < len(raws) and size < BLOCK:
            size += len(raws[end])
            end += 1
        yield at, end
        at = end


def word_hashes(raws: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Of all words of the texts, in order: 64-bit hashes, and the number of the text. Words of more than LONG bytes,
    of which some can be built to collide in any polynomial, are hashed one by one."""
    joined = b" ".join([*raws, b""])
    chars = np.frombuffer(joined, np.uint8)
    space = _SPACE[chars]
    edge = np.flatnonzero(np.diff(space, prepend=True))
    starts, ends = edge[::2], edge[1::2]
    total = np.zeros(len(chars) + 1, np.uint64)
    np.cumsum((chars.astype(np.uint64) + np.uint64(1)) * powers(_BYTES, len(chars)), out=total[1:])
    inverse = powers(pow(_BYTES, -1, 1 << 64), len(chars))
    hashes = mixed((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))
    for i in np.flatnonzero(ends - starts > LONG).tolist():
        hashes[i] = int.from_bytes(hashlib.blake2b(joined[starts[i] : ends[i]], digest_size=8).digest(), "little")
    limits = np.cumsum([len(r) + 1 for r in raws])
    return hashes, np.searchsorted(limits, starts, side="right")


def window_hashes(hashes: np.ndarray, doc: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all windows of k words (by first word), and which of them lie in one text."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64), np.empty(0, bool)
    total = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes * powers(_WORDS, len(hashes)), out=total[1:])
    inverse = powers(pow(_WORDS, -1, 1 << 64), n)
    return mixed((total[k:] - total[:n]) * inverse), doc[:n] == doc[k - 1 :]


def sliding(x: np.ndarray, w: int, best: np.ufunc) -> np.ndarray:
    """best (minimum or maximum) over each w neighbours."""
    done = 1
    while done < w:
        step = min(done, w - done)
        x = best(x[:-step], x[step:])
        done += step
    return x


def raw_texts(column: pa.Array) -> list[bytes]:
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def folding(digits: bool) -> bytes:
    """A table for bytes.translate: A-Z in lower case; letters, bytes beyond ASCII and, if asked, digits stay; the rest become spaces."""
    letters = {*b"abcdefghijklmnopqrstuvwxyz", *range(128, 256), *(b"0123456789" if digits else b"")}
    return bytes(c if c in letters else 32 for c in bytes(range(256)).lower())


def runs_of(doc: np.ndarray, n: int) -> np.ndarray:
    """Starts of runs of n neighbours in one text."""
    return np.flatnonzero(doc[: len(doc) - n + 1] == doc[n - 1 :]) if len(doc) >= n else np.empty(0, np.int64)
