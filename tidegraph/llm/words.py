"""Words of many texts as hashes, in vector steps over their bytes."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np

SLICE = 1 << 21  # bytes hashed at once; longer texts are cut between words

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LAST_SPACE = re.compile(rb"[\x20\x09-\x0D][^\x20\x09-\x0D]*\Z")


def mix(x: np.ndarray) -> np.ndarray:
    """A one-to-one scrambling of unsigned 64-bit numbers."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Powers:
    up = down = np.ones(0, np.uint64)

    @classmethod
    def upto(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            ones = np.ones(max(n, SLICE + 1), np.uint64)
            ones[1:] = _BASE
            cls.up = np.multiply.accumulate(ones)
            ones[1:] = _INVERSE
            cls.down = np.multiply.accumulate(ones)
        return cls.up[:n], cls.down[:n]


def hash_words(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hash and starting byte of every word: bytes between ASCII white space."""
    codes = np.frombuffer(data, np.uint8)
    space = np.empty(len(codes) + 2, bool)
    space[0] = space[-1] = True
    space[1:-1] = _SPACE[codes]
    edges = np.flatnonzero(space[1:] != space[:-1])
    starts, ends = edges[::2], edges[1::2]
    if not len(starts):
        return np.zeros(0, np.uint64), starts
    up, down = _Powers.upto(len(codes))
    sums = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * up, out=sums[1:])
    raw = (sums[ends] - sums[starts]) * down[starts]
    return mix(raw + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)), starts


def word_hashes(texts: list[str | None]) -> Iterator[np.ndarray]:
    """The word hashes of each text in turn, A-Z lower-cased, words split at
    ASCII white space."""
    return hashes_of((text or "").encode("utf-8", "replace").lower() for text in texts)


# terms are runs of digits, letters a to z (A to Z lower-cased) and all beyond ASCII
_TERMS = bytes(
    b if b >= 0x80 or chr(b) in "0123456789abcdefghijklmnopqrstuvwxyz"
    else b + 32 if chr(b) in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" else 0x20
    for b in range(256)
)


def term_hashes(texts: list[str | None]) -> Iterator[np.ndarray]:
    """The hashes of each text's terms in turn."""
    return hashes_of((text or "").encode("utf-8", "replace").translate(_TERMS) for text in texts)


def hashes_of(texts: Iterable[bytes]) -> Iterator[np.ndarray]:
    """The word hashes of each text in turn. Short texts share a vector step."""
    group: list[bytes] = []
    size = 0
    for data in texts:
        if len(data) > SLICE:
            yield from _together(group)
            group, size = [], 0
            yield _of_long(data)
            continue
        if size + len(data) > SLICE:
            yield from _together(group)
            group, size = [], 0
        group.append(data)
        size += len(data) + 1
    yield from _together(group)


def _together(group: list[bytes]) -> Iterator[np.ndarray]:
    if not group:
        return
    hashes, starts = hash_words(b"\n".join(group))
    ends = np.cumsum([len(d) + 1 for d in group])
    cuts = np.searchsorted(starts, ends)
    yield from np.split(hashes, cuts[:-1])


def _of_long(data: bytes) -> np.ndarray:
    parts, at = [], 0
    while at < len(data):
        end = at + SLICE
        if end < len(data):
            found = _LAST_SPACE.search(data, at, end)
            # a word longer than a slice is taken whole
            end = found.start() + 1 if found else _word_end(data, end)
        parts.append(hash_words(data[at:end])[0])
        at = end
    return np.concatenate(parts)


def _word_end(data: bytes, at: int) -> int:
    found = re.compile(rb"[\x20\x09-\x0D]").search(data, at)
    return found.end() if found else len(data)
