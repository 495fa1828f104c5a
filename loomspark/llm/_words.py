"""Hashes of the words of many texts at once: words are runs without ASCII white space, A-Z taken as a-z."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np

from loomspark.llm.fingerprints import BASE, mix, stretches

PIECE = 1 << 18  # bytes hashed at a time; a longer word is hashed whole
WHITE = re.compile(rb"[ \t-\r]")
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(1, 257, dtype=np.uint64)
_LOWER[65:91] += np.uint64(32)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers 0 to n - 1 of the base and of its inverse modulo 2**64."""
    if len(_powers[0]) < n:
        inverse = pow(BASE, -1, 1 << 64)
        for i, b in enumerate((BASE, inverse)):
            x = np.full(max(n, PIECE + 4096), b, np.uint64)
            x[0] = 1
            _powers[i] = np.multiply.accumulate(x)
    return _powers[0][:n], _powers[1][:n]


def _hashed(data: bytes) -> np.ndarray:
    """The hashes of the words in data, in order."""
    raw = np.frombuffer(data, np.uint8)
    word = ~_SPACE[raw]
    edge = np.diff(word.astype(np.int8), prepend=np.int8(0), append=np.int8(0))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    power, inverse = _power(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_LOWER[raw] * inverse[: len(raw)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * power[starts] + (ends - starts).astype(np.uint64))


def word_hashes(texts: Sequence[str]) -> Iterator[np.ndarray]:
    """For each text the hashes of its words, in order."""
    held: list[bytes] = []
    size = 0
    for t in texts:
        data = t.encode("utf-8", "surrogatepass")
        if len(data) >= PIECE:
            yield from _several(held)
            held, size = [], 0
            yield _long(data)
            continue
        held.append(data)
        size += len(data)
        if size >= PIECE:
            yield from _several(held)
            held, size = [], 0
    yield from _several(held)


def _long(data: bytes) -> np.ndarray:
    parts, at = [], 0
    while at < len(data):
        cut = WHITE.search(data, at + PIECE)
        end = cut.start() if cut else len(data)
        parts.append(_hashed(data[at:end]))
        at = end
    return np.concatenate(parts)


def _several(texts: list[bytes]) -> list[np.ndarray]:
    if not texts:
        return []
    hashes = _hashed(b"\n\0\n".join(texts))  # a word of one zero byte stands between texts
    zero = _hashed(b"\0")[0]
    cuts = np.flatnonzero(hashes == zero)
    if len(cuts) == len(texts) - 1:
        return [x[(i > 0) :] for i, x in enumerate(np.split(hashes, cuts))]
    return [_hashed(t) for t in texts]  # a text has such a word itself


def shingle_set(words: np.ndarray, k: int) -> np.ndarray:
    """The sorted hashes of the distinct runs of k words; of fewer words the whole is the one run; of none none."""
    if not len(words):
        return words
    n = min(k, len(words))
    found = np.sort(mix(stretches(words, n) + np.uint64(n)))  # np.unique takes several times as long
    return found[np.concatenate([[True], found[1:] != found[:-1]])]
