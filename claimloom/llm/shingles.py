"""Sets of word n-gram hashes, computed over many texts at once."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np

PIECE = 1 << 20
LONG_WORD = 128
_KEY = 0x9E3779B97F4A7C15
_BYTES = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)  # masks of the first i bytes of a lane
_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[32, *range(9, 14)]] = True


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """A keyed 64-bit hash of each word and where it starts.

    The bytes of a word enter in lanes of eight, each mixed into the state of the lanes before it by bijections that are not linear; words
    of more than LONG_WORD bytes enter by a cryptographic digest.
    """
    raw = np.frombuffer(data, np.uint8)
    gap = _SEPARATOR[raw]
    edge = np.flatnonzero(np.diff(np.concatenate(([True], gap, [True])).view(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    left = ends - starts
    out = mixed(left.astype(np.uint64) ^ np.uint64(_KEY))
    lanes = np.ndarray(len(raw) + 1, "<u8", data + bytes(8), strides=(1,))
    active = np.flatnonzero(left <= LONG_WORD)
    for i in np.flatnonzero(left > LONG_WORD).tolist():
        out[i] = int.from_bytes(hashlib.blake2b(data[starts[i]:ends[i]], digest_size=8, key=_KEY.to_bytes(8, "little")).digest(), "little")
    at, left = starts[active], left[active]
    while len(active):
        lane = lanes[at] & _BYTES[np.minimum(left, 8)]
        out[active] = mixed(out[active] ^ mixed(lane + np.uint64(_KEY)))
        more = left > 8
        active, at, left = active[more], at[more] + 8, left[more] - 8
    return out, starts


def _pieces(data: bytes) -> Iterator[bytes]:
    """A long text in parts of about PIECE bytes, cut at separators."""
    start = 0
    while len(data) - start > PIECE:
        cut = min((at for at in (data.find(c, start + PIECE) for c in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c")) if at >= 0), default=len(data))
        yield data[start:cut]
        start = cut
    yield data[start:]


def words_of(texts: list[str]) -> Iterator[np.ndarray]:
    """Hashes of the words of each text, A-Z lower-cased; short texts are taken together."""
    waiting: list[bytes] = []
    size = 0

    def together() -> Iterator[np.ndarray]:
        hashes, starts = word_hashes(b"\n".join(waiting))
        bounds = np.searchsorted(starts, np.cumsum([0] + [len(t) + 1 for t in waiting]))
        for low, high in zip(bounds[:-1], bounds[1:]):
            yield hashes[low:high]

    for text in texts:
        data = text.encode().lower()
        if waiting and (size + len(data) > PIECE or len(data) > PIECE):
            yield from together()
            waiting, size = [], 0
        if len(data) > PIECE:
            yield np.concatenate([word_hashes(p)[0] for p in _pieces(data)])
        else:
            waiting.append(data)
            size += len(data) + 1
    if waiting:
        yield from together()


def shingle_set(words: np.ndarray, n: int) -> np.ndarray:
    """Sorted distinct n-gram hashes; with fewer words the whole sequence is one; without words none."""
    if len(words) == 0:
        return words
    if len(words) < n:
        value = np.full(1, len(words), np.uint64)
        for i in range(len(words)):
            value = mixed(value * np.uint64(0xD6E8FEB86659FD93) + words[i:i + 1])
        return value
    total = np.zeros(len(words) - n + 1, np.uint64)
    for i in range(n):
        total = total * np.uint64(0xD6E8FEB86659FD93) + words[i:len(words) - n + 1 + i]
    return np.unique(mixed(total))


def sequence_digest(words: np.ndarray) -> bytes:
    """128 bits of a cryptographic digest of the word sequence."""
    return hashlib.blake2b(words.tobytes(), digest_size=16).digest()
