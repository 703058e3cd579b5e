"""Words of many texts at once, as 64-bit hashes in numpy arrays.

Runs inside Spark tasks on one batch of texts. Texts are joined into one byte
buffer; the hash of a word is the difference of two prefix sums of a polynomial
in an odd base, so no word becomes a Python object. Pieces are about a megabyte,
which bounds the memory whatever the texts' lengths are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

PIECE = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_SALT = np.uint64(0xD6E8FEB86659FD93)
_powers: dict[str, np.ndarray] = {}


def byte_class(chars: bytes, invert: bool = False) -> np.ndarray:
    """A 256-entry table that is true for ``chars`` (or for all other bytes)."""
    table = np.zeros(256, dtype=bool)
    table[np.frombuffer(chars, dtype=np.uint8)] = True
    return ~table if invert else table


#: Words of the text contracts: anything but blanks.
NOT_BLANK = byte_class(b" \t\n\x0b\x0c\r", invert=True)


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h = h * _SALT
    h ^= h >> np.uint64(29)
    h = h * _BASE
    return h ^ (h >> np.uint64(32))


def _table(name: str, base: np.uint64, n: int) -> np.ndarray:
    if name not in _powers or len(_powers[name]) < n:
        steps = np.full(max(n, PIECE + 1), base, dtype=np.uint64)
        steps[0] = 1
        _powers[name] = np.cumprod(steps, dtype=np.uint64)
    return _powers[name][:n]


def hash_buffer(buf: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(starts, hashes)`` of the words of one buffer of bytes."""
    flag = is_word[buf]
    edge = np.flatnonzero(np.diff(flag, prepend=False, append=False))
    starts, ends = edge[::2], edge[1::2]
    n = len(buf) + 1
    sums = np.zeros(n, dtype=np.uint64)
    np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * _table("up", _BASE, n - 1), out=sums[1:])
    return starts, mix((sums[ends] - sums[starts]) * _table("down", _BASE_INVERSE, n)[starts] + (ends - starts).astype(np.uint64))


def _cut(buf: np.ndarray, is_word: np.ndarray, at: int) -> int:
    """The first place from ``at`` on that is not inside a word."""
    while at < len(buf):
        stop = np.flatnonzero(~is_word[buf[at:at + 4096]])
        if len(stop):
            return at + int(stop[0])
        at += 4096
    return len(buf)


def word_hashes(text: bytes, is_word: np.ndarray) -> np.ndarray:
    """Hashes of the words of one text of any length."""
    buf = np.frombuffer(text, dtype=np.uint8)
    out, at = [], 0
    while at < len(buf):
        end = _cut(buf, is_word, at + PIECE) if len(buf) - at > PIECE else len(buf)
        out.append(hash_buffer(buf[at:end], is_word)[1])
        at = end
    return np.concatenate(out) if out else np.zeros(0, dtype=np.uint64)


def groups(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    """Index ranges of consecutive texts of about one piece together; a longer text is alone."""
    at, size = 0, 0
    for i, t in enumerate(texts):
        if i > at and size + len(t) > PIECE:
            yield at, i
            at, size = i, 0
        size += len(t) + 1
    if at < len(texts):
        yield at, len(texts)


def words_of(texts: list[bytes], is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(owner, hash)`` of the words of one group of texts; ``owner`` counts from zero."""
    if len(texts) == 1:
        h = word_hashes(texts[0], is_word)
        return np.zeros(len(h), dtype=np.int64), h
    sizes = np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=len(texts))
    starts, h = hash_buffer(np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8), is_word)
    return np.searchsorted(np.cumsum(sizes), starts, side="right"), h


def window_hashes(owner: np.ndarray, h: np.ndarray, offsets: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """``(first word, hash)`` of each window of words at ``offsets`` that lies in one text."""
    span = offsets[-1] + 1
    n = len(h) - span + 1
    if n <= 0:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    first = np.flatnonzero(owner[:n] == owner[span - 1:])
    total = np.zeros(len(first), dtype=np.uint64)
    for o in offsets:
        total = total * _BASE + h[first + o]
    return first, mix(total)
