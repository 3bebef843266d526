"""Word shingles as 64-bit hashes, many texts at a time in numpy.

Words are runs without ASCII blanks, A-Z lower-cased. A word's hash is a polynomial of its bytes, taken from prefix
sums over all the bytes at once, and mixed; words over LONG bytes are hashed one by one.
"""

from __future__ import annotations

import hashlib

import numpy as np

LONG, PART = 1 << 18, 1 << 20
_P = 0x9E3779B97F4A7C15
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    filled, step = 1, np.uint64(base)
    while filled < n:  # doubling
        m = min(filled, n - filled)
        out[filled : filled + m] = out[:m] * step
        filled, step = filled + m, step * step
    return out


_cache: dict[str, np.ndarray] = {}


def _tables() -> tuple[np.ndarray, np.ndarray]:
    if not _cache:
        with np.errstate(over="ignore"):
            _cache["p"], _cache["i"] = _powers(_P, PART + LONG + 2), _powers(pow(_P, -1, 1 << 64), PART + LONG + 2)
    return _cache["p"], _cache["i"]


def _hash_part(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, first byte) of each word of a stretch of bytes."""
    blank = _BLANK[data]
    change = np.flatnonzero(np.diff(blank, prepend=True, append=True))
    first, last = change[::2], change[1::2]
    power, inverse = _tables()
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[: len(data)], out=sums[1:])
    raw = (sums[last] - sums[first]) * inverse[first]
    return mix(raw + (last - first).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)), first


def batch_hashes(texts: list[bytes]) -> list[np.ndarray]:
    """The word hashes of each text."""
    out: list[np.ndarray] = [np.zeros(0, np.uint64)] * len(texts)
    with np.errstate(over="ignore"):
        at = 0
        while at < len(texts):
            if len(texts[at]) > PART:
                out[at] = _long_text(texts[at])
                at += 1
                continue
            end, size = at, 0
            while end < len(texts) and len(texts[end]) <= PART and size + len(texts[end]) + 1 <= PART + 1:
                size += len(texts[end]) + 1
                end += 1
            data = np.frombuffer(b"\n".join(texts[at:end]), np.uint8)
            hashes, first = _hash_part(data)
            ends = np.cumsum([len(t) + 1 for t in texts[at:end]])
            cut = np.searchsorted(first, ends)
            for i, (a, b) in enumerate(zip([0, *cut], cut)):
                words = hashes[a:b]
                out[at + i] = words
            _fix_long(texts, out, at, end)
            at = end
    return out


def _fix_long(texts: list[bytes], out: list[np.ndarray], at: int, end: int) -> None:
    """Words over LONG bytes get the hash that they get in long texts too."""
    for i in range(at, end):
        if len(texts[i]) > LONG:
            words = texts[i].split()
            if any(len(w) > LONG for w in words):
                out[i] = np.array([_word(w, h) for w, h in zip(words, out[i])], np.uint64)


def _word(word: bytes, short: int) -> int:
    return int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little") if len(word) > LONG else int(short)


def _long_text(text: bytes) -> np.ndarray:
    """A text of over PART bytes, in groups of its words."""
    out, group, size = [], [], 0

    def flush() -> None:
        nonlocal group, size
        if group:
            out.append(_hash_part(np.frombuffer(b" ".join(group), np.uint8))[0])
        group, size = [], 0

    for word in text.split():
        if len(word) > LONG:
            flush()
            out.append(np.array([_word(word, 0)], np.uint64))
            continue
        group.append(word)
        size += len(word) + 1
        if size > PART - 1:
            flush()
    flush()
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def shingles(words: np.ndarray, k: int) -> np.ndarray:
    """The hash of each k neighbouring words; of fewer words, one hash of them all; none without words."""
    n = len(words)
    if not n:
        return words
    width = min(n, k)
    with np.errstate(over="ignore"):
        acc = np.full(n - width + 1, width, np.uint64)
        for j in range(width):
            acc = mix(acc * np.uint64(0xFF51AFD7ED558CCD) + words[j : n - width + 1 + j])
    return acc


def lowered(text: str | None) -> bytes:
    return (text or "").encode().lower()


def batch_sets(texts: list[str | None], k: int) -> list[np.ndarray]:
    """The ascending set of each text's shingles."""
    return [np.unique(shingles(w, k)) for w in batch_hashes([lowered(t) for t in texts])]
