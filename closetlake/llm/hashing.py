"""Word and shingle hashes of many texts at once, as numpy arrays.

Used inside tasks only. Hashes are 64 bits, equal on every machine and run.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15 | 1, -1, 1 << 64))

#: A-Z to a-z, and the six ASCII blanks to a space; every other byte stays.
BLANKS = bytes.maketrans(b"\t\n\x0b\x0c\r", b"     ")
LOWER = bytes.maketrans(bytes(range(65, 91)) + b"\t\n\x0b\x0c\r", bytes(range(97, 123)) + b"     ")


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


def slices(texts: list, most_chars: int = 2_000_000) -> Iterator[range]:
    """Index ranges of ``texts`` that hold about ``most_chars`` characters, one text at least."""
    start, held = 0, 0
    for i, text in enumerate(texts):
        held += len(text) if text else 0
        if held >= most_chars:
            yield range(start, i + 1)
            start, held = i + 1, 0
    if start < len(texts):
        yield range(start, len(texts))


def word_hashes(texts: list, table: bytes = LOWER, prefixes: tuple[int, ...] | None = None):
    """Hashes of the blank-separated words of all texts, and where each text's words begin.

    ``table`` maps bytes before the split. The second array has one entry more
    than there are texts. A null text has no words. With ``prefixes`` the hashes get a row for
    the whole words and one for their first so many bytes, and words' first and
    last bytes (excluded), texts' first bytes and all bytes follow.
    """
    encoded = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    raw = b" ".join(encoded) + b" "
    joined = np.frombuffer(raw.translate(table), dtype=np.uint8)
    blank = joined == 32
    word = ~blank
    first = word.copy()
    first[1:] &= blank[:-1]
    starts = np.flatnonzero(first)
    ends = np.flatnonzero(blank[1:] & word[:-1]) + 1
    rising = np.zeros(len(joined) + 1, dtype=np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum((joined.astype(np.uint64) + np.uint64(1)) * powers(_BASE, len(joined)), out=rising[1:])
        lowered = powers(_BASE_INVERSE, len(joined) + 1)[starts]

        def hashed(to):
            return mix((rising[to] - rising[starts]) * lowered + (to - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))

        hashes = hashed(ends)
        if prefixes is not None:
            hashes = np.stack([hashes, *[hashed(np.minimum(ends, starts + k)) for k in prefixes]])
    bounds = np.zeros(len(texts) + 1, dtype=np.int64)
    np.cumsum([len(e) + 1 for e in encoded], out=bounds[1:])
    places = np.searchsorted(starts, bounds)
    if prefixes is None:
        return hashes, places
    return hashes, places, starts, ends, bounds[:-1], np.frombuffer(raw, dtype=np.uint8)


def shingle_hashes(words: np.ndarray, bounds: np.ndarray, size: int) -> list[np.ndarray]:
    """For each text the sorted distinct hashes (as signed 64-bit) of its runs of ``size`` words.

    A text with fewer words, but one at least, has its whole sequence as its only shingle.
    """
    with np.errstate(over="ignore"):
        rolled = words.copy()
        for k in range(1, size):
            rolled[: len(words) - k] = mix(rolled[: len(words) - k] * np.uint64(0xA24BAED4963EE407) + words[k:])
        out = []
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            if b - a >= size:
                found = rolled[a: b - size + 1]
            elif b > a:
                whole = np.array([b - a], dtype=np.uint64)
                for h in words[a:b]:
                    whole = mix(whole * np.uint64(0x9FB21C651E98DF25) + h)
                found = whole
            else:
                found = words[:0]
            out.append(np.unique(found.view(np.int64)))
    return out


def set_hash(tokens: np.ndarray) -> int:
    """A signed 64-bit hash of a set; equal sets have equal ones."""
    with np.errstate(over="ignore"):
        total = mix(tokens.view(np.uint64) ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)
        return int(mix(np.array([total + np.uint64(len(tokens))], dtype=np.uint64)).view(np.int64)[0])
