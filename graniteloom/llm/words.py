"""Words and vectorised 64-bit hashing shared by the text operators (worker side)."""

from __future__ import annotations

import re
import unicodedata

import numpy as np

U = np.uint64


_WORD = re.compile(r"[^\W_]+")
_no_digit: dict[int, str] = {}


def words(text: str) -> list[str]:
    """The lower-case words of a text: maximal runs of Unicode letters (L*) and decimal digits (Nd).

    A word stays one word when lower case changes its length.
    """
    if not _no_digit:
        # numbers that are no decimal digits, such as fractions
        _no_digit.update((c, " ") for c in range(0x80, 0x20000) if chr(c).isnumeric() and unicodedata.category(chr(c)) in ("No", "Nl"))
        _no_digit_chars.update(map(chr, _no_digit))
    if not _no_digit_chars.isdisjoint(text):
        text = text.translate(_no_digit)
    found = _WORD.findall(text)
    return " ".join(found).lower().split(" ") if found else []


_no_digit_chars: set[str] = set()


def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of MurmurHash3."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> U(33))
        x = x * U(0xFF51AFD7ED558CCD)
        x = x ^ (x >> U(33))
        x = x * U(0xC4CEB9FE1A85EC53)
        return x ^ (x >> U(33))


class WordHashes:
    """64-bit hashes of words, remembered up to ``limit`` words."""

    def __init__(self, limit: int = 500_000) -> None:
        self.seen: dict[str, int] = {}
        self.limit = limit

    def __call__(self, ws: list[str]) -> np.ndarray:
        import xxhash

        if len(self.seen) > self.limit:
            self.seen.clear()
        seen, h = self.seen, xxhash.xxh3_64_intdigest
        for w in set(ws).difference(seen):
            seen[w] = h(w)
        return np.fromiter(map(seen.__getitem__, ws), np.uint64, len(ws))


def runs(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of ``n`` consecutive word hashes."""
    m = len(h) - n + 1
    if m <= 0:
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        out = np.zeros(m, np.uint64)
        for i in range(n):
            out = out * U(0x9E3779B97F4A7C15) + h[i : i + m]
    return mix(out)
