"""Words and word shingles of texts, as themselves and as 64-bit hashes."""

from __future__ import annotations

import hashlib

import numpy as np
import xxhash

KEEP = 300_000
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


class WordHash(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > KEEP:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


def split_words(text: str | None) -> list[bytes]:
    """Words between ASCII white space, A-Z lower-cased."""
    return text.encode("utf-8", "surrogatepass").translate(LOWER).split() if text else []


def shingles(words: list[bytes], width: int) -> set:
    """The full set, of words themselves."""
    if len(words) <= width:
        return {tuple(words)} if words else set()
    return set(zip(*(words[k:] for k in range(width))))


def shingle_hashes(words: list[bytes], width: int, hashes: WordHash) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the set."""
    h = np.array(list(map(hashes.__getitem__, words)), dtype=np.uint64)
    n = max(1, len(h) - width + 1)
    out = np.zeros(n, dtype=np.uint64)
    for k in range(min(width, len(h))):
        out = (out ^ h[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    return np.unique(out ^ (out >> np.uint64(32)))


def set_size(words: list[bytes], width: int) -> int:
    """The number of distinct shingles, from the words themselves."""
    if len(words) <= width:
        return min(len(words), 1)
    number: dict[bytes, int] = {}
    ids = np.array([number.setdefault(w, len(number)) for w in words], np.int64)
    codes, base = ids, len(number)
    for k in range(1, width):
        codes = codes[: len(ids) - k] * len(number) + ids[k:]
        base *= len(number)
        if base > (1 << 62) // max(1, len(number)):
            found, codes = np.unique(codes, return_inverse=True)
            base = len(found)
    return len(np.unique(codes))


def words_key(words: list[bytes]) -> bytes:
    """A digest that equal word sequences share; no word holds a space."""
    return hashlib.blake2b(b" ".join(words), digest_size=16).digest()
