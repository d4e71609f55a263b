"""Word shingles of whole texts as 128-bit hashes, computed for a batch at once."""

from __future__ import annotations

import re

import numpy as np
import xxhash

_SPACE = re.compile(rb"[\x20\x09-\x0D]")
_WEIGHTS = [np.uint64(x | 1) for x in (0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3)]
PIECE = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _words(text: bytes):
    """The words of a text with A-Z lower-cased, in lists from pieces of about PIECE bytes. Bytes are split at just [\\x20\\x09-\\x0D]."""
    at = 0
    while at < len(text):
        gap = _SPACE.search(text, at + PIECE)
        end = gap.start() if gap else len(text)
        yield text[at:end].lower().split()
        at = end


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """128-bit hash of each word of the texts as two numbers, and the count of words of each text."""
    hashes, counts = [], []
    for text in texts:
        count = 0
        for words in _words(text):
            count += len(words)
            hashes.append(b"".join(map(xxhash.xxh3_128_digest, words)))
        counts.append(count)
    return np.frombuffer(b"".join(hashes), np.uint64).reshape(-1, 2).T, np.array(counts, np.int64)


def _sorted_set(pairs: np.ndarray) -> np.ndarray:
    """Distinct columns of a (2, n) array, sorted by the first number, then the second."""
    out = pairs[:, np.argsort(pairs[0], kind="stable")]
    same = out[0, 1:] == out[0, :-1]
    if same.any():
        if (same & (out[1, 1:] != out[1, :-1])).any():
            out = pairs[:, np.lexsort(pairs[::-1])]
        out = out[:, np.concatenate([[True], (out[:, 1:] != out[:, :-1]).any(0)])]
    return out


def shingle_sets(texts: list[bytes], width: int = 5) -> list[np.ndarray]:
    """The distinct shingles of each text as a sorted (2, n) array; a text of fewer words is one shingle, one without words is empty."""
    words, count = word_hashes(texts)
    n = words.shape[1] - width + 1
    joined = np.zeros((2, max(n, 0)), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(width if n > 0 else 0):  # each half of the hash on its own, in order of the words
            joined = mix(joined + words[:, k : k + n]) * _WEIGHTS[k % 5]
    out = []
    for at, c in zip((np.cumsum(count) - count).tolist(), count.tolist(), strict=True):
        if c >= width:
            out.append(_sorted_set(joined[:, at : at + c - width + 1]))
        elif c:
            out.append(np.frombuffer(xxhash.xxh3_128_digest(words[:, at : at + c].T.tobytes(), seed=c), np.uint64).reshape(2, 1))
        else:
            out.append(np.zeros((2, 0), np.uint64))
    return out


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    if a.shape[1] > b.shape[1]:
        a, b = b, a
    if not a.shape[1]:
        return 0
    at = np.minimum(np.searchsorted(b[0], a[0]), b.shape[1] - 1)
    hit = b[0, at] == a[0]
    found = int((hit & (b[1, at] == a[1])).sum())
    if found < hit.sum():  # two shingles that share their first half: compare in full
        return len(set(map(tuple, a.T.tolist())) & set(map(tuple, b.T.tolist())))
    return found


def slices(sizes: list[int], most: int = 1 << 20):
    """Ranges of a batch whose sizes sum to ``most`` at most, or of one longer row."""
    at, total = 0, 0
    for i, n in enumerate(sizes):
        if i > at and total + n > most:
            yield at, i
            at, total = i, 0
        total += n
    if at < len(sizes):
        yield at, len(sizes)


def parity_bits(values: np.ndarray) -> bytes:
    """Parity bitmap of four or more bits a shingle: the number of bits in which two bitmaps differ never exceeds the size of the
    symmetric difference of the sets. The length is a power of two of bytes, and folding by XOR gives the shorter ones."""
    bits = 1 << max(8, (4 * max(1, len(values)) - 1).bit_length())
    at = (mix(values) & np.uint64(bits - 1)).astype(np.int64)
    return np.packbits(np.bincount(at, minlength=bits) & 1, bitorder="little").tobytes()


def fold(bitmap: np.ndarray, size: int) -> np.ndarray:
    while len(bitmap) > size:
        bitmap = bitmap[: len(bitmap) // 2] ^ bitmap[len(bitmap) // 2 :]
    return bitmap
