"""Hashes of word shingles, and what near-dedup keeps of them.

Defined results: a null text is an empty one; a text without words has no hashes, fingerprint 0 and the set of the empty
text; one with fewer words than a shingle is one shingle; repeated shingles count each time in a fingerprint and once in
a set; very long texts are unpacked block by block; rows are hashed one by one, so repeated rows and empty tables need no care.
"""

from __future__ import annotations

import numpy as np
import xxhash

SEED = 42
#: Shingles whose bits are unpacked at once, so that a very long text needs no more memory than this.
BLOCK = 1 << 16


def shingle_hashes(text: bytes | None, shingle: int) -> np.ndarray:
    """XXH64 of each run of ``shingle`` words of ``text`` (UTF-8, ASCII lower-cased), repeats included; fewer words are one run; none for no words."""
    words = (text or b"").lower().split()
    if not words:
        return np.zeros(0, "<u8")
    digest = xxhash.xxh64_intdigest
    joined = b" ".join(words)
    if len(words) <= shingle:
        return np.array([digest(joined, SEED)], dtype="<u8")
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = (ends - sizes).tolist()
    ends = ends[shingle - 1 :].tolist()
    return np.array([digest(joined[a:b], SEED) for a, b in zip(starts, ends)], dtype="<u8")


def simhash(hashes: np.ndarray) -> int:
    """The bits that are set in over half the hashes, as a signed 64-bit integer; 0 for no hashes."""
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), BLOCK):
        bits = np.unpackbits(hashes[at : at + BLOCK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    value = int.from_bytes(np.packbits(counts * 2 > len(hashes), bitorder="little").tobytes(), "little")
    return value - (1 << 64) if value >> 63 else value


def hash_set(hashes: np.ndarray) -> np.ndarray:
    """Sorted distinct hashes as signed integers; the set of no hashes holds that of the empty text."""
    if not len(hashes):
        hashes = np.array([xxhash.xxh64_intdigest(b"", SEED)], dtype="<u8")
    return np.unique(hashes.view(np.int64))


def set_hash(hs: np.ndarray) -> int:
    """One signed 64-bit hash of a whole set."""
    value = xxhash.xxh64_intdigest(hs.tobytes(), SEED)
    return value - (1 << 64) if value >> 63 else value
