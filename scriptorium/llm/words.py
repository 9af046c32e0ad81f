"""Words of a text as 64-bit hashes, and small tools on arrays of hashes."""

from __future__ import annotations

import numpy as np
import xxhash
import zstandard

ODD = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose output bits all depend on the input."""
    x = (x ^ (x >> np.uint64(33))) * ODD[3]
    x = (x ^ (x >> np.uint64(29))) * ODD[4]
    return x ^ (x >> np.uint64(32))


class WordHasher:
    """Hashes of a text's words: runs of non-ASCII-space bytes, A-Z in lower case."""

    def __init__(self, capacity: int = 600_000):
        self.known: dict[bytes, int] = {}
        self.capacity = capacity

    def __call__(self, text: str | None) -> np.ndarray:
        if not text:
            return np.zeros(0, np.uint64)
        words = text.encode().lower().split()
        known = self.known
        out = list(map(known.get, words))
        if None in out:
            if len(known) > self.capacity:
                known.clear()
            for i, h in enumerate(out):
                if h is None:
                    w = words[i]
                    out[i] = known[w] = known.get(w) or xxhash.xxh3_64_intdigest(w)
        return np.array(out, np.uint64)


def squeezed(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """Sorted keys with counts, as compressed byte planes of the differences."""
    step = np.diff(keys, prepend=np.uint64(0)).astype("<u8")
    planes = [step.view(np.uint8).reshape(-1, 8).T, np.ascontiguousarray(counts, "<u4").view(np.uint8).reshape(-1, 4).T]
    return zstandard.ZstdCompressor(level=1).compress(np.concatenate(planes).tobytes())


def unsqueezed(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """What :func:`squeezed` took."""
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8).reshape(12, -1)
    step = np.ascontiguousarray(planes[:8].T).view("<u8")[:, 0]
    return np.cumsum(step, dtype=np.uint64), np.ascontiguousarray(planes[8:].T).view("<u4")[:, 0].astype(np.int64)


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, with their total counts."""
    if not len(keys):
        return keys, counts
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(counts, first)
