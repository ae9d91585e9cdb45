"""Vectorised hashes of words and word windows of whole texts."""

from __future__ import annotations

import numpy as np

_M = (1 << 64) - 1
_TABLE = np.random.default_rng(20240607).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_BASE, _STEP = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class _Powers:
    """base**i and its inverse modulo 2**64, kept per worker."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up, self.down = _powers(self.base, 1), _powers(self.inverse, 1)

    def of(self, n: int):
        if n > len(self.up):
            n2 = max(n, 2 * len(self.up))
            self.up, self.down = _powers(self.base, n2), _powers(self.inverse, n2)
        return self.up, self.down


    def release(self):
        self.__init__(self.base)


_BYTES, _WORDS = _Powers(_BASE), _Powers(_STEP)


def release() -> None:
    """Forget the powers: a worker may go on to other work."""
    _BYTES.release()
    _WORDS.release()


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


class Joined:
    """Words of some texts joined by single spaces, with their places; `doc_ends` counts words."""

    def __init__(self, texts: list[bytes]):
        split = [t.split() for t in texts]
        words = [w for ws in split for w in ws]
        self.words = words
        self.data = b" ".join(words)
        self.doc_ends = np.cumsum([len(ws) for ws in split], dtype=np.int64)
        lens = np.fromiter(map(len, words), np.int64, len(words))
        self.ends = np.cumsum(lens + 1) - 1
        self.starts = self.ends - lens

    def word_hashes(self) -> np.ndarray:
        n = len(self.data)
        if not n:
            return np.empty(0, np.uint64)
        up, down = _BYTES.of(n + 1)
        c = np.zeros(n + 1, np.uint64)
        np.cumsum(_TABLE[np.frombuffer(self.data, np.uint8)] * up[:n], out=c[1:])
        return mix((c[self.ends] - c[self.starts]) * down[self.starts] + (self.ends - self.starts).astype(np.uint64))

    def windows(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(first word, hash) of every window of k words inside one text, in order."""
        n = len(self.words)
        if n < k:
            return np.empty(0, np.int64), np.empty(0, np.uint64)
        up, down = _WORDS.of(n + 1)
        c = np.zeros(n + 1, np.uint64)
        np.cumsum(self.word_hashes() * up[:n], out=c[1:])
        bounds = np.concatenate(([0], self.doc_ends))
        last = np.repeat(bounds[1:], np.diff(bounds))  # per word: where its text ends
        first = np.flatnonzero(np.arange(n) + k <= last)
        return first, mix((c[first + k] - c[first]) * down[first])


def text_batches(texts: list[bytes], most: int = 1 << 20):
    """Slices of a list of texts with about `most` bytes each, never less than one text."""
    at = 0
    while at < len(texts):
        end, held = at, 0
        while end < len(texts) and (end == at or held + len(texts[end]) <= most):
            held += len(texts[end])
            end += 1
        yield at, texts[at:end]
        at = end
