"""Word shingles of whole texts as 64-bit hashes, in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from gridloom.llm.pieces import mix64

SLICE = 1 << 21
_P = np.uint64(0x9FB21C651E98DF25)
_C = np.uint64(0xD6E8FEB86659FD93)
#: Lower-case A-Z; the six white-space bytes all become a space.
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLD[[9, 10, 11, 12, 13]] = 32


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = np.uint64(pow(int(_P), -1, 1 << 64))
    ones = np.full(n, 1, np.uint64)
    up, down = ones.copy(), ones.copy()
    up[1:] = _P
    down[1:] = inverse
    return np.cumprod(up), np.cumprod(down)


class Shingler:
    def __init__(self, words: int = 5):
        self.words = words
        self.up, self.down = _powers(1 << 16)

    def word_hashes(self, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hash and first byte of every word of raw (bytes; words end at white space)."""
        if len(raw) + 1 > len(self.up):
            self.up, self.down = _powers(1 << int(np.ceil(np.log2(len(raw) + 2))))
        code = _FOLD[raw]
        inside = code != 32
        edge = np.diff(np.r_[False, inside, False].astype(np.int8))
        start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        total = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum((code.astype(np.uint64) + np.uint64(1)) * self.up[: len(raw)], out=total[1:])
        h = (total[end] - total[start]) * self.down[start]
        return mix64(h + (end - start).astype(np.uint64) * _C), start

    def sets(self, texts: list[bytes]) -> Iterator[np.ndarray]:
        """The sorted distinct shingle hashes of each text; with fewer words, the whole sequence as one; empty without words."""
        at = 0
        while at < len(texts):
            block, held = [], 0
            while at < len(texts) and (not block or held + len(texts[at]) < SLICE):
                block.append(texts[at])
                held += len(texts[at]) + 1
                at += 1
            flat = np.frombuffer(b"\n".join(block), np.uint8)
            h, start = self.word_hashes(flat)
            size = np.fromiter(map(len, block), np.int64, len(block)) + 1
            cut = np.searchsorted(start, np.cumsum(size))
            k = self.words
            rolled = np.zeros(max(len(h) - k + 1, 0), np.uint64)
            for i in range(k):
                rolled = rolled * _C + h[i : i + len(rolled)]
            rolled = mix64(rolled + np.uint64(k))
            lo = 0
            for hi in cut.tolist():
                n = hi - lo
                if n >= k:
                    yield np.unique(rolled[lo : hi - k + 1])
                elif n:
                    one = np.zeros(1, np.uint64)
                    for x in h[lo:hi]:
                        one = one * _C + x
                    yield mix64(one + np.uint64(n))
                else:
                    yield np.zeros(0, np.uint64)
                lo = hi
