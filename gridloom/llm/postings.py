"""Inverted lists of shards of documents, built in tasks: a shard is a run of whole documents of one task with about SHARD bytes of text."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa

#: Bytes of text in a shard (a longer document is a shard of its own) and in a slice that is split into words at once.
SHARD, SLICE, ROWS = 1 << 25, 1 << 20, 1 << 15


def slices(raw: bytes, ends: bytes = b" ") -> Iterator[bytes]:
    """raw in parts of about SLICE bytes that are cut after a byte of ``ends``; a part is longer where there is none."""
    at = 0
    while len(raw) - at > SLICE:
        cut = max(raw.rfind(e, at, at + SLICE) for e in (ends[i : i + 1] for i in range(len(ends)))) + 1
        if cut <= at:
            cut = min((x for x in (raw.find(ends[i : i + 1], at) for i in range(len(ends))) if x >= 0), default=len(raw) - 1) + 1
        yield raw[at:cut]
        at = cut
    yield raw[at:]


class Shard:
    """Words of documents as numbers in order of appearance; each vocabulary (a language, say) has numbers of its own."""

    def __init__(self) -> None:
        self.number = count()
        self.words: dict[object, defaultdict[bytes, int]] = {}
        self.ids: list[np.ndarray] = []
        self.lengths: list[int] = []
        self.size = 0

    def add(self, parts: Iterator[list[bytes]], n_bytes: int, of: object = None) -> None:
        """One document: lists of words that follow each other."""
        if of not in self.words:
            self.words[of] = defaultdict(self.number.__next__)
        look = self.words[of].__getitem__
        ids = [np.fromiter(map(look, p), np.int32, len(p)) for p in parts]
        self.ids += ids
        self.lengths.append(sum(map(len, ids)))
        self.size += n_bytes + 64

    def tokens(self) -> tuple[np.ndarray, np.ndarray]:
        """Word number and document number of every occurrence."""
        ids = np.concatenate(self.ids) if self.ids else np.zeros(0, np.int32)
        return ids, np.repeat(np.arange(len(self.lengths), dtype=np.int32), self.lengths)

    def vocabulary(self) -> tuple[list[bytes], list[object]]:
        """All words by number, and the vocabulary of each."""
        pairs = [(n, w, of) for of, words in self.words.items() for w, n in words.items()]
        pairs.sort(key=lambda p: p[0])
        return [p[1] for p in pairs], [p[2] for p in pairs]


def blobs(values: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """One binary value for each length: so many of the values, end to end."""
    ends = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths * values.itemsize, out=ends[1:])
    return pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(values))])


def pieces_of(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    for at in range(0, batch.num_rows, ROWS):
        yield batch.slice(at, ROWS)


def packed(values: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """One binary value for each length: so many of the values (below 2^63, seven bits a byte, the last byte of a value without the top bit)."""
    values = values.astype(np.uint64)
    n = np.ones(len(values), np.int64)
    for k in range(1, 9):
        n += values >= np.uint64(1 << 7 * k)
    ends = np.cumsum(n)
    out = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint8)
    for k in range(int(n.max(initial=0))):
        some = n > k
        more = np.where(n[some] > k + 1, 128, 0).astype(np.uint8)
        out[ends[some] - n[some] + k] = ((values[some] >> np.uint64(7 * k)) & np.uint64(127)).astype(np.uint8) | more
    offsets = np.r_[0, ends][np.r_[0, np.cumsum(lengths)]].astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(offsets), pa.py_buffer(out)])


def unpacked(raw: bytes) -> np.ndarray:
    """The values of packed blobs, end to end."""
    got = np.frombuffer(raw, np.uint8)
    last = np.flatnonzero(got < 128)
    start = np.r_[0, last[:-1] + 1] if len(last) else last
    n = last - start + 1
    out = np.zeros(len(last), np.uint64)
    for k in range(int(n.max(initial=0))):
        some = n > k
        out[some] |= (got[start[some] + k] & np.uint8(127)).astype(np.uint64) << np.uint64(7 * k)
    return out.astype(np.int64)


def deltas(at: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Ascending positions of lists end to end, as differences inside each list (small numbers pack well)."""
    out = np.diff(at, prepend=0)
    starts = np.cumsum(lengths) - lengths
    out[starts] = at[starts]
    return out


def positions(steps: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The positions that deltas stand for; no list is empty."""
    total = np.cumsum(steps)
    starts = np.cumsum(lengths) - lengths
    return total - np.repeat(total[starts] - steps[starts], lengths)
