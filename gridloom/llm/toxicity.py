"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word (ASCII white space around it, A-Z lower-cased) is the bag of its character n-grams with end marks and of itself,
hashed to BUCKETS rows of an embedding table, so that misspelt words share most of their vectors with the
word they come from. A text is scored in segments of SEGMENT words that cover all of it: the segment's
embeddings are averaged into a softmax of two classes, and the text has the score of its most toxic
segment, so that a few bad words in a long text aren't averaged away. With ``segment=None`` the embeddings of the whole text
are averaged instead (the README has both figures).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.labelled import labelled_sample
from gridloom.llm.pieces import mix64, parts

BUCKETS, DIM, SEGMENT, WHOLE = 1 << 19, 8, 8, 1 << 40
GRAMS = (3, 4, 5, 6)
WARM = 4
MEMO = 400_000


def subwords(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Bucket ids of all words' subwords end to end, and how many each word has."""
    marked = b"".join(b"<" + w + b">" for w in words)
    size = np.fromiter(map(len, words), np.int64, len(words)) + 2
    code = np.frombuffer(marked, np.uint8).astype(np.uint64)
    owner = np.repeat(np.arange(len(words)), size)
    end = np.repeat(np.cumsum(size), size)
    place = np.arange(len(code))
    ids, own = [], []
    rolling = np.zeros(len(code), np.uint64)
    for k in range(1, max(GRAMS) + 1):
        part = np.zeros(len(code), np.uint64)
        part[: len(code) - k + 1] = code[k - 1 :] + np.uint64(1)
        rolling = rolling * np.uint64(0x100000001B3) + part
        if k in GRAMS:
            ok = place + k <= end
            ids.append(mix64(rolling[ok] + np.uint64(k)) % np.uint64(BUCKETS))
            own.append(owner[ok])
    power = np.cumprod(np.r_[np.uint64(1), np.full(int(size.max()) if len(size) else 0, 0x100000001B3, np.uint64)])
    start = np.repeat(np.cumsum(size) - size, size)
    whole = np.add.reduceat(code * power[place - start], np.cumsum(size) - size) if len(words) else np.zeros(0, np.uint64)
    ids.append(mix64(whole + np.uint64(99)) % np.uint64(BUCKETS))
    own.append(np.arange(len(words)))
    all_ids, all_own = np.concatenate(ids).astype(np.int64), np.concatenate(own)
    order = np.argsort(all_own, kind="stable")
    return all_ids[order].astype(np.int32), np.bincount(all_own, minlength=len(words)).astype(np.int32)


def words_of(text: bytes) -> list[bytes]:
    return text.lower().split()


class SubwordSoftmax:
    def __init__(self, seed: int = 6, segment: int | None = SEGMENT):
        rng = np.random.default_rng(seed)
        self.segment = segment or WHOLE
        self.embed = rng.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32)
        self.out = rng.normal(0, 0.3, (DIM, 2)).astype(np.float32)
        self.bias = np.zeros(2, np.float32)
        self.known: dict[bytes, tuple[float, int]] = {}
        self.value: np.ndarray | None = None

    def __getstate__(self) -> dict:
        """What tasks need: each bucket's share of the difference of the two class scores, and the bias."""
        return {"value": self.values(), "gap": self.gap(), "segment": self.segment}

    def gap(self) -> float:
        return self.__dict__["gap_"] if "gap_" in self.__dict__ else float(self.bias[1] - self.bias[0])

    def __setstate__(self, state: dict) -> None:
        self.value, self.gap_, self.segment, self.known = state["value"], state["gap"], state["segment"], {}

    def values(self) -> np.ndarray:
        return self.value if self.value is not None else self.embed @ (self.out[:, 1] - self.out[:, 0])

    def fit(self, texts: list[bytes], y: np.ndarray, epochs: int = 24, batch: int = 64, rate: float = 0.25, seed: int = 7) -> None:
        """Adagrad on the softmax loss of one segment of each text: any one in the first epochs (four times as long),
        then the one with the highest score so far."""
        full = [i for i, t in enumerate(texts) if words_of(t)]  # a text without words has no embedding to learn from
        texts, y = [texts[i] for i in full], y[full]
        if not len(y) or y.min() == y.max():  # nothing to tell apart: the prior
            self.embed[:] = 0
            self.bias[:] = (0.0, 0.0) if not len(y) else (-2.0, 2.0) if y[0] else (2.0, -2.0)
            return
        rng = np.random.default_rng(seed)
        vocabulary: dict[bytes, int] = {}
        docs = [np.fromiter((vocabulary.setdefault(w, len(vocabulary)) for w in words_of(t)), np.int32) for t in texts]
        listed = list(vocabulary)
        found = [subwords(listed[k : k + 20_000]) for k in range(0, len(listed), 20_000)]
        ids, n = np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])
        del listed, found, vocabulary
        first = np.cumsum(n, dtype=np.int64) - n
        weight = np.where(y == 1, 0.5 / (y == 1).mean(), 0.5 / (y == 0).mean())
        seen = np.full(BUCKETS, 1e-6, np.float32)
        seen_out, seen_bias = np.full((DIM, 2), 1e-3, np.float32), np.full(2, 1e-3, np.float32)
        for epoch in range(epochs):
            value = np.add.reduceat(self.values()[ids], first)
            order = rng.permutation(len(y))
            for at in range(0, len(order), batch):
                pick = order[at : at + batch]
                chosen = []
                for i in pick:
                    w = docs[i]
                    if epoch < WARM:
                        k = int(rng.integers(max(1, len(w) - 4 * self.segment)))
                        w = w[k : k + 4 * self.segment]
                    elif len(w) > self.segment:
                        cut = np.arange(0, len(w), self.segment)
                        k = int((np.add.reduceat(value[w], cut) / np.add.reduceat(n[w], cut)).argmax())
                        w = w[k * self.segment : (k + 1) * self.segment]
                    chosen.append(w)
                words = np.concatenate(chosen)
                held = np.array([n[w].sum(dtype=np.int64) for w in chosen])
                each = n[words].astype(np.int64)
                subs = ids[np.repeat(first[words], each) + np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)]
                begin = np.cumsum(held) - held
                bag = np.add.reduceat(self.embed[subs], begin) / held[:, None]
                z = bag @ self.out + self.bias
                p = np.exp(z - z.max(1, keepdims=True))
                p /= p.sum(1, keepdims=True)
                p[np.arange(len(pick)), y[pick]] -= 1
                d = (p * weight[pick, None]).astype(np.float32)
                d_bag = d @ self.out.T / held[:, None]
                # sum the gradient per bucket, then one Adagrad step
                order_ = np.argsort(subs, kind="stable")
                sorted_ = subs[order_]
                lead = np.flatnonzero(np.r_[True, sorted_[1:] != sorted_[:-1]])
                rows = sorted_[lead]
                g = np.add.reduceat(np.repeat(d_bag, held, 0)[order_], lead)
                seen[rows] += (g * g).mean(1)
                self.embed[rows] -= rate * g / np.sqrt(seen[rows])[:, None]
                g_out, g_bias = bag.T @ d / len(pick), d.mean(0)
                seen_out += g_out**2
                seen_bias += g_bias**2
                self.out -= 0.1 * g_out / np.sqrt(seen_out)
                self.bias -= 0.1 * g_bias / np.sqrt(seen_bias)

    def learn(self, words: set[bytes]) -> None:
        """Sum of values and number of subwords of the words not met before."""
        if len(self.known) > MEMO:
            self.known.clear()
        new = list(words - self.known.keys())
        value = self.values()
        for at in range(0, len(new), 20_000):
            block = new[at : at + 20_000]
            ids, n = subwords(block)
            sums = np.add.reduceat(value[ids], np.cumsum(n) - n)
            self.known.update(zip(block, zip(sums.tolist(), n.tolist())))

    def score(self, texts: list[bytes]) -> np.ndarray:
        """Softmax probability of class 1 for each text; one without words has the score of the bias alone. Texts are taken in parts
        of about 1 MB."""
        best, total = np.full(len(texts), -np.inf), np.zeros((len(texts), 2))
        block: list[tuple[int, list[bytes]]] = []
        held = 0

        def flush() -> None:
            self.learn(set().union(*(w for _, w in block)))
            words = [w for _, ws in block for w in ws]
            if words:
                pairs = np.array(list(map(self.known.__getitem__, words)))
                size = np.array([len(ws) for _, ws in block])
                size, of = size[size > 0], np.array([i for i, ws in block if ws])
                pieces = -(-size // self.segment)
                at = np.repeat(np.cumsum(size) - size, pieces)
                at = at + (np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * min(self.segment, len(words))
                sums = np.add.reduceat(pairs, at)
                first = np.cumsum(pieces) - pieces
                np.maximum.at(best, of, np.maximum.reduceat(sums[:, 0] / sums[:, 1], first))
                np.add.at(total, of, np.add.reduceat(sums, first))
            block.clear()

        for i, text in enumerate(texts):
            for part in parts(text):
                block.append((i, words_of(part)))
                held += len(part)
                if held > 1 << 21:
                    flush()
                    held = 0
        if block:
            flush()
        if self.segment == WHOLE:
            best = np.where(total[:, 1] > 0, total[:, 0] / np.maximum(total[:, 1], 1), -np.inf)
        z = np.where(np.isinf(best), 0.0, best) + self.gap()
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def train_toxicity(
    docs: DataFrame, labels: DataFrame, usable: Column, label_col: str = "toxic", max_docs: int = 4000, segment: int | None = SEGMENT
) -> SubwordSoftmax:
    """Fit on at most max_docs labelled documents for which usable holds (see labelled_sample). Without labels, or with those of one class
    only, the model is the prior; labelled texts without words are passed over."""
    model = SubwordSoftmax(segment=segment)
    model.fit(*labelled_sample(docs, labels, label_col, usable, max_docs, share=0.35))
    return model


def toxicity_score(model: SubwordSoftmax, text: Column) -> Column:
    """Score from 0 to 1 of each whole text, however long; null counts as empty. Only the text is an input, so repeated rows score
    alike; an empty table has no scores."""

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for raw in batches:
            yield pd.Series(model.score(raw.tolist()), dtype="float64")

    return score(F.coalesce(text, F.lit("")).cast("binary"))
