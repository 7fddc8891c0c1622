"""Quality classifier: a byte-level convolutional network in numpy.

A text's bytes are covered by overlapping chunks. In each chunk every filter (WIDTH bytes wide, over learned byte
vectors) is evaluated at every byte and max-pooled; the pooled values of all chunks of a text are combined
by mean and maximum into one logistic score. The whole text counts, however long it is; memory is bounded by
processing BLOCK chunks at a time.

GROUP neighbouring windows are evaluated by one row of a product: the filters are laid out GROUP times, each a byte further, so a
byte's vector is copied three times instead of WIDTH times.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.labelled import labelled_sample

CHUNK, HOP, WIDTH, DIM, FILTERS = 1023, 960, 16, 8, 40
WINDOWS, GROUP = CHUNK - WIDTH + 1, 8  # GROUP divides WINDOWS
BLOCK = 64


def chunked(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Chunks (n, CHUNK) of byte codes, padded with zero bytes, and the number of chunks of each text (1 at least)."""
    n = np.array([max(1, -(-(len(t) - (CHUNK - HOP)) // HOP)) for t in texts], np.int64)
    room = (n - 1) * HOP + CHUNK
    flat = np.zeros(int(room.sum()), np.uint8)
    start = np.cumsum(room) - room
    for s, t in zip(start.tolist(), texts):
        flat[s : s + len(t)] = np.frombuffer(t, np.uint8)
    first = np.repeat(start, n) + HOP * (np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n))
    return np.lib.stride_tricks.sliding_window_view(flat, CHUNK)[first], n


class ByteConvNet:
    def __init__(self, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.p = {
            "embed": rng.normal(0, 0.5, (256, DIM)).astype(np.float32),
            "filters": rng.normal(0, (2 / (WIDTH * DIM)) ** 0.5, (WIDTH * DIM, FILTERS)).astype(np.float32),
            "shift": np.zeros(FILTERS, np.float32),
            "out": np.zeros(2 * FILTERS, np.float32),
            "bias": np.zeros(1, np.float32),
        }

    def laid_out(self) -> np.ndarray:
        """The filters as ((GROUP + WIDTH - 1) * DIM, GROUP * FILTERS), each of the GROUP copies DIM rows further down."""
        out = np.zeros(((GROUP + WIDTH - 1) * DIM, GROUP, FILTERS), self.p["filters"].dtype)
        for k in range(GROUP):
            out[k * DIM : (k + WIDTH) * DIM, k] = self.p["filters"]
        return out.reshape(len(out), GROUP * FILTERS)

    def responses(self, chunks: np.ndarray, filters: np.ndarray) -> np.ndarray:
        """(n, WINDOWS / GROUP, GROUP * FILTERS): the filters, laid out, at every byte of the chunks at which a window starts."""
        x = self.p["embed"][chunks].reshape(len(chunks), CHUNK * DIM)
        x = np.lib.stride_tricks.sliding_window_view(x, len(filters), axis=1)[:, :: GROUP * DIM]
        return (x.reshape(-1, len(filters)) @ filters).reshape(len(chunks), WINDOWS // GROUP, GROUP * FILTERS)

    def pooled(self, chunks: np.ndarray) -> np.ndarray:
        out, filters = np.empty((len(chunks), FILTERS), np.float32), self.laid_out()
        for at in range(0, len(chunks), BLOCK):
            out[at : at + BLOCK] = self.responses(chunks[at : at + BLOCK], filters).max(1).reshape(-1, GROUP, FILTERS).max(1)
        return np.maximum(out + self.p["shift"], 0)

    def logits(self, h: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.cumsum(n) - n
        doc = np.concatenate([np.add.reduceat(h, at) / n[:, None], np.maximum.reduceat(h, at)], 1).astype(np.float32)
        return doc @ self.p["out"] + self.p["bias"], doc

    def score(self, texts: list[bytes]) -> np.ndarray:
        """Probability of label 1 for each text; an empty one scores as one chunk of padding."""
        out, at = [], 0
        while at < len(texts):  # so many texts at a time that their chunks stay few
            block, held = [], 0
            while at < len(texts) and (not block or held + len(texts[at]) < BLOCK * HOP * 4):
                block.append(texts[at])
                held += len(texts[at])
                at += 1
            chunks, n = chunked(block)
            h = np.concatenate([self.pooled(chunks[k : k + BLOCK]) for k in range(0, len(chunks), BLOCK)])
            out.append(self.logits(h, n)[0])
        z = np.concatenate(out).astype(np.float64) if out else np.zeros(0)
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    def fit(self, texts: list[bytes], y: np.ndarray, steps: int = 400, batch: int = 24, rate: float = 0.005, seed: int = 4) -> None:
        """Adam on the logistic loss; the number of steps is fixed, so the cost doesn't depend on the sample."""
        if not len(y) or y.min() == y.max():  # nothing to tell apart: the prior
            self.p["bias"][:] = 0.0 if not len(y) else (4.0 if y[0] else -4.0)
            return
        rng = np.random.default_rng(seed)
        weight = np.where(y == 1, 0.5 / (y == 1).mean(), 0.5 / (y == 0).mean())
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        s = {k: np.zeros_like(v) for k, v in self.p.items()}
        self.p["out"] = rng.normal(0, 0.1, 2 * FILTERS).astype(np.float32)
        for step in range(1, steps + 1):
            pick = rng.choice(len(y), min(batch, len(y)), replace=False)
            grads = self.gradients([texts[i] for i in pick], y[pick], weight[pick])
            lr = rate * min(1.0, 2 * (1 - (step - 1) / steps))
            for k, g in grads.items():
                m[k] += 0.1 * (g - m[k])
                s[k] += 0.01 * (g * g - s[k])
                self.p[k] -= lr * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.99**step)) + 1e-7)

    def gradients(self, texts: list[bytes], y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        chunks, n = chunked(texts)
        c = len(chunks)
        best = np.empty((c, FILTERS), np.int64)
        raw = np.empty((c, FILTERS), np.float32)
        filters = self.laid_out()
        for at in range(0, c, BLOCK):
            z = self.responses(chunks[at : at + BLOCK], filters)
            value = z.max(1).reshape(-1, GROUP, FILTERS)
            copy = value.argmax(1)  # which of the GROUP copies won
            place = np.take_along_axis(z, (copy * FILTERS + np.arange(FILTERS))[:, None], 2).argmax(1)
            best[at : at + BLOCK], raw[at : at + BLOCK] = place * GROUP + copy, value.max(1)
        h = np.maximum(raw + self.p["shift"], 0)
        z, doc = self.logits(h, n)
        d = ((1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) * weight / len(y)).astype(np.float32)
        of = np.repeat(np.arange(len(n)), n)
        d_doc = d[:, None] * self.p["out"]
        at = np.cumsum(n) - n
        top = h == np.maximum.reduceat(h, at)[of]
        dh = d_doc[of, :FILTERS] / n[of, None] + d_doc[of, FILTERS:] * top / np.maximum(np.add.reduceat(top.astype(np.float32), at), 1)[of]
        dh = dh * (h > 0)
        bytes_at = chunks[np.arange(c)[:, None, None], best[:, :, None] + np.arange(WIDTH)]  # (c, FILTERS, WIDTH)
        x = self.p["embed"][bytes_at].reshape(c, FILTERS, WIDTH * DIM)
        d_filters = np.einsum("cf,cfk->kf", dh, x)
        dx = (dh[:, :, None] * self.p["filters"].T[None]).reshape(-1, DIM)
        cells = (bytes_at.reshape(-1, 1).astype(np.int64) * DIM + np.arange(DIM)).reshape(-1)
        d_embed = np.bincount(cells, dx.reshape(-1), 256 * DIM).reshape(256, DIM).astype(dx.dtype)
        return {"embed": d_embed, "filters": d_filters, "shift": dh.sum(0), "out": doc.T @ d, "bias": d.sum(keepdims=True)}


def train_quality(docs: DataFrame, labels: DataFrame, usable: Column, label_col: str = "quality", max_docs: int = 3000) -> ByteConvNet:
    """Fit on at most max_docs labelled documents for which usable holds (see labelled_sample). Without labels, or with those of one
    class only, the net is the prior."""
    net = ByteConvNet()
    net.fit(*labelled_sample(docs, labels, label_col, usable, max_docs))
    return net


def quality_score(net: ByteConvNet, text: Column) -> Column:
    """Score from 0 to 1 of each whole text, however long; null counts as empty. Only the text is an input, so repeated rows score
    alike; an empty table has no scores."""

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for raw in batches:
            yield pd.Series(net.score(raw.tolist()), dtype="float64")

    return score(F.coalesce(text, F.lit("")).cast("binary"))
