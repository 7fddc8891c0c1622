"""Exact top-k search by inner product over KD-trees, one per shard.

Vectors become whole numbers, floor(scale * x). Rows are dealt to shards of about SHARD rows by a hash of the id, so equal
or clustered vectors can't fill one. A shard's tree is built once and written; it splits at the median of the widest dimension
down to leaves of LEAF rows and holds the tight bounding box of every node. A query walks a tree best first by the bound of
its boxes, sum(max(q * low, q * high)), and leaves it once the best bound is below its k-th score. First each query searches
its home shard; the k-th score found there goes with it to all other shards, where most boxes then are out of reach from
the start.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm.common import columns, scratch

SHARD, SHARD_MAX, LEAF, BLOCK = 4096, 65_536, 64, 512
#: The k-th score of a query that has no k hits yet.
LOWEST = -(1 << 63)


class Tree:
    """KD-tree over integer vectors (rows of x) with ids; exact for scores that fit 64 bits."""

    def __init__(self, x: np.ndarray, ids: np.ndarray, leaf: int = LEAF):
        order = np.arange(len(x))
        self.low, self.high, self.kids, self.span = [], [], [], []
        stack = [(0, len(x), -1)]
        while stack:
            lo, hi, parent = stack.pop()
            rows = order[lo:hi]
            part = x[rows]
            low, high = part.min(0), part.max(0)
            node = len(self.low)
            self.low.append(low); self.high.append(high); self.kids.append([]); self.span.append((lo, hi))
            if parent >= 0:
                self.kids[parent].append(node)
            wide = int((high.astype(np.float64) - low).argmax()) if len(low) else 0
            if hi - lo > leaf and len(low) and high[wide] > low[wide]:
                mid = (hi - lo) // 2
                order[lo:hi] = rows[np.argpartition(part[:, wide], mid)]
                stack += [(lo, lo + mid, node), (lo + mid, hi, node)]
        self.x, self.ids = x[order], ids[order]
        self.low, self.high = np.stack(self.low), np.stack(self.high)

    def bounds(self, q: np.ndarray) -> np.ndarray:
        """The largest score that each node can hold for each query."""
        up, down = np.maximum(q, 0), np.minimum(q, 0)
        return up @ self.high.T + down @ self.low.T

    def search(self, q: np.ndarray, own: np.ndarray, k: int, kth: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each query row: its k best (score descending, id ascending) among rows whose id isn't its own and whose
        score isn't below kth."""
        bound = self.bounds(q)
        for i in range(len(q)):
            b, least = bound[i], kth[i]
            heap = [(-b[0], 0)]
            scores = np.zeros(0, q.dtype)
            ids = np.zeros(0, np.int64)
            while heap:
                top, node = heapq.heappop(heap)
                if -top < least:
                    break
                if self.kids[node]:
                    for kid in self.kids[node]:
                        if b[kid] >= least:
                            heapq.heappush(heap, (-b[kid], kid))
                    continue
                lo, hi = self.span[node]
                s = self.x[lo:hi] @ q[i]
                ok = (s >= least) & (self.ids[lo:hi] != own[i])
                if ok.any():
                    scores = np.concatenate([scores, s[ok]])
                    ids = np.concatenate([ids, self.ids[lo:hi][ok]])
                    if len(scores) > k:
                        best = np.lexsort((ids, -scores))[:k]
                        scores, ids = scores[best], ids[best]
                    if len(scores) == k:
                        least = max(least, scores.min())
            best = np.lexsort((ids, -scores))[:k]
            yield i, scores[best], ids[best]


def _compact(x: np.ndarray) -> np.ndarray:
    """Whole numbers in the smallest type that holds them."""
    top = max(abs(int(x.min())), abs(int(x.max()))) if x.size else 0
    return x.astype(next(t for t in (np.int8, np.int16, np.int32, np.int64) if top <= np.iinfo(t).max or t is np.int64))


def _searched(tree: Tree, part: pd.DataFrame, k: int) -> pd.DataFrame:
    """The hits of the queries of part (query_id, q, kth) in one tree."""
    q = np.stack(part["q"].to_list()).astype(np.int64)
    # doubles while every sum of products is exact in them, else 64-bit integers
    largest = float(np.abs(tree.x.astype(np.float64)).max(initial=0)) * float(np.abs(q.astype(np.float64)).max(initial=0))
    kind = np.float64 if largest * max(q.shape[1], 1) < 2**51 else np.int64
    if tree.x.dtype != kind:
        tree.x, tree.low, tree.high = tree.x.astype(kind), tree.low.astype(kind), tree.high.astype(kind)
    kth = part["kth"].to_numpy(np.int64)
    if kind is np.float64:
        kth = np.where(kth == LOWEST, -np.inf, kth.astype(np.float64))
    own, found = part["query_id"].to_numpy(np.int64), []
    for at in range(0, len(q), BLOCK):
        cut = slice(at, at + BLOCK)
        for i, scores, ids in tree.search(q[cut].astype(kind), own[cut], k, kth[cut]):
            found.append((np.full(len(ids), own[at + i]), ids, scores.astype(np.int64)))
    columns_ = zip(*found) if found else [[np.zeros(0, np.int64)]] * 3
    return pd.DataFrame({c: np.concatenate(v) for c, v in zip(("query_id", "vec_id", "score"), columns_)})


def top_k(
    vectors: DataFrame, k: int = 5, scale: int = 256, every: int = 50, id_col: str = "vec_id", vec_col: str = "embedding", shard: int | None = None
) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k highest integer inner products for each query.

    Queries are the rows whose id is divisible by ``every``; candidates are all rows but those with the query's own id
    (all there are, if fewer than k); equal scores go to the smaller id. Vectors that are null or hold null or
    non-finite components, and rows without an id, take no part. Vectors of different lengths aren't compared.
    Scores are exact as long as they fit 64 bits. Ids are any 64-bit integers. Repeated rows are candidates of their own, and one query. Empty table: no rows. Extra columns of any name are ignored.

    ``shard`` is the number of vectors of a shard; without it, one 256th of the table between SHARD and SHARD_MAX. A shard's tree is
    built once and written. It then meets the queries by (length, shard): a task takes its tree and after it the queries,
    batch by batch, so that it holds one tree and one batch whatever their numbers.
    """
    base = columns(vectors, id_col, vec_col).toDF("vec_id", "v")
    sound = (
        F.col("vec_id").isNotNull()
        & F.col("v").isNotNull()
        & ~F.exists("v", lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    )
    whole = base.where(sound).select(
        F.col("vec_id").cast("long").alias("vec_id"), F.transform("v", lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("long")).alias("v")
    )
    whole = scratch(whole.withColumn("dim", F.size("v")), "vectors")
    size = F.lit(float(shard)) if shard else F.least(F.greatest(F.col("count") / 256, F.lit(float(SHARD))), F.lit(float(SHARD_MAX)))
    sizes = scratch(whole.groupBy("dim").count().select("dim", F.ceil(F.col("count") / size).cast("int").alias("shards")), "shard-numbers")
    tasks = min(sizes.agg(F.sum("shards")).first()[0] or 1, 20_000)
    rows = whole.join(F.broadcast(sizes), "dim").withColumn("shard", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.col("shards")).cast("int"))

    def build(key: tuple, data: pd.DataFrame) -> pd.DataFrame:
        tree = Tree(_compact(np.stack(data["v"].to_list()).astype(np.int64)), data["vec_id"].to_numpy(np.int64))
        return pd.DataFrame({"dim": [key[0]], "shard": [key[1]], "tree": [pickle.dumps(tree)]})

    trees = rows.select("dim", "shard", "vec_id", "v").repartition(tasks, "dim", "shard").groupBy("dim", "shard").applyInPandas(build, "dim int, shard int, tree binary")
    # no nulls in the ids of a batch: pandas would make doubles of them
    trees = scratch(trees, "trees").withColumns({"query_id": F.lit(0).cast("long"), "q": F.lit(None).cast("array<long>"), "kth": F.lit(0).cast("long")})
    asks = rows.where(F.col("vec_id") % every == 0).select("dim", "shards", F.col("shard").alias("home"), F.col("vec_id").alias("query_id"), F.col("v").alias("q"))
    asks = scratch(asks.dropDuplicates(["query_id", "q"]), "queries")

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tree, at = None, None
        for batch in batches:
            for key, part in batch.groupby(["dim", "shard"], sort=False):
                held = part[part["tree"].notna()]
                if len(held):
                    tree, at = pickle.loads(held["tree"].iloc[0]), key
                part = part[part["tree"].isna()]
                if len(part) and key == at:
                    yield _searched(tree, part, k)

    def visit(some: DataFrame) -> DataFrame:
        stream = trees.unionByName(some.select("dim", "shard", F.lit(None).cast("binary").alias("tree"), "query_id", "q", "kth"))
        dealt = stream.repartition(tasks, "dim", "shard").sortWithinPartitions("dim", "shard", F.col("tree").isNull())
        return dealt.mapInPandas(search, "query_id long, vec_id long, score long")

    first = scratch(visit(asks.withColumn("shard", F.col("home")).withColumn("kth", F.lit(LOWEST))), "home-hits")
    kth = first.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score")).alias("kth"))
    away = asks.where("shards > 1").join(kth, "query_id", "left").withColumn("kth", F.coalesce("kth", F.lit(LOWEST)))
    away = away.withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("shards") - 1))).where("shard <> home")
    hits = first.union(visit(away))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("vec_id")))
    return hits.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
