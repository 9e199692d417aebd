"""Learned graphs over all nodes: each node's strongest neighbours by products of embeddings, without a row for every pair.

Sources are taken in blocks of bounded size that are broadcast; candidates are read where
they lie, batch by batch. Per source a task keeps the running maximum and sum of
exponentials (for the softmax over all candidates) and its k best, and leaves only these;
an aggregation joins what tasks have left.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorloom.operators.storage import blocks_of, dealt, kept, matrix


class RunningRows:
    """Of each source (a row of `asked`) the maximum and the sum of exponentials of its scores, and its k best, ties to the smaller id.

    Scores are made in tiles that stay in cache. Of a tile only those that may enter a
    source's k best are looked at again; they wait until there are enough of them to be merged.
    """

    def __init__(self, ids, asked, k: int, own: bool, curve: str, alpha: float, softmax: bool):
        import numpy as np

        self.ids, self.asked, self.k, self.own, self.curve, self.alpha, self.softmax = ids, asked, k, own, curve, alpha, softmax
        self.late = curve == "tanh" and not softmax and alpha > 0  # the curve is rising: only scores that may enter need it
        self.top, self.total = np.full(len(ids), -np.inf), np.zeros(len(ids))
        # The k best by falling score (at twelve digits) and id; places not yet taken are minus infinity.
        self.scores, self.rounded = np.full((len(ids), k), -np.inf), np.full((len(ids), k), -np.inf)
        self.names = np.full((len(ids), k), np.iinfo(np.int64).max)
        self.low = np.full(len(ids), -np.inf)  # products below it cannot enter
        self.waiting: list = []
        self.size = 0

    def _curved(self, r):
        import numpy as np

        return np.maximum(np.tanh(self.alpha * r) if self.curve == "tanh" else r, 0.0)

    def _bound(self, least):
        """A product a little below that of the k-th best score, as scores are compared at twelve digits."""
        import numpy as np

        if self.late:
            return np.where(least > 1e-11, np.arctanh(np.clip(least - 4e-12, 0.0, 1 - 4e-12)) / self.alpha * (1 - 1e-9), -np.inf)
        return least - 1e-11 - 1e-12 * np.where(np.isfinite(least), np.abs(least), 0.0)

    def add(self, names, vectors, tile: int = 512) -> None:
        import numpy as np

        turned = np.ascontiguousarray(vectors.T)
        for lo in range(0, len(self.ids), tile):
            rows = slice(lo, min(lo + tile, len(self.ids)))
            r = self.asked[rows] @ turned
            r = r if self.late else self._curved(r)
            if not self.own:
                at = np.minimum(np.searchsorted(self.ids[rows], names), len(r) - 1)
                hit = np.flatnonzero(self.ids[rows][at] == names)
                r[at[hit], hit] = -np.inf
            if self.softmax:
                high = np.maximum(self.top[rows], r.max(axis=1, initial=-np.inf))
                at = np.where(np.isfinite(high), high, 0.0)
                self.total[rows] = self.total[rows] * np.exp(self.top[rows] - at) + np.exp(r - at[:, None]).sum(axis=1)
                self.top[rows] = high
            fresh = np.flatnonzero(np.isneginf(self.low[rows]))
            if len(fresh) and r.shape[1] > self.k:
                kth = np.partition(r[fresh], r.shape[1] - self.k, axis=1)[:, r.shape[1] - self.k]
                self.low[fresh + lo] = np.where(np.isfinite(kth), self._bound(self._curved(kth) if self.late else kth), -np.inf)
            row, col = np.divmod(np.flatnonzero(r >= self.low[rows, None]), r.shape[1])
            raw = r[row, col]
            score, ids, row = self._curved(raw) if self.late else raw, names[col], row + lo
            rounded = np.round(score, 12) + 0.0
            last = self.rounded[row, -1]
            keep = np.flatnonzero(np.isfinite(raw) & ((rounded > last) | ((rounded == last) & (ids < self.names[row, -1]))))
            self.waiting.append((row[keep], rounded[keep], score[keep], ids[keep]))
            self.size += len(keep)
            if self.size > max(len(self.ids) * self.k, 1 << 18) or len(keep) > 16 * self.k * len(r):
                self.merge()

    def merge(self) -> None:
        import numpy as np

        if not self.size:
            self.waiting = []
            return
        row, rounded, score, ids = (np.concatenate(x) for x in zip(*self.waiting))
        self.waiting, self.size = [], 0
        mine = np.unique(row)
        held = self.rounded[mine] > -np.inf
        row = np.r_[row, np.broadcast_to(mine[:, None], held.shape)[held]]
        rounded, score, ids = np.r_[rounded, self.rounded[mine][held]], np.r_[score, self.scores[mine][held]], np.r_[ids, self.names[mine][held]]
        by = np.lexsort((ids, -rounded, row))
        row, rounded, score, ids = row[by], rounded[by], score[by], ids[by]
        start = np.r_[True, row[1:] != row[:-1]]
        place = np.arange(len(row)) - np.maximum.accumulate(np.where(start, np.arange(len(row)), 0))
        best = np.flatnonzero(place < self.k)
        row, place = row[best], place[best]
        self.rounded[row, place], self.scores[row, place], self.names[row, place] = rounded[best], score[best], ids[best]
        self.low[mine] = np.maximum(self.low[mine], self._bound(self.rounded[mine, -1]))

    def left(self) -> pa.RecordBatch:
        """(src, top, total, best) of every source, best as (minus the score at twelve digits, dst, score)."""
        import numpy as np

        self.merge()
        ok = self.rounded > -np.inf
        ends = pa.array(np.r_[0, np.cumsum(ok.sum(axis=1))], pa.int32())
        flat = pa.StructArray.from_arrays([pa.array(0.0 - self.rounded[ok]), pa.array(self.names[ok], pa.int64()), pa.array(self.scores[ok])], names=["o", "dst", "r"])
        return pa.RecordBatch.from_arrays([pa.array(self.ids, pa.int64()), pa.array(self.top), pa.array(self.total), pa.ListArray.from_arrays(ends, flat)], names=["src", "top", "total", "best"])


def strongest(first: DataFrame, second: DataFrame, k: int, softmax: bool = True, own: bool = True, curve: str = "relu", alpha: float = 3.0, block: int = 16384) -> DataFrame:
    """(src, dst, weight): each node's k strongest candidates among all of `second`; both are (node long, v array<double>) with vectors of one length.

    A score is the positive part of the product of first's and second's vectors, or with curve
    `tanh` of tanh(alpha * product). With softmax the weight is the score's exponential over
    the sum of those of all candidates, not only of the k. own: whether a node is a candidate
    of itself. Weights are not filtered; ties go to the smaller dst. Nodes are distinct; nulls take no part.
    """
    spark = first.sparkSession
    usable = lambda d: d.where("node IS NOT NULL AND v IS NOT NULL").select(F.col("node").cast("long").alias("node"), F.col("v").cast("array<double>").alias("v"))
    asks, cands = kept(usable(first)), usable(second)
    cands = dealt(cands, cands.count(), -(-asks.count() // block))
    parts = None
    for mine in blocks_of(asks, "node", block):
        sent = spark.sparkContext.broadcast((mine["node"].to_numpy(), matrix(mine["v"])))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            rows = RunningRows(*sent.value, k, own, curve, alpha, softmax)
            for b in batches:
                for at in range(0, b.num_rows, 1024):
                    part = b.slice(at, 1024)
                    rows.add(part.column(0).to_numpy(), matrix(part.column(1)))
            yield rows.left()

        left = cands.mapInArrow(run, "src long, top double, total double, best array<struct<o:double,dst:long,r:double>>")
        parts = left if parts is None else parts.unionByName(left)
    if parts is None:
        return asks.select(F.col("node").alias("src"), F.col("node").alias("dst"), F.lit(0.0).alias("weight"))
    parts = kept(parts.where(F.size("best") > 0))
    # The k best of all tasks' k best; the sum of exponentials is scaled to the common maximum.
    order = F.array_sort(F.flatten(F.collect_list("best")))
    top = parts.groupBy("src").agg(F.max("top").alias("all_top"))
    merged = parts.join(top, "src").groupBy("src").agg(F.first("all_top").alias("top"), F.sum(F.col("total") * F.exp(F.col("top") - F.col("all_top"))).alias("total"), F.slice(order, 1, k).alias("best"))
    weight: Column = F.exp(F.col("p.r") - F.col("top")) / F.col("total") if softmax else F.col("p.r")
    return merged.select("src", "top", "total", F.explode("best").alias("p")).select("src", F.col("p.dst").alias("dst"), weight.alias("weight"))


def adaptive_graph(first: DataFrame, second: DataFrame, k: int, **more) -> DataFrame:
    """Softmax weights of the k strongest neighbours, over all nodes, the node itself included."""
    return strongest(first, second, k, **more)


def directed_top_k(first: DataFrame, second: DataFrame, k: int, alpha: float = 3.0, **more) -> DataFrame:
    """(src, dst, weight) with weight > 0: the k largest of tanh(alpha (a_src . b_dst - b_src . a_dst)), a and b the two embeddings of a node; of two directions one at most is positive."""
    both = first.select("node", F.col("v").alias("a")).join(second.select("node", F.col("v").alias("b")), "node")
    asks = both.select("node", F.concat("a", F.transform("b", lambda x: -x)).alias("v"))
    cands = both.select("node", F.concat("b", "a").alias("v"))
    return strongest(asks, cands, k, softmax=False, curve="tanh", alpha=alpha, **more).where("weight > 0")
