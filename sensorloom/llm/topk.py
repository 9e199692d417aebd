"""Exact top-k inner products by no-random-access aggregation over sorted lists.

Every component of the vectors is a list sorted by value; for a query the list is read
from the end that its own component makes largest. After reading a depth of every list, a
candidate's score lies between a lower bound (what was read of it, and the last value of
each list where it was not met) and an upper bound (what was read, and the value the list
has come to). A query stops when no candidate outside those that can still reach its k-th
lower bound remains, and the final scores of these are then resolved. Bounds of many
queries at one depth are two matrix products.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

#: Depths (shares of the lists) at which bounds are looked at.
DEPTHS = (0.125, 0.25, 0.5, 0.75, 0.875, 0.9375)


def nra_block(queries, query_ids, vectors, vector_ids, k: int, resolve: int, floor=None, first: int = 0, settled_at=None):
    """(query position, vector position, score) of each query's k best in one block, ties to smaller ids.

    floor: for each query a score that its k-th best is known to reach; what lies below it may be
    left out. first: the depth to start at. settled_at: counts of queries settled by depth, the last
    for those whose lists were read to the end, are added to it.
    """
    import numpy as np

    n, dims = vectors.shape
    reach = float(np.abs(queries).max(initial=0)) * float(np.abs(vectors).max(initial=0)) * max(dims, 1)
    own = query_ids[:, None] == vector_ids[None, :]
    out_q, out_v = [], []
    floor = np.full(len(queries), -np.inf) if floor is None else floor
    settled_at = np.zeros(len(DEPTHS) + 1, dtype=np.int64) if settled_at is None else settled_at
    if reach >= 2**53:  # exact beyond what doubles hold: whole numbers of any length
        q, v = np.nonzero(~own)
        a, b = queries.astype(object), vectors.astype(object)
        low, high = -(1 << 63), (1 << 63) - 1
        score = np.array([min(max(int((a[x] * b[y]).sum()), low), high) for x, y in zip(q, v)], dtype=np.int64)
    else:
        kind = np.float32 if reach < 2**24 else np.float64
        qs, vs = queries.astype(kind), vectors.astype(kind)
        order = np.argsort(vs, axis=0, kind="stable")
        rank = np.empty_like(order)
        np.put_along_axis(rank, order, np.arange(n)[:, None], 0)
        rising = np.take_along_axis(vs, order, 0)
        signed = np.concatenate([np.maximum(qs, 0), np.minimum(qs, 0)], axis=1)
        active = np.arange(len(qs))
        for which, depth in list(enumerate(DEPTHS))[first:]:
            d = int(n * depth)
            if n <= resolve or not len(active):
                break
            # The last d places of a rising list are read for a positive component, the first d for a negative one.
            met = np.concatenate([rank >= n - d, rank < d], axis=1)
            both = np.concatenate([vs, vs], axis=1)
            lower = signed[active] @ np.where(met, both, np.concatenate([rising[0], rising[-1]])).T
            lower[own[active]] = -np.inf
            kth = np.maximum(np.partition(lower, n - k, axis=1)[:, n - k] if k <= n else np.full(len(active), -np.inf), floor[active])
            upper = signed[active] @ np.where(met, both, np.concatenate([rising[n - d - 1], rising[d]])).T
            upper[own[active]] = -np.inf
            can = upper >= kth[:, None]
            can &= ~own[active]
            settled = can.sum(axis=1) <= resolve
            settled_at[which] += settled.sum()
            q, v = np.nonzero(can[settled])
            out_q.append(active[settled][q])
            out_v.append(v)
            active = active[~settled]
        if len(active):  # every list is read to its end: lower and upper bounds meet
            exact = qs[active] @ vs.T
            exact[own[active]] = -np.inf
            settled_at[-1] += len(active)
            kth = np.maximum(np.partition(exact, n - k, axis=1)[:, n - k] if k <= n else np.full(len(active), -np.inf), floor[active])
            q, v = np.nonzero((exact >= kth[:, None]) & ~own[active])
            out_q.append(active[q])
            out_v.append(v)
        q, v = np.concatenate(out_q or [np.zeros(0, int)]), np.concatenate(out_v or [np.zeros(0, int)])
        score = np.concatenate([(queries[q[i : i + 65536]] * vectors[v[i : i + 65536]]).sum(axis=1) for i in range(0, len(q), 65536)] or [np.zeros(0, np.int64)])
    at = np.lexsort((vector_ids[v], -score.astype(np.float64) if reach < 2**53 else np.array([-int(s) for s in score], dtype=object), q))
    q, v, score = q[at], v[at], score[at]
    first = np.r_[True, q[1:] != q[:-1]] if len(q) else np.zeros(0, bool)
    place = np.arange(len(q)) - np.maximum.accumulate(np.where(first, np.arange(len(q)), 0)) if len(q) else np.zeros(0, int)
    keep = place < k
    return q[keep], v[keep], score[keep]


def _best(k: int, q, ids, score):
    """Positions of the k best of each query (highest score, then smallest id), by query."""
    import numpy as np

    at = np.lexsort((ids, np.invert(score), q))  # ~score rises as score falls, at the ends of the range too
    q = q[at]
    first = np.r_[True, q[1:] != q[:-1]] if len(q) else np.zeros(0, bool)
    place = np.arange(len(q)) - np.maximum.accumulate(np.where(first, np.arange(len(q)), 0))
    return at[place < k]


class RunningBest:
    """The k best of every query so far, over blocks of candidates that come one after the other."""

    def __init__(self, query_ids, queries, k: int, resolve: int):
        import numpy as np

        self.query_ids, self.queries, self.k, self.resolve = query_ids, queries, k, resolve
        self.q, self.ids, self.score = (np.zeros(0, np.int64) for _ in range(3))
        self.start = 0

    def add(self, vector_ids, vectors):
        """A block of candidates: bounds start from what is already found, at the depth that last began to settle queries."""
        import numpy as np

        have = np.bincount(self.q, minlength=len(self.queries))
        floor = np.full(len(self.queries), -np.inf)
        lowest = np.full(len(self.queries), np.iinfo(np.int64).max)
        np.minimum.at(lowest, self.q, self.score)
        # A little below, so that the rounding of large scores to doubles loses no tie.
        full = have >= self.k
        floor[full] = lowest[full] - 1.0
        settled = np.zeros(len(DEPTHS) + 1, dtype=np.int64)
        q, ids, score = [self.q], [self.ids], [self.score]
        for at in range(0, len(self.queries), 1024):
            part = slice(at, at + 1024)
            a, b, x = nra_block(self.queries[part], self.query_ids[part], vectors, vector_ids, self.k, self.resolve, floor[part], self.start, settled)
            q.append(at + a)
            ids.append(vector_ids[b])
            score.append(x)
        q, ids, score = np.concatenate(q), np.concatenate(ids), np.concatenate(score)
        keep = _best(self.k, q, ids, score)
        self.q, self.ids, self.score = q[keep], ids[keep], score[keep]
        if settled.any():
            self.start = max(0, min(int(np.flatnonzero(settled)[0]), len(DEPTHS)) - 1)
        return settled


def top_k(
    vectors: DataFrame, k: int = 20, every: int = 20, scale: float = 64.0, id_col: str = "vec_id", vector_col: str = "embedding",
    block: int = 1024, query_block: int = 8192, resolve: int = 160,
) -> DataFrame:
    """Each query's k highest integer inner products: query_id, rank (from 1), vec_id, score.

    Components become floor(scale * x). Queries are the rows whose id is divisible by
    `every`; candidates are all rows but those with the query's own id. Ties go to the
    smaller id; a repeated row counts as often as it stands. Vectors that are null or hold
    null or non-finite components take no part, nor do rows without an id; shorter vectors
    are filled with zeros. Scores beyond a long are clipped to its range. An empty table
    gives no rows. Other columns are not read.

    Queries are dealt by a hash into blocks of about `query_block`, each broadcast (its size is
    bounded by that number and the dimensions). Candidates are read where they lie, once for
    each block of queries, and are not shuffled: a task reads them as a stream of blocks of
    about `block` rows and carries each query's k best from one to the next as a lower bound,
    so memory does not grow with the table, and k rows a query and task are left to rank.
    """
    usable = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("v")).where(
        F.col("vec_id").isNotNull() & F.col("v").isNotNull()
        & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    )
    whole = usable.select("vec_id", F.transform("v", lambda x: F.floor(x.cast("double") * scale)).alias("v"))
    asks = stored(whole.where(F.col("vec_id") % every == 0).withColumn("h", F.xxhash64("vec_id", "v")))
    counts = whole.agg(F.max(F.size("v")).alias("dims")).first()
    query_parts, dims = max(1, -(-asks.count() // query_block)), max(counts["dims"] or 1, 1)

    def matrix(lists):
        import numpy as np

        flat, ends = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
        size = np.diff(ends)
        m = np.zeros((len(size), dims), dtype=np.int64)
        row = np.repeat(np.arange(len(size)), size)
        m[row, np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)] = flat[ends[0] : ends[-1]]
        return m

    def search(asked):
        """The scan that leaves each query's k best of a task's candidates."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            import numpy as np

            best, ids, rows, held = RunningBest(*asked.value, k, resolve), [], [], 0
            for b in batches:
                ids.append(b.column(0).to_numpy())
                rows.append(matrix(b.column(1)))
                held += b.num_rows
                if held >= block:
                    ids, rows = [np.concatenate(ids)], [np.concatenate(rows)]
                    upto = held // block * block
                    for at in range(0, upto, block):
                        best.add(ids[0][at : at + block], rows[0][at : at + block])
                    ids, rows, held = [ids[0][upto:]], [rows[0][upto:]], held - upto
            if held:
                best.add(np.concatenate(ids), np.concatenate(rows))
            if len(best.q):
                yield pa.RecordBatch.from_arrays([pa.array(best.query_ids[best.q]), pa.array(best.ids), pa.array(best.score)], names=["query_id", "vec_id", "score"])

        return run

    import numpy as np

    found = None
    for n in range(query_parts):
        mine = sorted((r["vec_id"], r["v"]) for r in asks.where(F.pmod("h", F.lit(query_parts)) == n).select("vec_id", "v").toLocalIterator())
        if not mine:
            continue
        m = np.zeros((len(mine), dims), dtype=np.int64)
        for at, (_, v) in enumerate(mine):
            m[at, : len(v)] = v
        asked = vectors.sparkSession.sparkContext.broadcast((np.array([i for i, _ in mine], dtype=np.int64), m))
        part = stored(whole.mapInArrow(search(asked), "query_id long, vec_id long, score long"))
        asked.destroy()  # its rows are stored
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = vectors.sparkSession.createDataFrame([], "query_id long, vec_id long, score long")
    ranked = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
