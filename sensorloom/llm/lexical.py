"""Ranked lexical search of many items at once, by sort-based accumulation.

Each task reads its documents, and each matched term gives an array of (item, document,
impact) triples. The arrays of a block of documents are concatenated, packed into one key
(item, document), radix sorted, and summed where the key stays the same; the best documents
of each item are then selected by heap. Documents are the ranges over which the work is
split, so a document's impacts meet in the task that reads it and none is shuffled; what
tasks leave, k documents an item at most, is dealt by range of items and selected again.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_binary, stored

#: A-Z to a-z; what is neither a digit, a letter nor part of a non-ASCII character becomes a space.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(FOLD).split()


def radix_order(keys):
    """Places that sort non-negative int64 keys, by stable passes over 16-bit digits from the least significant."""
    import numpy as np

    order = np.arange(len(keys))
    for shift in range(0, int(keys.max(initial=0)).bit_length(), 16):
        digit = (keys[order] >> shift & 0xFFFF).astype(np.uint16)
        order = order[np.argsort(digit, kind="stable")]
    return order


def sums_by_key(keys, values):
    """(distinct keys in order, sums of their values)."""
    import numpy as np

    order = radix_order(keys)
    keys, values = keys[order], values[order]
    at = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    return keys[at], np.add.reduceat(values, at) if len(at) else values


def weight(documents: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))


def length_share(n, documents: int, total: int, b: int):
    """100 - b + ((b * n * documents) div total), beyond 64 bits where it must be."""
    import numpy as np

    if int(n.max(initial=0)) * documents * b < 1 << 63:
        return 100 - b + (b * n * documents) // max(total, 1)
    return np.array([100 - b + (b * int(x) * documents) // max(total, 1) for x in n], dtype=np.int64)


class BestOfItems:
    """Each item's k best (score, document) so far, as heaps whose first is the worst kept."""

    def __init__(self, k: int):
        self.k, self.heaps = k, {}

    def add(self, items, scores, docs) -> None:
        """Arrays sorted by item; scores above 0 only are kept. Equal scores go to the smaller id, null ids come last."""
        import numpy as np

        at = np.flatnonzero(np.r_[True, items[1:] != items[:-1]]) if len(items) else np.zeros(0, np.int64)
        for lo, hi in zip(at, np.r_[at[1:], len(items)]):
            heap = self.heaps.setdefault(int(items[lo]), [])
            s = scores[lo:hi]
            floor = heap[0][0] if len(heap) == self.k else 1
            if hi - lo > self.k:
                floor = max(floor, int(np.partition(s, hi - lo - self.k)[hi - lo - self.k]))
            for j in np.flatnonzero(s >= floor):
                d = docs[lo + j]
                entry = (int(s[j]), d is not None, -d if d is not None else 0)
                if len(heap) < self.k:
                    heapq.heappush(heap, entry)
                else:
                    heapq.heappushpop(heap, entry)

    def rows(self) -> Iterator[tuple]:
        for item, heap in self.heaps.items():
            for s, known, d in sorted(heap, reverse=True):
                yield item, -d if known else None, s


def item_terms(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(item_id, term) once each; rows of one id are one item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [(i, t) for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for t in set(terms_of(text))]
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in found], pa.int64()), pa.array([t for _, t in found], pa.binary())], names=["item_id", "term"])

    return map_binary(items, id_col, text_col, run, "item_id long, term binary").distinct()


def term_statistics(docs: DataFrame, known, id_col: str, text_col: str) -> DataFrame:
    """(term, n): of each known term (a broadcast of term -> number) the documents that hold it; -1 the documents with a term, -2 their terms with repeats."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        number = known.value
        df = np.zeros(len(number) + 2, dtype=np.int64)
        for b in batches:
            for text in b.column(1).to_pylist():
                words = terms_of(text)
                if words:
                    df[-1] += 1
                    df[-2] += len(words)
                    df[[number[w] for w in set(words) if w in number]] += 1
        held = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.where(held >= len(number), held - len(number) - 2, held)), pa.array(df[held])], names=["term", "n"])

    return map_binary(docs, id_col, text_col, run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))


def select_best(found: DataFrame, k: int) -> DataFrame:
    """(item, doc_id, score, rank) of the k best of each item among (item, doc_id, score).

    Tasks that read one item's lists are as many as it has `part`s; each leaves k, and these
    meet in one task an item.
    """

    def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by item and part, so one item's heap is held at a time."""
        import numpy as np

        best, now = BestOfItems(k), None

        def leave():
            rows = list(best.rows())
            ranks = range(1, len(rows) + 1)
            best.heaps.clear()
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64()), pa.array(ranks, pa.int32())], names=["item", "doc_id", "score", "rank"])

        for b in batches:
            items, parts, docs, scores = b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(2).to_pylist(), b.column(3).to_numpy()
            at = np.flatnonzero(np.r_[True, (items[1:] != items[:-1]) | (parts[1:] != parts[:-1])]) if len(items) else []
            for lo, hi in zip(at, [*at[1:], len(items)]):
                key = (int(items[lo]), int(parts[lo]))
                if key != now and now is not None:
                    yield leave()
                now = key
                best.add(items[lo:hi], scores[lo:hi], docs[lo:hi])
        if now is not None:
            yield leave()

    schema = "item long, doc_id long, score long, rank int"
    first = found.repartitionByRange("item", "part").sortWithinPartitions("item", "part").select("item", "part", "doc_id", "score").mapInArrow(heads, schema)
    last = first.select("item", F.lit(0).cast("long").alias("part"), "doc_id", "score").repartition("item").sortWithinPartitions("item")
    return last.select("item", "part", "doc_id", "score").mapInArrow(heads, schema)


def search_documents(
    docs: DataFrame, items: DataFrame, k: int = 50, b: int = 50, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
    item_text: str = "text", block_triples: int = 1 << 21, block_terms: int = 1 << 20,
) -> DataFrame:
    """Each item's k highest-scoring documents with a score above 0: item_id, rank (from 1), doc_id, score.

    Terms are runs of digits, letters (A-Z lower-cased) and non-ASCII characters. A term's
    impact on a document grows with its rarity and its occurrences and falls with the
    document's length (b percent of it counted), all in whole numbers. Equal scores are
    ranked by ascending doc_id, null ids last. Null and empty texts have no term: such
    documents do not count and such items have no rows. Rows of one item_id are one item;
    repeated documents are ranked each. An empty table gives no rows. Other columns are not read.

    Items are dealt into blocks of about block_terms (item, term) pairs, each broadcast, so
    what is broadcast has a bound however many items there are; documents are read twice for
    each block, once for the statistics. A task holds about block_triples triples and k documents an item.
    """
    import numpy as np

    spark = docs.sparkSession
    pairs = stored(item_terms(items, item_col, item_text))
    blocks = max(1, -(-pairs.count() // block_terms))
    dealt = pairs.withColumn("blk", F.pmod(F.xxhash64("item_id"), F.lit(blocks)).cast("int"))
    parts = None
    for n in range(blocks):
        mine = sorted(((r["item_id"], bytes(r["term"])) for r in dealt.where(F.col("blk") == n).toLocalIterator()), key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        if not mine:
            continue
        names = sorted({i for i, _ in mine}, key=lambda i: (i is not None, i or 0))
        place = {i: j for j, i in enumerate(names)}
        number: dict[bytes, int] = {}
        holders: list[list[int]] = []
        for i, t in mine:
            if t not in number:
                number[t] = len(holders)
                holders.append([])
            holders[number[t]].append(place[i])
        known = spark.sparkContext.broadcast(number)
        stats = {r["term"]: r["n"] for r in term_statistics(docs, known, id_col, text_col).toLocalIterator()}
        documents, total = stats.get(-1, 0), stats.get(-2, 0)
        weights = np.array([weight(documents, stats.get(t, 0)) for t in range(len(holders))], dtype=np.int64)
        lists = spark.sparkContext.broadcast((weights, np.cumsum([0, *map(len, holders)]), np.concatenate([np.array(h, dtype=np.int64) for h in holders]), documents, total))
        named = spark.createDataFrame([(j, i) for j, i in enumerate(names)], "item long, item_id long")
        found = map_binary(docs, id_col, text_col, _scorer(known, lists, k, b, block_triples), "item long, doc_id long, score long").withColumn("part", F.spark_partition_id().cast("long") % 256)
        found = stored(found)  # or the sampling of ranges would read the documents once more
        part = select_best(found, k).join(F.broadcast(named), "item").select("item_id", "rank", "doc_id", "score")
        parts = part if parts is None else parts.unionByName(part)
    return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long") if parts is None else parts


def _scorer(known, lists, k: int, b: int, block_triples: int):
    """The scan that gives a task's k best documents of each item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        number, (weights, ends, holders, documents, total) = known.value, lists.value
        sizes = np.diff(ends)
        best = BestOfItems(k)
        ids: list = []
        matched: list[tuple] = []
        waiting = 0

        def accumulate() -> None:
            """Concatenates the block's (item, document, impact) arrays, sorts packed keys and adds up."""
            nonlocal ids, matched, waiting
            row, term, tf, n = (np.array(c, dtype=np.int64) for c in zip(*matched))
            m = length_share(n, documents, total, b)
            impact = weights[term] * ((1000000000 * tf) // (1000 * tf + 20 * m))
            times = sizes[term]
            at = np.repeat(ends[term] - np.cumsum(times) + times, times) + np.arange(times.sum())
            keys, scores = sums_by_key((holders[at] << 32) | np.repeat(row, times), np.repeat(impact, times))
            good = scores > 0
            docs = np.array(ids, dtype=object)[keys[good] & 0xFFFFFFFF]
            best.add(keys[good] >> 32, scores[good], docs)
            ids, matched, waiting = [], [], 0

        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = terms_of(text)
                times: dict[int, int] = {}
                for w in words:
                    t = number.get(w)
                    if t is not None:
                        times[t] = times.get(t, 0) + 1
                if times:
                    matched.extend((len(ids), t, f, len(words)) for t, f in times.items())
                    waiting += int(sizes[list(times)].sum())
                    ids.append(i)
                    if waiting >= block_triples:
                        accumulate()
        if matched:
            accumulate()
        rows = list(best.rows())
        for at in range(0, len(rows), 8192):
            some = rows[at : at + 8192]
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in some], pa.int64()) for c in range(3)], names=["item", "doc_id", "score"])

    return run


LEXICAL_SQL = """
WITH t AS (SELECT row_number() OVER () AS rid, doc_id,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS w FROM documents),
d AS (SELECT rid, doc_id, w, CAST(len(w) AS HUGEINT) AS n FROM t WHERE len(w) > 0),
s AS (SELECT count(*) AS docs, sum(n) AS total FROM d),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM benchmark),
p AS (SELECT rid, term, count(*) AS tf FROM (SELECT rid, unnest(w) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY rid, term),
f AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE)) AS BIGINT) AS weight FROM (SELECT term, count(*) AS df FROM p GROUP BY term), s),
i AS (SELECT p.rid, d.doc_id, term, weight * ((1000000000 * tf) // (1000 * tf + 20 * CAST(50 + (50 * n * docs) // total AS BIGINT))) AS impact FROM p JOIN f USING (term) JOIN d USING (rid), s),
r AS (SELECT item_id, rid, doc_id, CAST(sum(impact) AS BIGINT) AS score FROM q JOIN i USING (term) GROUP BY item_id, rid, doc_id HAVING sum(impact) > 0)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM r QUALIFY rank <= 50"""
