"""Packing token pieces into fixed windows by Karmarkar-Karp multiway differencing.

Every text is tokenised once, in the task that reads it, and cut there: full windows
leave as they are, and only what remains of a document (less than a window) has to be
combined. It is cut into grains, so that windows can come out near-equal; grains are dealt
into groups of bounded size, and each group is divided by differencing.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_binary, stored

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def differencing(sizes: list[int], k: int) -> list[list[int]]:
    """Indices of sizes in k parts of near-equal sum, by Karmarkar-Karp multiway differencing.

    A partial partition is its non-zero parts, largest first, and its imbalance is the
    largest part less the smallest. The two partial partitions of largest imbalance are
    merged, the largest part of one with the smallest of the other, until one is left.
    """
    heap = [(-s, n, [(s, (n,))]) for n, s in enumerate(sizes) if s]
    zero = [n for n, s in enumerate(sizes) if not s]
    heapq.heapify(heap)
    mark = len(sizes)
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[2], heapq.heappop(heap)[2]
        overlap = len(a) + len(b) - k
        if overlap <= 0:
            merged = a + b
        else:
            # The last parts of a are its smallest; they take the largest of b turned round, so that opposite imbalances meet.
            keep, tail = a[: len(a) - overlap], a[len(a) - overlap :]
            joined = [(x + y, (m, n)) for (x, m), (y, n) in zip(tail, reversed(b[len(b) - overlap :]))]
            merged = keep + joined + b[: len(b) - overlap]
        merged.sort(key=lambda p: -p[0])
        low = merged[-1][0] if len(merged) == k else 0
        mark += 1
        heapq.heappush(heap, (-(merged[0][0] - low), mark, merged))

    def flat(tree: tuple) -> list[int]:
        out, todo = [], [tree]
        while todo:
            x = todo.pop()
            if isinstance(x, tuple):
                todo.extend(x)
            else:
                out.append(x)
        return out

    parts = [sorted(flat(tree)) for _, tree in heap[0][2]] if heap else []
    parts += [[] for _ in range(k - len(parts))]
    parts[-1] = parts[-1] + zero
    return parts


def windows_of(sizes: list[int], capacity: int) -> list[list[int]]:
    """Near-equal windows of at most capacity: one more window while one is over."""
    k = max(1, -(-sum(sizes) // capacity))
    while True:
        parts = differencing(sizes, k)
        if all(sum(sizes[n] for n in p) <= capacity for p in parts):
            return [p for p in parts if p]
        k += 1


def tokenize_and_cut(docs: DataFrame, capacity: int, end_id: int, grain: int, tokenizer: str | None = None, ranks: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of every document: full windows, then a remainder in grains, each with the CRC of its ids.

    Ids are those of the `tokenizers` file. Its merges are run by tiktoken on the same
    vocabulary, which gives the same ids several times faster; a text that holds the string of
    one of the file's added tokens goes through `tokenizers` itself.
    """

    def cut_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import base64
        import json
        import zlib

        import numpy as np
        import public_tokenizers
        import tiktoken

        with open(ranks or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
            merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        fast = tiktoken.Encoding("pieces", pat_str=public_tokenizers.PATTERN, mergeable_ranks=merges, special_tokens={})
        named = tokenizer or public_tokenizers.path("byte_bpe_50k.json")
        with open(named, encoding="utf-8") as f:
            added = [t["content"].encode() for t in json.load(f).get("added_tokens", ())]
        exact = None
        for b in batches:
            out: list[list] = [[] for _ in range(5)]
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if any(t in text for t in added):
                    if exact is None:
                        from tokenizers import Tokenizer

                        exact = Tokenizer.from_file(named)
                    ids = exact.encode(text.decode(), add_special_tokens=False).ids
                else:
                    ids = fast.encode_ordinary(text.decode())
                ids.append(end_id)
                raw = np.array(ids, dtype="<u4")
                whole = len(ids) // capacity * capacity
                for start in [*range(0, whole, capacity), *range(whole, len(ids), grain)]:
                    piece = raw[start : start + (capacity if start < whole else grain)]
                    for o, x in zip(out, (doc_id, start, len(piece), zlib.crc32(piece), len(ids))):
                        o.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(o, pa.int64()) for o in out], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return map_binary(docs, id_col, text_col, cut_texts, PIECES)


def pack(docs: DataFrame, capacity: int = 2048, end_id: int = 1, grain: int = 256, group_pieces: int = 1024, tokenizer: str | None = None, ranks: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece with its place: sequence_id and offset (there, gapless from 0).

    A document's ids, with end_id, lie in exactly one piece each. Pieces of a full window
    are sequences of their own. Grains of the remainders are dealt by a hash of their place in the
    stored table into groups of about group_pieces rows, whatever their document, and
    each group is packed by differencing; the number of windows is the least that could
    hold the group, and rises while a window would overflow. A sequence_id is the smallest
    piece number in it, so ids are unique without any global numbering pass.

    A null or empty text has only the end id. Repeated rows are packed once each. An empty
    table gives no rows. Other columns are not read. Only piece rows (five numbers) are
    shuffled, never texts or ids; a group is bounded by group_pieces on average, however
    many rows share an id or a source. The stored table makes the numbering stable when an
    executor is lost.
    """
    pieces = stored(tokenize_and_cut(docs, capacity, end_id, grain, tokenizer, ranks, id_col, text_col).withColumn("piece", F.monotonically_increasing_id()))
    full = pieces.where(F.col("length") == capacity).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", F.col("piece").alias("sequence_id"), F.lit(0).cast("long").alias("offset")
    )
    rest = pieces.where(F.col("length") < capacity)
    groups = max(1, -(-rest.count() // group_pieces))

    def divide(pdf):
        import pandas as pd

        pdf = pdf.sort_values("piece").reset_index(drop=True)
        sizes = pdf["length"].tolist()
        number = pdf["piece"].tolist()
        seq, off = [0] * len(sizes), [0] * len(sizes)
        for part in windows_of(sizes, capacity):
            at = 0
            for n in part:
                seq[n], off[n] = number[part[0]], at
                at += sizes[n]
        return pd.DataFrame({c: pdf[c] for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")} | {"sequence_id": seq, "offset": off})

    packed = rest.withColumn("grp", F.pmod(F.xxhash64("piece"), F.lit(groups))).groupBy("grp").applyInPandas(divide, PIECES + ", sequence_id long, offset long")
    return full.unionByName(packed)
