"""SimHash near-duplicates with bit-sliced distance comparison.

Fingerprints that can be within the radius share enough of their bit blocks; they meet
under those blocks' bits and are then compared in vertical form: bit plane b of 64
fingerprints is one machine word, so one XOR gives 64 differing bits, and a carry-save
counter of a few words holds 64 distances at once. Blocks in which every distance is
beyond the radius are abandoned.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, fresh, join_by_key, map_binary, stored

BITS = 64


def majority(values):
    """The 64-bit number whose bits are those that over half of the values have."""
    import numpy as np

    count = np.zeros(BITS, dtype=np.int64)
    for k in range(0, len(values), 1 << 14):
        some = values[k : k + (1 << 14)].view(np.uint8).reshape(-1, 8)
        count += np.unpackbits(some, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(2 * count > len(values), bitorder="little").view(np.uint64)[0]


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, seed: int = 42) -> DataFrame:
    """(doc_id, fp long): bit is 1 where over half of the XXH64 values of the word shingles have it.

    Words are runs of anything but ASCII white space, A-Z lower-cased; a text of fewer
    words than a shingle is one shingle; one without words has fingerprint 0.
    """

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        import xxhash

        digest = xxhash.xxh64_intdigest
        for b in batches:
            fps = np.zeros(b.num_rows, dtype=np.uint64)
            for row, text in enumerate(b.column(1).to_pylist()):
                words = text.lower().split()
                if not words:
                    continue
                line = b" ".join(words)
                if len(words) <= shingle:
                    hashes = [digest(line, seed)]
                else:
                    # The start of every word, and for a shingle the end of its last word.
                    at = np.zeros(len(words) + 1, dtype=np.int64)
                    np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1, out=at[1:])
                    starts, ends = at[: len(words) - shingle + 1].tolist(), (at[shingle:] - 1).tolist()
                    hashes = [digest(line[s:e], seed) for s, e in zip(starts, ends)]
                fps[row] = majority(np.array(hashes, dtype="<u8"))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    return map_binary(docs, id_col, text_col, make, "doc_id long, fp long")


def bit_sliced_pairs(left, right, lists, words, radius: int):
    """Pairs (i, j) with distance(left[i], right[j]) <= radius, for the (i, word of 64 right rows) given.

    left, right: uint64 fingerprints, right padded to a multiple of 64; lists[n] and
    words[n] say that left[lists[n]] is to be compared with right[64 * words[n] : +64].
    """
    import numpy as np

    full = np.uint64(0xFFFFFFFFFFFFFFFF)
    one = np.uint64(1)
    blocks = right.reshape(-1, 64)
    bits = np.unpackbits(blocks.view(np.uint8).reshape(len(blocks), 64, 8), axis=2, bitorder="little")
    vertical = np.packbits(bits.transpose(2, 0, 1), axis=2, bitorder="little")
    planes = np.ascontiguousarray(vertical).view(np.uint64)[:, :, 0].copy()
    counters = radius.bit_length()
    # Counters start at a bias so that passing the radius carries out of the top one.
    bias = (1 << counters) - 1 - radius
    found_i, found_j = [], []
    for at in range(0, len(lists), 1 << 18):
        i, w = lists[at : at + (1 << 18)], words[at : at + (1 << 18)]
        c = [np.full(len(i), full if bias >> k & 1 else np.uint64(0)) for k in range(counters)]
        over = np.zeros(len(i), dtype=np.uint64)
        for b in range(BITS):
            carry = planes[b][w] ^ (np.uint64(0) - (left[i] >> np.uint64(b) & one))
            for k in range(counters):
                c[k], carry = c[k] ^ carry, c[k] & carry
            over |= carry
            if b % 8 == 7:
                live = over != full
                if not live.all():
                    i, w, over = i[live], w[live], over[live]
                    c = [x[live] for x in c]
                    if not len(i):
                        break
        if len(i):
            near = np.unpackbits((~over).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            n, lane = np.nonzero(near)
            found_i.append(i[n])
            found_j.append(w[n] * 64 + lane)
    none = np.zeros(0, dtype=np.int64)
    return (np.concatenate(found_i), np.concatenate(found_j)) if found_i else (none, none)


def forest(a, b):
    """Few edges that connect what the edges (a, b) connect: every value to the smallest reachable."""
    import numpy as np

    names, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = flat[: len(a)], flat[len(a) :]
    root = np.arange(len(names))
    while True:
        low = np.minimum(root[x], root[y])
        nxt = root.copy()
        np.minimum.at(nxt, root[x], low)
        np.minimum.at(nxt, root[y], low)
        nxt = nxt[nxt]
        if (nxt == root).all():
            break
        root = nxt
    keep = root != np.arange(len(names))
    return names[keep], names[root[keep]]


def blocks_for(count: int, radius: int, chunk: int) -> int:
    """Bit blocks so many that evenly spread fingerprints leave at most a quarter of a chunk under a key.

    More blocks make keys of more bits, and more keys for each fingerprint: 15 of 20 to 22
    bits for radius 4 up to 268 million fingerprints, then 35 of 27 bits, then 70 of 32.
    """
    blocks = radius + 2
    while blocks < BITS and count >> (BITS * (blocks - radius) // blocks) > chunk // 4:
        blocks += 1
    return blocks


def links(fps: DataFrame, radius: int = 4, blocks: int | None = None, chunk: int = 512) -> DataFrame:
    """Edges (src, dst) of distinct fingerprints that connect all pairs within radius bits.

    With `blocks` bit blocks (as many as the number of fingerprints needs, if not given),
    two fingerprints within the radius agree on at least
    blocks - radius of them; each fingerprint goes under every such combination of its
    blocks. A key with more than `chunk` fingerprints is dealt into chunks, and every
    pair of its chunks is a group of its own, so that no task holds an unbounded group.
    Each group gives a spanning forest of its links, not all of them.
    """
    blocks = blocks or blocks_for(fps.count(), radius, chunk)
    sizes = [BITS // blocks + (k < BITS % blocks) for k in range(blocks)]
    masks, at = [], 0
    for s in sizes:
        masks.append(((1 << s) - 1) << at)
        at += s
    signed = lambda m: m - (1 << 64) if m >= 1 << 63 else m
    keys = [signed(sum(c)) for c in combinations(masks, blocks - radius)]
    keyed = fps.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in keys])).alias("which", "part")).select(
        "fp", F.xxhash64("which", "part").alias("key")
    )
    large = keyed.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > chunk).select("key", F.ceil(F.col("n") / chunk).cast("int").alias("chunks"))
    dealt = keyed.join(large, "key", "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
    mine = F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int")
    # A fingerprint of chunk m takes part in the group of every pair {m, other}.
    spread = dealt.withColumn("mine", mine).select("fp", "key", "mine", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("other")).select(
        "fp", F.xxhash64("key", F.least("mine", "other"), F.greatest("mine", "other")).alias("grp")
    )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        def edges_of(grp, fp):
            """Groups are runs of equal grp; compares all within each."""
            start = np.flatnonzero(np.r_[True, grp[1:] != grp[:-1]])
            size = np.diff(np.r_[start, len(grp)])
            keep = size > 1
            start, size = start[keep], size[keep]
            if not len(start):
                return None
            lanes = -(-size // 64)
            first = np.cumsum(lanes) - lanes
            # Padding repeats the group's first fingerprint, which gives no other pairs than it has.
            base = np.repeat(start, lanes * 64)
            local = np.arange(len(base)) - np.repeat(first * 64, lanes * 64)
            source = base + np.where(local < np.repeat(size, lanes * 64), local, 0)
            right = fp[source]
            member = np.repeat(np.arange(len(start)), size)
            left_at = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size) + np.repeat(start, size)
            reps = lanes[member]
            lists = np.repeat(left_at, reps)
            words = np.arange(int(reps.sum())) - np.repeat(np.cumsum(reps) - reps, reps) + np.repeat(first[member], reps)
            i, j = bit_sliced_pairs(fp, right, lists, words, radius)
            a, b = fp[i].view(np.int64), right[j].view(np.int64)
            proper = a < b
            if not proper.any():
                return None
            return forest(a[proper], b[proper])

        held_g, held_f = np.zeros(0, np.int64), np.zeros(0, np.uint64)
        for batch in batches:
            g = np.r_[held_g, batch.column(0).to_numpy()]
            f = np.r_[held_f, batch.column(1).to_numpy().view(np.uint64)]
            last = int(np.searchsorted(g, g[-1])) if len(g) else 0
            done = edges_of(g[:last], f[:last])
            held_g, held_f = g[last:], f[last:]
            if done is not None:
                yield pa.RecordBatch.from_arrays([pa.array(done[0]), pa.array(done[1])], names=["src", "dst"])
        done = edges_of(held_g, held_f)
        if done is not None:
            yield pa.RecordBatch.from_arrays([pa.array(done[0]), pa.array(done[1])], names=["src", "dst"])

    ordered = spread.select("grp", "fp").repartition("grp").sortWithinPartitions("grp")
    return ordered.mapInArrow(compare, "src long, dst long").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 4, shingle: int = 4, seed: int = 42) -> DataFrame:
    """One row per document: fingerprint (16 hex digits) and component_id.

    Fingerprints at most `radius` bits apart are linked; component_id is the smallest
    doc_id reachable over links, the document itself included. Equal fingerprints are one
    node of the comparison, so copies cost one aggregation, however many they are.

    Null, empty and wordless texts share fingerprint zero and are linked like others.
    Repeated rows give repeated results; a null doc_id keeps its row and is never the
    smallest. An empty table gives no rows. Other columns are not read.
    """
    fps = stored(fingerprints(docs, id_col, text_col, shingle, seed))
    named = stored(_rooted(fps, radius))
    lowest = named.groupBy("root").agg(F.min("low").alias("component_id"))
    by_fp = named.join(lowest, "root").select("fp", "component_id", "times")
    return join_by_key(fps, by_fp, "fp", fps.count()).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def _rooted(fps: DataFrame, radius: int) -> DataFrame:
    """(fp, low, times, root): every distinct fingerprint, the smallest doc_id with it, its rows, and its component's fingerprint."""
    nodes = stored(fps.groupBy("fp").agg(F.min("doc_id").alias("low"), F.count("*").alias("times")))
    roots = components(links(nodes.select("fp"), radius))
    return nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "low", "times", F.coalesce("root", "fp").alias("root"))


def keep_representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 4, shingle: int = 4, seed: int = 42) -> DataFrame:
    """docs, all columns, whatever their names, with one row of each group of near duplicates: that of the smallest id.

    Null ids come last; a repeated row is kept once. Null, empty and wordless texts are one
    group. An empty table stays empty. Rows are told apart by id and a hash of the text, so no
    numbering of the input is relied upon.
    """
    order, body = F.coalesce(F.col(id_col).cast("long"), F.lit((1 << 63) - 1)), F.xxhash64(F.col(text_col))
    keyed = docs.select(order.alias("k"), body.alias("h"), F.col(text_col).alias("t"))
    # The fingerprints' own id is the text's hash: equal texts have equal fingerprints.
    fps = stored(fingerprints(keyed.select("h", "t"), "h", "t", shingle, seed).withColumnRenamed("doc_id", "h").distinct())
    root = _rooted(fps.select("fp", F.col("h").alias("doc_id")), radius).select("fp", "root")
    lowest = keyed.groupBy("h").agg(F.min("k").alias("k"))
    return keep_lowest(docs, order, body, lowest.join(fps, "h").join(root, "fp"))


def keep_lowest(docs: DataFrame, order, body, named: DataFrame) -> DataFrame:
    """The rows of docs, once each, that are the smallest (order, body) of their root in named(k, h, root)."""
    k, h = fresh(docs, "k", "h")
    chosen = named.groupBy("root").agg(F.min(F.struct("k", "h")).alias("c")).select(F.col("c.k").alias(k), F.col("c.h").alias(h))
    marked = docs.withColumns({k: order, h: body})
    return marked.join(chosen, [k, h], "left_semi").dropDuplicates([k, h]).drop(k, h)
