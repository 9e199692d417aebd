"""Near copies by SimHash and by the exact Jaccard similarity of word shingles.

A SimHash of 64 bits cannot reach every pair of a similarity of 0.8: such a pair differs in
about ten bits, where chance pairs are not far off. So fingerprints within a small radius are
linked first, compared in bit-sliced blocks; among what they leave apart, pairs are found exactly.

Prefix filtering: with all shingles in one order, two sets of similarity t share a shingle
among the first n - ceil(t n) + 1 of each. Rare shingles come first, so few sets meet. Pairs
that meet are first bounded by parity sketches (the Hamming distance of two sketches never
exceeds the size of the sets' symmetric difference) and then compared shingle by shingle,
so that exactly the pairs of at least the wanted similarity are linked.

Pairs are looked at inside tasks, between chunks of a shingle's holders, and are never rows:
a task gives edges that connect what its sketches let through. What they connect is a family,
in which every two texts of different components are compared, and again only edges that
connect the similar ones are rows. So rows grow with the texts, not with the pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bitmap, bitmap_hits, compare_pairs, components, cut, discard, inside, map_binary, shuffles_dropped, smaller, stored, stored_at
from .simhash import forest, keep_lowest, links, majority

SKETCH = 10  # a parity sketch has 2**SKETCH bits at least, and two or more for every shingle of its set


def shingle_hashes(text: bytes, shingle: int, seed: int):
    """XXH64 values (uint64) of the word shingles in order; words as in simhash.fingerprints, none for a wordless text."""
    import numpy as np
    import xxhash

    digest = xxhash.xxh64_intdigest
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    line = b" ".join(words)
    if len(words) <= shingle:
        return np.array([digest(line, seed)], np.uint64)
    at = np.zeros(len(words) + 1, dtype=np.int64)
    np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1, out=at[1:])
    starts, ends = at[: len(words) - shingle + 1].tolist(), (at[shingle:] - 1).tolist()
    return np.array([digest(line[s:e], seed) for s, e in zip(starts, ends)], np.uint64)


def parity_sketch(s) -> bytes:
    """The parities of the numbers of shingles (uint64) in each bin, and after them the number of shingles."""
    import numpy as np

    width = 1 << max(SKETCH, (2 * len(s)).bit_length())
    odd = np.bincount((s & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes() + len(s).to_bytes(8, "little")


def common_shingles(texts: DataFrame, shingle: int, seed: int, sample: int = 16, most: int = 1 << 18) -> list[int]:
    """The commonest shingles of a sample of texts, from rare to common; they only shape the order, which may be any."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for b in batches:
            for t in (x.as_py() for x in b.column(1)):
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(shingle_hashes(t, shingle, seed)).view(np.int64))], names=["s"])

    some = map_binary(texts.where(F.pmod("h", F.lit(sample)) == 0), "h", "t", sets, "s long")
    top = some.groupBy("s").agg(F.count("*").alias("n")).where("n > 1").orderBy(F.desc("n"), "s").limit(most)
    return [r.s for r in top.collect()][::-1]


def prefixes(texts: DataFrame, similarity: Fraction, shingle: int, seed: int, common: list[int]) -> DataFrame:
    """(h, fp, node, prefix, sketch) of texts (h, t): fingerprint, a hash of the shingle set, its prefix, and its parity sketch with its size."""
    import numpy as np

    late = np.array(common, np.int64).view(np.uint64)
    by = np.argsort(late)
    shared = texts.sparkSession.sparkContext.broadcast((late[by], by))
    p, q = similarity.numerator, similarity.denominator

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        import xxhash

        values, rank = shared.value
        for b in smaller(batches):
            print_, node, first, sketch = [], [], [], []
            for t in b.column(1).to_pylist():
                hashes = shingle_hashes(t, shingle, seed)
                s = np.unique(hashes)
                order = np.full(len(s), -1)
                if len(values):
                    at = np.minimum(np.searchsorted(values, s), len(values) - 1)
                    order = np.where(values[at] == s, rank[at], -1)
                keep = np.lexsort((s, order))[: len(s) - -(-len(s) * p // q) + 1]
                print_.append(majority(hashes) if len(hashes) else 0)
                node.append(xxhash.xxh64_intdigest(s.tobytes(), seed))
                first.append(s[keep].view(np.int64))
                sketch.append(parity_sketch(s))
            longs = lambda x: pa.array(np.array(x, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([b.column(0), longs(print_), longs(node), pa.array(first, pa.list_(pa.int64())), pa.array(sketch, pa.binary())], names=["h", "fp", "node", "prefix", "sketch"])

    return map_binary(texts, "h", "t", make, "h long, fp long, node long, prefix array<long>, sketch binary")


def _shared_entries(read: DataFrame) -> DataFrame:
    """(s, node) of the prefix shingles that several nodes have.

    Only the least and the largest of a hash of the nodes are shuffled for each shingle; those
    that differ go into a bitmap, which picks the entries that are shuffled whole.
    """
    small = F.shiftright(F.col("node"), 33)
    ends = read.select("node", F.explode("prefix").alias("s")).groupBy("s").agg(F.min(small).alias("lo"), F.max(small).alias("hi"))
    several, at = stored_at(ends.where("lo < hi").select("s"))
    bits, table = bitmap(several, "s")
    discard(read.sparkSession, at)

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for b in batches:
            lists = b.column(1)
            size = np.diff(lists.offsets.to_numpy())
            s = lists.values.to_numpy()[lists.offsets[0].as_py() : lists.offsets[-1].as_py()]
            keep = np.flatnonzero(inside(table.value, s.view(np.uint64), bits))
            node = np.repeat(b.column(0).to_numpy(), size)
            yield pa.RecordBatch.from_arrays([pa.array(s[keep]), pa.array(node[keep])], names=["s", "node"])

    return read.select("node", "prefix").mapInArrow(pick, "s long, node long").distinct()


def let_through(root, bodies: list[bytes], p: int, q: int) -> Iterator[tuple]:
    """Places (i, j), once each and in blocks, i by i, of the pairs of different roots whose sketches do not rule out a similarity of p / q."""
    import numpy as np

    size = np.array([int.from_bytes(x[-8:], "little") for x in bodies])
    width = np.array([len(x) - 8 for x in bodies])
    rows = {w: np.flatnonzero(width == w) for w in np.unique(width).tolist()}
    words = {w: np.frombuffer(b"".join(bodies[k][:-8] for k in at), np.uint64).reshape(len(at), -1) for w, at in rows.items()}
    for w, v in ((w, v) for w in rows for v in rows if w <= v):
        right, wide = rows[v], words[v]
        if size[rows[w]].max() * q < size[right].min() * p:
            continue
        while wide.shape[1] > w // 8:  # the wider ones are folded: their halves' parities add up
            wide = wide[:, : wide.shape[1] // 2] ^ wide[:, wide.shape[1] // 2 :]
        step = max(1, (1 << 23) // wide.nbytes)
        for k in range(0, len(rows[w]), step):
            left = rows[w][k : k + step]
            apart = np.bitwise_count(words[w][k : k + step, None] ^ wide[None]).sum(axis=2, dtype=np.int64)
            x, y = size[left][:, None], size[right][None]
            good = (apart * (p + q) <= (x + y) * (q - p)) & (np.minimum(x, y) * q >= np.maximum(x, y) * p) & (root[left][:, None] != root[right][None])
            if w == v:
                good &= left[:, None] < right[None]
            i, j = np.nonzero(good)
            yield left[i], right[j]


def dealt(large: DataFrame, key: str, carried: list[str]) -> DataFrame:
    """(grp, carried) of rows (key, node, chunks): every pair of the chunks of a key is a group, of both chunks' rows."""
    mine = large.withColumn("mine", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int"))
    spread = mine.select(key, *carried, "mine", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("other"))
    return spread.select(F.xxhash64(key, F.least("mine", "other"), F.greatest("mine", "other")).alias("grp"), *carried)


def _of_holders(large: DataFrame, sketches: DataFrame, chunk: int) -> DataFrame:
    return dealt(large.join(sketches, "node").withColumn("chunks", F.ceil(F.col("c") / chunk).cast("int")), "s", ["node", "root", "sketch"])


def near_in_groups(large: DataFrame, sketches: DataFrame, p: int, q: int, chunk: int) -> DataFrame:
    """Of holders (s, node, root, c) of shingles with c holders, the pairs (a, b), a > b, of different roots that sketches (node, sketch) do not rule out for a similarity of p / q.

    All of them, so their number may grow with the square of a group; similar_links takes near_forest.
    """

    def near(group: pa.Table) -> pa.Table:
        import numpy as np

        node, some = group["node"].to_numpy(), [np.zeros((0, 2), np.int64)]
        for i, j in let_through(group["root"].to_numpy(), group["sketch"].to_pylist(), p, q):
            some.append(np.stack([np.maximum(node[i], node[j]), np.minimum(node[i], node[j])], axis=1))
        pairs = np.unique(np.concatenate(some), axis=0)
        return pa.table({"a": pairs[:, 0], "b": pairs[:, 1]})

    return _of_holders(large, sketches, chunk).groupBy("grp").applyInArrow(near, "a long, b long")


def _tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The runs of rows with an equal first column, one after the other."""
    import numpy as np

    held, key = [], None
    for b in batches:
        g = b.column(0).to_numpy()
        ends = np.r_[np.flatnonzero(g[1:] != g[:-1]) + 1, len(g)].tolist() if len(g) else []
        for start, end in zip([0, *ends], ends):
            if held and g[start] != key:
                yield pa.Table.from_batches(held)
                held = []
            key = g[start]
            held.append(b.slice(start, end - start))
    if held:
        yield pa.Table.from_batches(held)


def near_forest(large: DataFrame, sketches: DataFrame, p: int, q: int, chunk: int, most: int = 1 << 20) -> DataFrame:
    """Edges (grp, a, b), a > b, that connect all nodes which the pairs of near_in_groups connect, and no others.

    A task gives an edge only if its edges so far do not connect the ends (of `most` nodes, then
    it starts anew), so it gives fewer than it has read nodes.
    """

    def connect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        up: dict[int, int] = {}

        def top(x: int) -> int:
            while (y := up.setdefault(x, x)) != x:
                up[x] = x = up[y]
            return x

        for group in _tables(batches):
            if len(up) > most:
                up.clear()
            node, edges = group["node"].to_numpy(), np.zeros((2, 0), np.int64)
            for i, j in let_through(group["root"].to_numpy(), group["sketch"].to_pylist(), p, q):
                if len(i):
                    edges = np.stack(forest(np.r_[edges[0], node[i]], np.r_[edges[1], node[j]]))
            new = []
            for a, b in edges.T.tolist():
                x, y = top(a), top(b)
                if x != y:
                    up[max(x, y)] = min(x, y)
                    new.append((a, b))
            if new:
                a, b = np.array(new, np.int64).T
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(a), group["grp"][0].as_py())), pa.array(a), pa.array(b)], names=["grp", "a", "b"])

    return _of_holders(large, sketches, chunk).repartition("grp").sortWithinPartitions("grp").mapInArrow(connect, "grp long, a long, b long")


def family_links(members: DataFrame, p: int, q: int, shingle: int, seed: int, chunk: int = 1024, chunk_bytes: int = 8 << 20) -> DataFrame:
    """Edges (src, dst) that connect, with the roots, all members (fam, node, root, body) of a family whose shingle sets have a similarity of p / q: i (p + q) >= (n_a + n_b) p.

    Families of more than `chunk` texts, or more bytes than `chunk_bytes`, are dealt into chunks, each pair of
    which is a group. Within a group a pair that is connected already is not compared again.
    """
    sizes = members.groupBy("fam").agg(F.ceil(F.greatest(F.count("*") / chunk, F.sum(F.length("body")) / chunk_bytes)).cast("int").alias("chunks"))

    def connect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for group in _tables(batches):
            node = group["node"].to_numpy()
            sets = [np.unique(shingle_hashes(body.as_py(), shingle, seed)) for body in group["body"].combine_chunks()]
            size = np.array([len(s) for s in sets])
            name = np.unique(group["root"].to_numpy(), return_inverse=True)[1]
            src, dst = [], []
            for left, right in let_through(name.copy(), [parity_sketch(s) for s in sets], p, q):
                start = np.r_[np.flatnonzero(np.r_[True, left[1:] != left[:-1]]), len(left)] if len(left) else []
                for begin, end in zip(start[:-1], start[1:]):
                    i, rest, some = int(left[begin]), right[begin:end], 1
                    while len(rest := rest[name[rest] != name[i]]):
                        now, rest, some = rest[:some], rest[some:], 2 * some
                        flat, own = np.concatenate([sets[j] for j in now]), sets[i]
                        held = own[np.minimum(np.searchsorted(own, flat), len(own) - 1)] == flat
                        common = np.add.reduceat(held.astype(np.int64), np.cumsum(size[now]) - size[now])
                        for j in now[common * (p + q) >= (size[now] + len(own)) * p].tolist():
                            if name[i] != name[j]:
                                src.append(node[i])
                                dst.append(node[j])
                                name[name == name[j]] = name[i]
            if src:
                yield pa.RecordBatch.from_arrays([pa.array(np.array(src)), pa.array(np.array(dst))], names=["src", "dst"])

    groups = dealt(members.join(sizes, "fam"), "fam", ["node", "root", "body"])
    return groups.repartition("grp").sortWithinPartitions("grp").mapInArrow(connect, "src long, dst long")


def similar_links(texts: DataFrame, similarity: float = 0.8, shingle: int = 5, radius: int = 4, seed: int = 42, block: int = 1024) -> tuple[DataFrame, DataFrame]:
    """Of texts (h, t): (h, node) of every text, and edges (src, dst) that connect all nodes of at least the similarity, or of fingerprints within radius bits.

    Equal shingle sets are one node. Fingerprints of the same shingles are linked first
    (radius below 0: not at all). Then every node is compared with one holder of its
    prefix's shingles; then, under shingles whose holders are not yet all connected (one
    of those that have the same holders), every pair from different components is: by
    sketches between chunks of `block` holders (near_forest), and what these connect text by
    text (family_links).
    """
    spark, gone = texts.sparkSession, []

    def kept(df: DataFrame) -> DataFrame:
        """df, stored until the links are made."""
        df, path = stored_at(df)
        gone.append(path)
        return df

    t = Fraction(str(similarity))
    p, q = t.numerator, t.denominator
    read = kept(prefixes(texts, t, shingle, seed, common_shingles(texts, shingle, seed)))
    named = stored(read.select("h", "node").distinct())
    entries, first_entries = stored_at(_shared_entries(read))
    sketches = read.select("node", F.col("sketch").alias("body")).dropDuplicates(["node"])
    first_text = read.groupBy("node").agg(F.min("h").alias("h"))

    def may(left, right):
        import numpy as np

        out = np.zeros(len(left), dtype=bool)
        for k, (a, b) in enumerate(zip(left, right)):
            na, nb, a, b = int(a[-1]), int(b[-1]), a[:-1], b[:-1]
            if min(na, nb) * q < max(na, nb) * p:
                continue
            while len(a) != len(b):  # the longer one is folded: its halves' parities add up
                if len(a) > len(b):
                    a = a[: len(a) // 2] ^ a[len(a) // 2 :]
                else:
                    b = b[: len(b) // 2] ^ b[len(b) // 2 :]
            out[k] = int(np.bitwise_count(a ^ b).sum()) * (p + q) <= (na + nb) * (q - p)
        return out

    def numbers(body):
        import numpy as np

        return np.frombuffer(body, np.uint64)

    def set_of(body):
        import numpy as np

        return np.unique(shingle_hashes(body, shingle, seed))

    def similar(left, right):
        import numpy as np

        return np.array([len(np.intersect1d(x, y, assume_unique=True)) * (p + q) >= (len(x) + len(y)) * p for x, y in zip(left, right)])

    def with_bodies(wanted: DataFrame) -> DataFrame:
        """Rows (node, ...) of distinct nodes, with the body of one of the node's texts."""
        wanted = kept(wanted.join(first_text, "node"))
        some = bitmap_hits(texts.select("h", F.coalesce("t", F.lit("")).cast("binary").alias("body")).where("h is not null"), "h", bitmap(wanted.select("h").distinct(), "h"))
        return wanted.join(some.groupBy("h").agg(F.first("body").alias("body")), "h").drop("h")

    def verified(pairs: DataFrame) -> DataFrame:
        """The pairs (grp, a, b) of at least the similarity, by sketches and then by the texts themselves: i (p + q) >= (n_a + n_b) p."""
        near = cut(compare_pairs(pairs, sketches, numbers, may).join(pairs.select("grp", F.col("a").alias("src"), F.col("b").alias("dst")), ["src", "dst"]).select("grp", F.col("src").alias("a"), F.col("dst").alias("b")))
        return cut(compare_pairs(near, with_bodies(near.select(F.explode(F.array("a", "b")).alias("node")).distinct()), set_of, similar))

    marked = []
    if radius >= 0:
        fps = kept(read.select("fp", "node").distinct())
        near = links(fps.select("fp").distinct(), radius)
        one = fps.groupBy("fp").agg(F.min("node").alias("dst"))
        same = fps.join(one, "fp").where(F.col("node") != F.col("dst")).select(F.col("node").alias("src"), "dst")
        apart = near.join(one.select(F.col("fp").alias("src"), F.col("dst").alias("a")), "src").drop("src").join(one.select(F.col("fp").alias("dst"), F.col("dst").alias("b")), "dst")
        marked = [cut(same.unionByName(apart.select(F.col("a").alias("src"), F.col("b").alias("dst"))))]

    def stars(edges: list[DataFrame]) -> list[DataFrame]:
        """As edges, with one for a node: what they connect is worked out once."""
        return [components(reduce(DataFrame.unionByName, edges)).select(F.col("node").alias("src"), F.col("root").alias("dst"))] if edges else []

    def rooted(rows: DataFrame, edges: list[DataFrame]) -> DataFrame:
        if not edges:
            return rows.withColumn("root", F.col("node"))
        return rows.join(edges[0].select(F.col("src").alias("node"), F.col("dst").alias("r")), "node", "left").select(*rows.columns, F.coalesce("r", "node").alias("root"))

    linked = stars(marked)
    at, first_at = stored_at(rooted(entries, linked))
    discard(spark, first_entries)
    refs = at.groupBy("s").agg(F.min(F.struct("root", "node")).alias("r"))
    to_one = at.join(refs, "s").where(F.col("root") != F.col("r.root")).groupBy("node", F.col("r.node").alias("b")).agg(F.count("*").alias("c")).groupBy("node").agg(F.max_by("b", F.struct("c", "b")).alias("b"))
    linked = stars([*linked, verified(cut(to_one.select(F.xxhash64("b", F.pmod("node", F.lit(64))).alias("grp"), F.col("node").alias("a"), "b")))])
    at, second_at = stored_at(rooted(at.drop("root"), linked))
    discard(spark, first_at)
    # Shingles of the same holders are one: two XORs of 64-bit hashes tell the sets of holders apart.
    holders = at.groupBy("s").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("c"), *(F.bit_xor(F.xxhash64("node", F.lit(k))).alias(f"x{k}") for k in (1, 2)))
    holders = holders.where("lo < hi").groupBy("c", "x1", "x2").agg(F.min("s").alias("s")).select("s", "c")
    left = kept(at.join(holders, "s"))
    discard(spark, second_at)
    wide = bitmap_hits(read.select("node", "sketch"), "node", bitmap(left.select("node").distinct(), "node")).dropDuplicates(["node"])
    met = cut(near_forest(left, wide, p, q, block))
    families = components(met.select(F.col("a").alias("src"), F.col("b").alias("dst"))).withColumnRenamed("root", "fam")
    members = kept(with_bodies(families.join(left.select("node", "root").distinct(), "node")))
    second = cut(family_links(members, p, q, shingle, seed, block))
    discard(spark, *gone)
    return named, reduce(DataFrame.unionByName, [*linked, second])


def keep_dissimilar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = 0.8, shingle: int = 5, radius: int = 4, seed: int = 42) -> DataFrame:
    """docs, all columns, whatever their names, with one row of each group of linked texts: that of the smallest id.

    Texts are linked by fingerprints of their word shingles at most `radius` bits apart, or by
    a shingle Jaccard of at least `similarity`, over any chain of such links.

    Null ids come last; a repeated row is kept once. Null, empty and wordless texts have
    the same, empty shingle set. An empty table stays empty. Rows are told apart by id and a
    hash of the text.
    """
    order, body = F.coalesce(F.col(id_col).cast("long"), F.lit((1 << 63) - 1)), F.xxhash64(F.col(text_col))
    keyed = docs.select(order.alias("k"), body.alias("h"), F.col(text_col).alias("t"))
    with shuffles_dropped(docs.sparkSession):
        named, edges = similar_links(keyed.select("h", "t"), similarity, shingle, radius, seed)
        root = named.join(components(edges), "node", "left").select("h", F.coalesce("root", "node").alias("root"))
        lowest = stored(keyed.groupBy("h").agg(F.min("k").alias("k")).join(root, "h"))
    return keep_lowest(docs, order, body, lowest)
