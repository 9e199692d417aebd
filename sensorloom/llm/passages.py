"""Repeated passages: windows of a fixed length that also start earlier, by depth-limited radix passes.

Only suffixes' first `length` bytes (windows) are ordered, and only as far as needed. A
window's leading digit is its minimizer: the gram of smallest hash inside it, leftmost
first. Equal windows have equal minimizers at equal places, so one row per minimizer and
text position stands for all windows that share it. Each pass refines the groups that still
hold two members:

1. the minimizer's gram; grams that stand once in the corpus end here;
2. the whole stretch of windows around a minimizer;
3. runs of up to eight windows of a stretch, aligned to the minimizer;
4. single windows: groups of equal ones, of which all but the earliest are repeats.

Passes 2 to 4 are alike: equal units are settled at once (all but the earliest are repeats),
and of each kind of unit only the earliest goes on, and only where its core has several
kinds. A unit's core is what all windows that can be equal to one of its own must share: the
gram of a stretch, and the bytes common to all windows of an aligned run.

Units are equal if two independent 64-bit hashes agree: one of the core and one, of another
base, of the whole unit; in pass 4 both are of the window's own bytes.

Groups are never gathered: passes are counts and minima (combined before the shuffle), and
memberships come back as fixed-size bitmaps, whose false hits only add rows that a later
pass drops.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bitmap, bitmap_hits, discard, inside, stored, stored_at
from .hashing import text_chunks

GRAM = 32
RUN = 8
PIECE = 1 << 20  # a power of two, the most bytes hashed at a time
CHUNK = 1 << 17  # bytes hashed at a time otherwise: their arrays stay in a core's cache
LAST = (1 << 63) - 1


class Stretches:
    """Minimizers of all windows of a list of (id, offset, bytes) pieces, as arrays."""

    def __init__(self, pieces: list[tuple[int, int, bytes, int]], length: int, powers: dict | None = None):
        """powers keeps what does not depend on the bytes from one list of pieces to the next."""
        import numpy as np

        self.length = length
        self.powers = {} if powers is None else powers
        bodies = [p[2] for p in pieces]
        buf = np.frombuffer(b"".join(bodies), dtype=np.uint8)
        sizes = np.array([len(b) for b in bodies])
        ends = np.cumsum(sizes)
        n = len(buf)
        self.prefix, self.inverse = self._sums(buf, 0x9E3779B97F4A7C15)
        self.buf = buf
        self.second = None
        begins = np.zeros(n, dtype=bool)
        for e, s in zip(ends.tolist(), sizes.tolist()):
            if s >= length:
                begins[e - s : e - length + 1] = True
        at = np.flatnonzero(begins)
        if not len(at):
            self.first = self.count = self.back = self.ids = self.offset = self.rows = at
            self.gram = at.view(np.uint64)
            return
        grams = self.digest(np.arange(n - GRAM + 1), GRAM)
        low = np.uint64(2 * PIECE - 1)
        m = (grams & ~low) | np.arange(len(grams), dtype=np.uint64)
        width, need = 1, length - GRAM + 1
        while 2 * width <= need:
            m = np.minimum(m[:-width], m[width:])
            width *= 2
        if need > width:
            m = np.minimum(m[: len(m) - (need - width)], m[need - width :])
        where = (m[at] & low).astype(np.int64)
        new = np.flatnonzero(np.r_[True, (where[1:] != where[:-1]) | (at[1:] != at[:-1] + 1)])
        self.first = at[new]
        self.count = np.diff(np.r_[new, len(at)])
        # A minimizer's hash is small by choice; mixed again, it spreads over a bitmap.
        mixed = grams[where[new]] * np.uint64(0x9FB21C651E98DF25)
        self.gram = (mixed ^ (mixed >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
        self.back = where[new] - self.first
        piece = np.searchsorted(ends, self.first, side="right")
        self.ids = np.array([p[0] for p in pieces], dtype=np.int64)[piece]
        self.rows = np.array([p[3] for p in pieces], dtype=np.int64)[piece]
        self.offset = self.first - (ends - sizes)[piece] + np.array([p[1] for p in pieces], dtype=np.int64)[piece]

    def _sums(self, buf, base: int):
        """Running sums of the bytes times powers of base, and inverse powers, modulo 2**64."""
        import numpy as np

        n = len(buf)
        if base not in self.powers or len(self.powers[base][0]) <= n:
            both = np.full((2, max(n, CHUNK) + 1), base, dtype=np.uint64)
            both[1] = pow(base, -1, 1 << 64)
            both[:, 0] = 1
            np.multiply.accumulate(both, axis=1, out=both)
            self.powers[base] = both
        power, inverse = self.powers[base]
        prefix = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * power[:n], out=prefix[1:])
        return prefix, inverse

    def digest(self, start, size, other: bool = False):
        """64-bit hashes of the bytes [start, start + size), by one base or another."""
        import numpy as np

        prefix, inverse = self.prefix, self.inverse
        if other:
            if self.second is None:
                self.second = self._sums(self.buf, 0xD1342543DE82EF95)
            prefix, inverse = self.second
        h = (prefix[start + size] - prefix[start]) * inverse[start]
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
        h *= np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(29))

    def units(self, keep) -> Units:
        return Units(self.first[keep], self.count[keep], self.back[keep], self.gram[keep], self.ids[keep], self.offset[keep], self.rows[keep])

    def whole(self, u: Units):
        """Hash of every unit: its bytes, where its minimizer is, and how many windows it has."""
        import numpy as np

        if not len(u.first):
            return u.gram
        h = self.digest(u.first, u.count + self.length - 1, other=True)
        return h ^ ((u.back.astype(np.uint64) << np.uint64(32) | u.count.astype(np.uint64)) * np.uint64(0xD6E8FEB86659FD93))

    def core(self, u: Units, size: int | None):
        """Hash of the bytes that all windows of an aligned run share, and of its place; a stretch's gram, a window's bytes."""
        import numpy as np

        if size is None or not len(u.first):
            return u.gram
        if size == 1:
            return self.digest(u.first, self.length)
        place = u.back // size
        h = self.digest(u.first + u.back - place * size, self.length - size + 1)
        return h ^ (place.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))


class Units:
    """Runs of windows that share a minimizer: begin in the buffer, windows, distance to the minimizer, gram, id, offset and row."""

    def __init__(self, first, count, back, gram, ids, offset, rows):
        self.first, self.count, self.back, self.gram, self.ids, self.offset, self.rows = first, count, back, gram, ids, offset, rows

    def only(self, keep) -> Units:
        return Units(self.first[keep], self.count[keep], self.back[keep], self.gram[keep], self.ids[keep], self.offset[keep], self.rows[keep])

    def split(self, size: int) -> Units:
        """Runs cut where the distance to the minimizer passes a multiple of size."""
        import numpy as np

        n = self.count
        step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        block = (np.repeat(self.back, n) - step) // size
        new = np.flatnonzero((step == 0) | np.r_[True, block[1:] != block[:-1]]) if len(step) else step
        run, at = np.repeat(np.arange(len(n)), n)[new], step[new]
        count = np.diff(np.r_[new, len(step)])
        return Units(self.first[run] + at, count, self.back[run] - at, self.gram[run], self.ids[run], self.offset[run] + at, self.rows[run])


def row_key(ids, offsets):
    """A 64-bit hash of (id, offset)."""
    import numpy as np

    h = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + offsets.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def _scan(docs: DataFrame, length: int, rows, schema: str) -> DataFrame:
    """rows(stretches) -> list of arrays, over all texts; a long text goes in overlapping pieces."""
    names = [c.split()[0] for c in schema.split(",")]
    most = min(PIECE, max(CHUNK, 8 * length))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        powers: dict = {}
        for b in batches:
            pieces = []
            for i, body, row in zip(*(b.column(c).to_pylist() for c in range(3))):
                if len(body) >= length:
                    step = most - length
                    pieces += [(i, o, body[o : o + step + length - 1], row) for o in range(0, max(1, len(body) - length + 1), step)]
            for lo, hi in text_chunks([p[2] for p in pieces], most):
                out = rows(Stretches(pieces[lo:hi], length, powers))
                arrays = [pa.array(np.ascontiguousarray(a).view(np.int64) if a.dtype == np.uint64 else a.astype(np.int64)) for a in out]
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    return docs.select("id", "body", F.col("row") if "row" in docs.columns else F.lit(0).cast("long").alias("row")).mapInArrow(run, schema)


def repeated_windows(docs: DataFrame, length: int = 100, bits: int = 27) -> DataFrame:
    """(id, row, start, stop): byte ranges of docs(id, body, row if rows of one id are to be told apart) covered by windows that also start earlier.

    Earlier means a smaller id, or the same id and a smaller start. bits bounds the
    bitmaps that passes are carried in (2**27 bits are 16 MB), whatever the input: a fuller
    bitmap lets more rows through to the next pass, it changes no result.
    """
    import numpy as np

    def grams(s):
        h, n = np.unique(s.gram, return_counts=True)
        return [h, n]

    counted = _scan(docs, length, grams, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    gram_bits, frequent = bitmap(stored(counted.where("n > 1").select("gram")), "gram", bits)

    def gram_hit(s):
        return np.flatnonzero(inside(frequent.value, s.gram, gram_bits)) if len(s.gram) else np.zeros(0, np.int64)

    place = F.struct(F.col("id").alias("id"), F.col("start").alias("start"))
    told = "row" in docs.columns
    columns = "core long, whole long, id long, start long, windows long" + (", row long" if told else "")
    marks, chosen = None, []
    for size in (None, RUN, 1):

        def units(s, size=size, chosen=tuple(chosen)):
            u = s.units(gram_hit(s))
            for (bits_, sent), part in zip(chosen, (RUN, 1)):
                u = u.only(np.flatnonzero(inside(sent.value, row_key(u.ids, u.offset), bits_)) if len(u.ids) else np.zeros(0, np.int64)).split(part)
            return [s.core(u, size), s.whole(u), u.ids, u.offset, u.count, u.rows][: 6 if told else 5]

        rows, rows_at = stored_at(_scan(docs, length, units, columns))
        firsts = rows.groupBy("core", "whole").agg(F.min(place).alias("early"), F.count("*").alias("n")).select("core", "whole", "early.*", "n")
        firsts, firsts_at = stored_at(firsts if size != 1 else firsts.where("n > 1"))
        early = firsts.where("n > 1").select("core", "whole", F.col("id").alias("__i"), F.col("start").alias("__s"))
        later = bitmap_hits(rows, "whole", bitmap(early.select("whole"), "whole", bits)).join(early, ["core", "whole"]).where((F.col("id") > F.col("__i")) | ((F.col("id") == F.col("__i")) & (F.col("start") > F.col("__s"))))
        found = later.select("id", F.col("row") if told else F.lit(0).cast("long").alias("row"), "start", (F.col("start") + F.col("windows") - 1 + length).alias("stop"))
        found = stored(found)
        marks = found if marks is None else marks.unionByName(found)
        if size != 1:
            several = firsts.groupBy("core").agg(F.count("*").alias("kinds")).where("kinds > 1").select("core")
            keys, keys_at = stored_at(_bitmap_key(firsts.join(several, "core", "left_semi")))
            chosen.append(bitmap(keys, "key", bits))
            discard(docs.sparkSession, keys_at)
        discard(docs.sparkSession, rows_at, firsts_at)
    # False hits of a bitmap add true windows of the corpus, which cannot disturb a minimum.
    for used in (frequent, *(sent for _, sent in chosen)):  # what they let through is stored
        used.destroy()
    return marks


def _bitmap_key(rows: DataFrame) -> DataFrame:
    """row_key() of (id, start) as a column, in the same arithmetic."""

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for b in batches:
            k = row_key(b.column(0).to_numpy(), b.column(1).to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array(k.view(np.int64))], names=["key"])

    return rows.select("id", "start").mapInArrow(keyed, "key long")


def remove_passages(docs: DataFrame, length: int = 100, id_col: str = "doc_id", text_col: str = "text", bits: int = 27, keep_text: bool = False) -> DataFrame:
    """One row per document: n_bytes, n_removed, n_spans and kept_sha256 of its UTF-8 text without repeats.

    A byte goes where some window of `length` bytes over it also starts earlier: in a
    document of smaller id, or before in the same one. Windows are judged on the input and
    do not cross documents. n_spans counts maximal removed runs. With keep_text the
    remaining bytes are returned too (kept binary).

    Null, empty and shorter texts have nothing removed. Of rows
    of one id none is the earlier document: a repeated row stays as it is, and of different
    texts only what starts later in its own text than in any of them goes. Null ids come last. An empty table gives no rows. Other columns are not read.
    """
    d = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)).alias("id"),
        F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("body"),
    )
    # Only where rows of different texts share an id are they told apart by a hash.
    digest = F.xxhash64("body")
    shared = d.groupBy("id").agg(F.min(digest).alias("a"), F.max(digest).alias("z")).where("a <> z")
    told = shared.limit(1).count() > 0
    marks = repeated_windows(d.withColumn("row", digest) if told else d, length, bits)
    d = d.withColumn("row", digest if told else F.lit(0).cast("long"))
    by_doc = marks.groupBy("id", "row").agg(F.collect_set(F.shiftleft(F.col("start"), 32).bitwiseOR(F.col("stop"))).alias("marks"))
    joined = d.join(by_doc, ["id", "row"], "left").select("doc_id", "body", "marks")
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary" if keep_text else "")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        import numpy as np

        for b in batches:
            out: list[list] = [[] for _ in range(5)]
            for body, marks in zip(b.column(1).to_pylist(), b.column(2)):
                removed, runs, kept = 0, 0, body
                if marks.is_valid:
                    m = np.sort(marks.values.to_numpy())
                    s, e = m >> 32, np.maximum.accumulate(m & 0xFFFFFFFF)
                    new = np.flatnonzero(np.r_[True, s[1:] > e[:-1]])
                    start, stop = s[new], e[np.r_[new[1:] - 1, len(e) - 1]]
                    removed, runs = int((stop - start).sum()), len(start)
                    edge = [0, *np.stack([start, stop], axis=1).ravel().tolist(), len(body)]
                    kept = b"".join(body[a:z] for a, z in zip(edge[::2], edge[1::2]))
                for o, x in zip(out, (len(body), removed, runs, hashlib.sha256(kept).hexdigest(), kept)):
                    o.append(x)
            types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
            arrays = [b.column(0), *(pa.array(o, t) for o, t in zip(out, types))]
            yield pa.RecordBatch.from_arrays(arrays if keep_text else arrays[:-1], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"][: len(arrays) - (not keep_text)])

    return joined.mapInArrow(cut, schema)
