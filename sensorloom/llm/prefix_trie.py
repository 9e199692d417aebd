"""The prefix trie of many turn sequences, by an LCP-aware external mergesort.

Sequences are dealt by range to tasks. A task sorts what arrives into runs, each entry with
the length of the prefix it shares with the entry before it (its LCP), and merges the runs
by a loser tree: of two heads, the one that shares more with the last output is the smaller,
and only where they share the same are further turns compared. The merged stream keeps the
path of open nodes on a stack; a node is finished when the next entry shares less than its depth.

Nodes on a range's edges may go on in other ranges. These alone leave a task as partial
nodes, are added up, and hand their subtrees' sums on to their ancestors by doubling steps.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, join_by_key, stored

NODES = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def sorted_run(items: list[tuple]) -> list[tuple]:
    """(sequence, id, weights, lcp) of (sequence, id, weights), sorted by sequence and id; lcp is shared with the one before."""
    run, before = [], []
    for seq, i, w in sorted(items, key=lambda x: x[:2]):
        n, most = 0, min(len(seq), len(before))
        while n < most and seq[n] == before[n]:
            n += 1
        run.append((seq, i, w, n))
        before = seq
    return run


class LoserTree:
    """Merges runs of (sequence, id, weights, lcp); each lcp it returns is with what it returned before.

    head[r] is a run's next entry and lcp[r] the prefix that it shares with the last output.
    An inner node holds the run that lost there; its lcp is with the winner of that match.
    """

    def __init__(self, runs: list[list[tuple]]):
        self.runs, self.at = runs, [0] * len(runs)
        self.size = 1 << max(0, len(runs) - 1).bit_length()
        self.head: list = [None] * self.size
        self.lcp = [-1] * self.size
        for r, run in enumerate(runs):
            self.head[r], self.lcp[r] = (run[0], 0) if run else (None, -1)
        self.compared = 0
        self.loser = [0] * self.size
        level = list(range(self.size))
        node = self.size
        while len(level) > 1:
            node //= 2
            winners = []
            for j in range(0, len(level), 2):
                w, self.loser[node + j // 2] = self.match(level[j], level[j + 1])
                winners.append(w)
            level = winners
        self.winner = level[0]

    def match(self, a: int, b: int) -> tuple[int, int]:
        """(winner, loser) of two runs' heads; the loser's lcp becomes that with the winner."""
        la, lb = self.lcp[a], self.lcp[b]
        if la != lb:
            return (a, b) if la > lb else (b, a)
        if la < 0:
            return a, b
        x, y = self.head[a][0], self.head[b][0]
        n, most = la, min(len(x), len(y))
        while n < most and x[n] == y[n]:
            n += 1
        self.compared += n - la + 1
        first = x[n] < y[n] if n < most else (len(x), self.head[a][1]) <= (len(y), self.head[b][1])
        if first:
            self.lcp[b] = n
            return a, b
        self.lcp[a] = n
        return b, a

    def __iter__(self) -> Iterator[tuple]:
        while self.lcp[self.winner] >= 0:
            r = self.winner
            seq, i, w, _ = self.head[r]
            yield seq, i, w, self.lcp[r]
            self.at[r] += 1
            if self.at[r] < len(self.runs[r]):
                self.head[r] = self.runs[r][self.at[r]]
                self.lcp[r] = self.head[r][3]
            else:
                self.head[r], self.lcp[r] = None, -1
            node = (r + self.size) // 2
            while node:
                r, self.loser[node] = self.match(r, self.loser[node])
                node //= 2
            self.winner = r


class OpenNode:
    """A node of the path that is still growing: sums of its finished children and of its own ends."""

    __slots__ = ("key", "weight", "on_edge", "least", "convs", "children", "leaves", "saved", "sha", "ends", "waiting")

    def __init__(self, key: bytes, weight: int, on_edge: tuple):
        self.key, self.weight, self.on_edge = key, weight, on_edge
        self.least, self.convs, self.children, self.leaves, self.saved = None, 0, 0, 0, 0
        self.sha, self.ends, self.waiting = None, [], []


#: Kinds of rows that leave a merge: finished nodes, finished children of partial nodes, partial nodes, runs of ids that end at a partial node.
FINISHED, CHILD, PARTIAL, ENDS = range(4)
ROWS = pa.schema([
    ("kind", pa.int8()), ("node", pa.binary()), ("parent", pa.binary()), ("conv_id", pa.int64()), ("depth", pa.int64()), ("parent_conv_id", pa.int64()),
    ("n_convs", pa.int64()), ("n_children", pa.int64()), ("n_leaves", pa.int64()), ("saved_tokens", pa.int64()), ("ends_sha256", pa.string()), ("weight", pa.int64()), ("ids", pa.string()),
])
ROWS_DDL = "kind tinyint, node binary, parent binary, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, weight long, ids string"


def trie_rows(merged, low: list, high: list, head: int, ids_a_row: int = 4096) -> Iterator[tuple]:
    """Rows of ROWS from entries (sequence, id, weights, lcp) in order; low and high are the heads (`head` turns at most) of the first and the last sequence.

    A node is partial if its path, as far as `head` turns go, lies on one of the two heads.
    """
    stack: list[OpenNode] = [OpenNode(b"", 0, (True, True))]

    def ends_of(x: OpenNode) -> tuple:
        first, text = x.ends[0], ",".join(map(str, x.ends))
        x.ends = []
        return (ENDS, x.key, None, first, None, None, None, None, None, None, None, None, text)

    def finish() -> Iterator[tuple]:
        x, depth = stack.pop(), len(stack)
        up = stack[-1] if stack else None
        if up is not None:
            up.convs += x.convs
            up.least = x.least if up.least is None else min(up.least, x.least)
        if any(x.on_edge):
            if x.ends:
                yield ends_of(x)
            yield (PARTIAL, x.key, up.key if up is not None else None, x.least, depth, None, x.convs, x.children, x.leaves, x.saved, None, x.weight, None)
            return
        leaves, saved = x.leaves or 1, x.saved + (x.convs - 1) * x.weight
        for c in x.waiting:
            yield (FINISHED, None, None, c[0], depth + 1, x.least, *c[1:], None, None)
        up.children += 1
        up.leaves += leaves
        up.saved += saved
        row = (x.least, x.convs, x.children, leaves, saved, (x.sha or hashlib.sha256()).hexdigest())
        if any(up.on_edge):
            yield (CHILD, None, up.key, row[0], depth, None, *row[1:], None, None)
        else:
            up.waiting.append(row)

    for seq, i, weights, shared in merged:
        while len(stack) - 1 > shared:
            yield from finish()
        for d in range(len(stack), len(seq) + 1):
            up, turn = stack[-1], seq[d - 1]
            edge = up.on_edge
            if d <= head:
                edge = (edge[0] and d <= len(low) and low[d - 1] == turn, edge[1] and d <= len(high) and high[d - 1] == turn)
            stack.append(OpenNode(hashlib.blake2b(up.key + turn, digest_size=16).digest(), weights[d - 1], edge))
        x = stack[-1]
        x.convs += 1
        x.least = i if x.least is None else min(x.least, i)
        if any(x.on_edge):
            x.ends.append(i)
            if len(x.ends) >= ids_a_row:
                yield ends_of(x)
        else:
            x.sha, text = (x.sha, f",{i}") if x.sha else (hashlib.sha256(), str(i))
            x.sha.update(text.encode())
    while stack:
        yield from finish()


def merge_ranges(sequences: DataFrame, ranges: int, head: int = 8, run_rows: int = 8192) -> DataFrame:
    """ROWS of sequences (conv_id, turns, weights), dealt into ranges of (first `head` turns, conv_id)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = []
        for b in batches:
            for at in range(0, b.num_rows, run_rows):
                part = b.slice(at, run_rows)
                runs.append(sorted_run(list(zip(part.column(1).to_pylist(), part.column(0).to_pylist(), part.column(2).to_pylist()))))
        if not runs:
            return
        low, high = min(r[0][0] for r in runs)[:head], max(r[-1][0] for r in runs)[:head]
        out: list[tuple] = []
        for row in trie_rows(LoserTree(runs), low, high, head):
            out.append(row)
            if len(out) >= 8192:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), ROWS.types)], schema=ROWS)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), ROWS.types)], schema=ROWS)

    dealt = sequences.withColumn("head", F.slice("turns", 1, head)).repartitionByRange(ranges, "head", "conv_id")
    return dealt.select("conv_id", "turns", "weights").mapInArrow(run, ROWS_DDL)


def joined_digests(ends: DataFrame) -> DataFrame:
    """(node, ends_sha256) of runs of ids (node, conv_id, ids): runs of a node in order of their first id, as one stream."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, sha = None, None
        made = lambda: pa.RecordBatch.from_arrays([pa.array([node], pa.binary()), pa.array([sha.hexdigest()])], names=["node", "ends_sha256"])
        for b in batches:
            for n, ids in zip(b.column(0).to_pylist(), b.column(2).to_pylist()):
                if n != node:
                    if sha is not None:
                        yield made()
                    node, sha = n, hashlib.sha256(ids.encode())
                else:
                    sha.update(f",{ids}".encode())
        if sha is not None:
            yield made()

    return ends.select("node", "conv_id", "ids").repartition("node").sortWithinPartitions("node", "conv_id").mapInArrow(run, "node binary, ends_sha256 string")


def combined(partial: DataFrame) -> DataFrame:
    """Partial nodes added up, with sums over their whole subtrees.

    `up` is the ancestor 2**k levels above and the sums reach 2**k - 1 levels down; each step
    adds the sums of those that lie 2**k below and doubles k, so steps grow with the
    logarithm of the depth. The number of partial nodes is that of the ranges' edges.
    """
    once = partial.groupBy("node", "parent").agg(
        F.min("conv_id").alias("conv_id"), F.min("depth").alias("depth"), F.min("weight").alias("weight"), F.sum("n_convs").alias("n_convs"),
        F.sum("n_children").alias("others"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"),
    )
    once = stored(once)
    below = once.where("parent IS NOT NULL").groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("edge_children"))
    nodes = once.join(below, "node", "left").fillna(0, ["edge_children"]).withColumn("n_children", F.col("others") + F.col("edge_children"))
    sums = stored(nodes.select(
        "node", "parent", F.col("parent").alias("up"), "conv_id", "depth", "n_convs", "n_children", "others",
        (F.col("n_leaves") + (F.col("n_children") == 0).cast("long")).alias("n_leaves"), (F.col("saved_tokens") + (F.col("n_convs") - 1) * F.col("weight")).alias("saved_tokens"),
    ))
    while sums.where("up IS NOT NULL").limit(1).count():
        gained = sums.where("up IS NOT NULL").groupBy(F.col("up").alias("node")).agg(F.sum("n_leaves").alias("more_leaves"), F.sum("saved_tokens").alias("more_saved"))
        further = sums.select(F.col("node").alias("up"), F.col("up").alias("next"))
        sums = stored(
            sums.join(gained, "node", "left").join(further, "up", "left").withColumn("n_leaves", F.col("n_leaves") + F.coalesce("more_leaves", F.lit(0)))
            .withColumn("saved_tokens", F.col("saved_tokens") + F.coalesce("more_saved", F.lit(0))).withColumn("up", F.col("next")).drop("next", "more_leaves", "more_saved")
        )
    return sums.drop("up")


def prefix_trie(sequences: DataFrame, range_turns: int = 1 << 20, head: int = 8) -> DataFrame:
    """Every node of the prefix trie of sequences (conv_id, turns array<binary>, weights array<long>): the columns NODES.

    conv_id is the smallest member; parent_conv_id its parent's (null for the root); n_convs
    the members; n_children, n_leaves and saved_tokens are of the node and its subtree;
    ends_sha256 is of the comma-joined ascending ids of the members that end there. Ids are
    distinct and not null. Equal sequences are one path. No sequence, no node.

    A task holds about range_turns turns, as their digests; a sequence is one row. Equal
    heads are split between ranges by id, so a hot prefix spreads over as many tasks as it fills.
    """
    size = sequences.agg(F.sum(F.size("turns") + 1)).first()[0] or 0
    ranges = max(sequences.sparkSession.sparkContext.defaultParallelism, -(-size // range_turns))
    rows = stored(merge_ranges(sequences, ranges, head))
    nodes = combined(rows.where(F.col("kind") == PARTIAL))
    shas = joined_digests(rows.where(F.col("kind") == ENDS))
    parents = nodes.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"), F.col("others").alias("times"))
    edge = nodes.join(parents.drop("times"), "parent", "left").join(shas, "node", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)))
    children = rows.where(F.col("kind") == CHILD).drop("parent_conv_id")
    children = join_by_key(children, parents.where("times > 0"), "parent", max(1, nodes.agg(F.sum("others")).first()[0] or 0))
    return rows.where(F.col("kind") == FINISHED).select(NODES).unionByName(children.select(NODES)).unionByName(edge.select(NODES))


def turn_sequences(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, said array<struct<turn, digest, weight>>): a conversation's turns in order, each as 128 bits of a SHA-256 of role and text.

    Turns are ordered by number, null first, those of one number by digest; repeated rows are
    turns of their own. Null roles and texts are empty. Rows without an id belong to no conversation.
    """
    role, text = F.coalesce(F.col(role_col).cast("string"), F.lit("")), F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    digest = F.unhex(F.substring(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256), 1, 32))
    said = conversations.select(F.col(id_col).cast("long").alias("conv_id"), F.struct(F.col(turn_col).alias("turn"), digest.alias("digest"), F.length(text).cast("long").alias("weight")).alias("said"))
    return said.where("conv_id IS NOT NULL").groupBy("conv_id").agg(F.sort_array(F.collect_list("said")).alias("said"))


def with_shared_heads(turns: DataFrame, group: int = 100, most: int = 6) -> DataFrame:
    """turns with each conversation c's first h turns replaced by those of conversation c - c % group, h = crc32(c) % most."""
    own = stored(turns)
    (h, base, head) = fresh(turns, "h", "base", "head")
    heads = own.where(F.col("conv_id") % group == 0).select(F.col("conv_id").alias(base), F.slice("said", 1, most - 1).alias(head))
    asked = own.withColumn(h, (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).cast("int")).withColumn(base, F.col("conv_id") - F.col("conv_id") % group)
    first = F.when(F.col(head).isNull(), F.slice("said", 1, 0)).otherwise(F.slice(head, F.lit(1), F.col(h)))
    return asked.join(heads, base, "left").select("conv_id", F.concat(first, F.slice("said", F.col(h) + 1, F.greatest(F.size("said"), F.lit(1)))).alias("said"))


def conversation_trie(conversations: DataFrame, rebuild: bool = False, **more) -> DataFrame:
    """The prefix trie of conversations (see prefix_trie and turn_sequences), with shared heads if `rebuild` is true.

    Conversations that have no turn left end at the root. An empty table gives no rows.
    Columns other than conv_id, turn, role and text are not read.
    """
    turns = turn_sequences(conversations)
    turns = with_shared_heads(turns) if rebuild else turns
    return prefix_trie(stored(turns.select("conv_id", F.col("said.digest").alias("turns"), F.col("said.weight").alias("weights"))), **more)


def trie_sql() -> str:
    """The trie of rebuilt conversations as DuckDB SQL: a node is the list of its turns' digests."""
    step = "xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END)"
    return f"""
WITH RECURSIVE crc(i, c, k) AS (SELECT i, CAST(i AS BIGINT), 0 FROM range(256) t(i) UNION ALL SELECT i, {step}, k + 1 FROM crc WHERE k < 8),
tab AS (SELECT list(c ORDER BY i) AS t FROM crc WHERE k = 8),
d AS (SELECT conv_id, turn, substr(sha256(CAST(octet_length(encode(coalesce(role, ''))) AS VARCHAR) || ':' || coalesce(role, '') || coalesce(text, '')), 1, 32) AS g, length(coalesce(text, '')) AS n FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT conv_id, list({{'g': g, 'n': n}} ORDER BY turn NULLS FIRST, g, n) AS said FROM d GROUP BY conv_id),
h AS (SELECT o.*, xor(list_reduce(list_transform(regexp_extract_all(hex(encode(CAST(conv_id AS VARCHAR))), '..'), lambda x: CAST(('0x' || x) AS BIGINT)),
 lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295), 4294967295) % 6 AS h FROM o, tab),
r AS (SELECT h.conv_id, list_concat(coalesce(b.said[1:h.h], []), h.said[h.h + 1:]) AS said FROM h LEFT JOIN o b ON b.conv_id = h.conv_id - h.conv_id % 100),
p AS (SELECT conv_id, d, list_transform(said[1:d], lambda x: x.g) AS path, CASE WHEN d = 0 THEN 0 ELSE said[d].n END AS n, d = len(said) AS ends FROM (SELECT conv_id, said, unnest(range(len(said) + 1)) AS d FROM r)),
node AS (SELECT path, d AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * min(n) AS own, sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256 FROM p GROUP BY path, d),
up AS (SELECT c.path, p.conv_id AS parent_conv_id FROM node c JOIN node p ON c.depth > 0 AND p.path = c.path[1:c.depth - 1]),
kids AS (SELECT path[1:depth - 1] AS path, count(*) AS n_children FROM node WHERE depth > 0 GROUP BY 1),
sub AS (SELECT path[1:a] AS path, sum(own) AS saved, sum(leaf) AS leaves FROM (SELECT n.path, own, CASE WHEN k.path IS NULL THEN 1 ELSE 0 END AS leaf, unnest(range(depth + 1)) AS a FROM node n LEFT JOIN kids k USING (path)) GROUP BY 1)
SELECT conv_id, CAST(depth AS BIGINT) AS depth, parent_conv_id, n_convs, CAST(coalesce(n_children, 0) AS BIGINT) AS n_children, CAST(leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, ends_sha256
FROM node LEFT JOIN up USING (path) LEFT JOIN kids USING (path) JOIN sub USING (path)"""
