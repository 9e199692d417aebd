import hashlib
import random
import zlib

import pytest

from sensorloom.llm.prefix_trie import LoserTree, conversation_trie, merge_ranges, prefix_trie, sorted_run, turn_sequences
from sensorloom.llm.prefix_trie import NODES, PARTIAL

SCHEMA = "conv_id long, turn int, role string, text string, depth string, n_convs int, head string, base int"


def trie(paths):
    """Nodes of (id, tuple of (turn, code points)) by plain dictionaries."""
    nodes: dict = {}
    for i, path in paths:
        for d in range(len(path) + 1):
            x = nodes.setdefault(tuple(t for t, _ in path[:d]), {"ids": [], "ends": [], "w": path[d - 1][1] if d else 0})
            x["ids"].append(i)
            if d == len(path):
                x["ends"].append(i)
    out = []
    for p, x in nodes.items():
        below = [q for q in nodes if q[: len(p)] == p]
        kids = [q for q in below if len(q) == len(p) + 1]
        leaves = [q for q in below if not any(r[: len(q)] == q and len(r) == len(q) + 1 for r in below)]
        saved = sum((len(nodes[q]["ids"]) - 1) * nodes[q]["w"] for q in below)
        sha = hashlib.sha256(",".join(map(str, sorted(x["ends"]))).encode()).hexdigest()
        out.append((min(x["ids"]), len(p), min(nodes[p[:-1]]["ids"]) if p else None, len(x["ids"]), len(kids), len(leaves), saved, sha))
    return sorted(out, key=str)


def brute(rows, rebuild):
    said: dict = {}
    for c, turn, role, text in rows:
        if c is not None:
            said.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    said = {c: [(r, t) for _, _, r, t in sorted(v, key=lambda x: x[:2])] for c, v in said.items()}
    paths = []
    for c, own in said.items():
        h = zlib.crc32(str(c).encode()) % 6 if rebuild else 0
        base = said.get(c - c % 100 if c >= 0 else c + (-c) % 100, [])
        paths.append((c, [((r, t), len(t)) for r, t in (base[:h] + own[h:] if rebuild else own)]))
    return trie(paths)


def run(spark, rows, **more):
    df = spark.createDataFrame([(*r, "x", 1, "h", 2) for r in rows], SCHEMA)
    out = conversation_trie(df, **more)
    assert out.columns == NODES
    return sorted(map(tuple, out.collect()), key=str)


def some(seed, convs, longest, words):
    rng = random.Random(seed)
    rows = [(c, t, rng.choice(["user", "assistant", None]), rng.choice(words)) for c in convs for t in range(rng.randrange(1, longest))]
    rng.shuffle(rows)
    return rows


def test_against_brute_force(spark):
    rows = some(1, range(0, 260), 9, ["a", "bb", "", None, "𝄞é"]) + [(260 + n, t, "user", "hot") for n in range(150) for t in range(3)]
    rows += [(None, 0, "user", "a"), (-7, 0, "user", "a"), (-107, None, "user", "b"), (-107, 3, "user", "a"), (900, None, None, None)]
    assert run(spark, rows, rebuild=True) == brute(rows, True)
    assert run(spark, rows) == brute(rows, False)
    # Many small ranges split hot heads and deep paths; the nodes stay the same.
    assert run(spark, rows, rebuild=True, range_turns=20, head=2) == brute(rows, True)


def test_deep_paths_cross_ranges(spark):
    rows = some(2, range(40), 60, ["a"]) + some(3, range(40, 60), 50, ["a", "a", "a", "b"])
    assert run(spark, rows, range_turns=100, head=3) == brute(rows, False)


def test_ties_repeats_and_empty(spark):
    rows = [(1, 0, "user", "a"), (1, 0, "user", "a"), (1, 5, "x", "y"), (2, 0, "user", "a")]
    assert run(spark, rows) == brute(rows, False)
    twisted = [(3, 0, "r", "b"), (3, 0, "r", "a"), (4, 0, "r", "a"), (4, 0, "r", "b")]
    assert max(r[3] for r in run(spark, twisted) if r[1] == 2) == 2  # turns of one number have one order
    assert run(spark, []) == [] and run(spark, [], rebuild=True) == []
    long_text = [(5, 0, "u", "é" * 300000), (6, 0, "u", "é" * 300000)]
    assert run(spark, long_text) == brute(long_text, False)


def test_turnless_conversations_end_at_the_root(spark):
    c = next(c for c in range(101, 200) if zlib.crc32(str(c).encode()) % 6 > 0)
    assert run(spark, [(c, 0, "user", "own")], rebuild=True) == brute([(c, 0, "user", "own")], True)


@pytest.mark.parametrize("seed", range(20))
def test_loser_tree_lcps(seed):
    rng = random.Random(seed)
    items = [([rng.choice([b"a", b"b"]) for _ in range(rng.randrange(12))], i, []) for i in range(rng.randrange(1, 200))]
    runs = [sorted_run(part) for k in range(7) if (part := items[k::7])]
    merged, before = [], []
    tree = LoserTree(runs + [[]])
    for seq, i, _, lcp in tree:
        n = 0
        while n < min(len(seq), len(before)) and seq[n] == before[n]:
            n += 1
        assert lcp == n
        merged.append((seq, i))
        before = seq
    assert merged == sorted((s, i) for s, i, _ in items)


def test_shared_turns_are_not_compared_again():
    """Comparisons that start at the LCP: long shared paths cost their length once, not once for each match."""
    deep = [b"t"] * 500
    runs = [sorted_run([(deep + [bytes([65 + r])], 8 * r + j, []) for j in range(50)]) for r in range(8)]
    tree = LoserTree(runs)
    assert sum(1 for _ in tree) == 400 and tree.compared < 8 * 501 + 400 * 8


def test_hot_heads_spread_over_ranges(spark):
    df = turn_sequences(spark.createDataFrame([(c, t, "u", "same", "x", 1, "h", 2) for c in range(600) for t in range(2)], SCHEMA))
    seqs = df.selectExpr("conv_id", "said.digest AS turns", "said.weight AS weights")
    partial = merge_ranges(seqs, 6).where(f"kind = {PARTIAL} AND depth = 2").collect()
    assert len(partial) >= 4 and max(r["n_convs"] for r in partial) <= 300 and sum(r["n_convs"] for r in partial) == 600
    assert prefix_trie(seqs).count() == 3
