import random
import re

import numpy as np
import xxhash

from sensorloom.llm.simhash import bit_sliced_pairs, blocks_for, links, near_duplicates


def brute_fp(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    ws = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not ws:
        return 0
    sh = [" ".join(ws[i : i + 4]) for i in range(max(1, len(ws) - 3))]
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_roots(fps, ids, radius=4):
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= radius:
                root[find(i)] = find(j)
    low = {}
    for i in range(len(fps)):
        low[find(i)] = min(low.get(find(i), ids[i]), ids[i])
    return [low[find(i)] for i in range(len(fps))]


def test_documents_against_brute_force(docs_of):
    rng = random.Random(2)
    vocab = ["w%d" % i for i in range(500)]
    rows = [(0, None), (1, ""), (2, " \n"), (3, "one"), (4, "ONE"), (5, "a b\xa0c")]
    for i in range(10, 60):
        base = [rng.choice(vocab) for _ in range(rng.choice([3, 5, 200, 900]))]
        rows.append((i * 10, " ".join(base)))
        for k in range(1, rng.randint(1, 5)):
            base[rng.randrange(len(base))] = "x%d" % k
            rows.append((i * 10 + k, "\t".join(base)))
    rows.append(rows[-1])
    got = sorted((r.doc_id, r.fingerprint, r.component_id) for r in near_duplicates(docs_of(rows)).collect())
    fps = [brute_fp(t) for _, t in rows]
    want = sorted((i, "%016x" % f, c) for (i, _), f, c in zip(rows, fps, brute_roots(fps, [i for i, _ in rows])))
    assert got == want
    assert len({c for _, _, c in got}) < len(rows) - 20
    assert near_duplicates(docs_of([])).count() == 0


def test_links_of_dense_balls(spark):
    """Chunked keys lose no link: balls of near fingerprints around a few centres, many of them chained."""
    rng = random.Random(4)
    fps = set()
    for _ in range(6):
        c = rng.getrandbits(64)
        for _ in range(60):
            f = c
            for b in rng.sample(range(64), rng.randint(0, 4)):
                f ^= 1 << b
            fps.add(f)
    fps = sorted(fps)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    edges = links(spark.createDataFrame([(s,) for s in signed], "fp long"), chunk=16).collect()
    got = {s: s for s in signed}

    def find(x):
        while got[x] != x:
            x = got[x]
        return x

    for e in edges:
        a, b = find(e.src), find(e.dst)
        got[max(a, b)] = min(a, b)
    want = brute_roots(fps, signed)
    assert [find(s) for s in signed] == want


def test_one_block():
    fps = np.array([1, 3, 255], dtype=np.uint64)
    right = np.resize(fps, 64)
    i, j = bit_sliced_pairs(fps, right, np.arange(3), np.zeros(3, dtype=np.int64), 1)
    assert {(a, int(right[b])) for a, b in zip(i.tolist(), j.tolist())} == {(0, 1), (0, 3), (1, 1), (1, 3), (2, 255)}


def test_bit_sliced_counts():
    rng = np.random.default_rng(1)
    left = rng.integers(0, 2**63, 40, dtype=np.uint64)
    right = np.resize(left, 128).copy()
    for n in range(128):
        for b in rng.choice(64, n % 8, replace=False):
            right[n] ^= np.uint64(1) << np.uint64(b)
    lists, words = np.repeat(np.arange(40), 2), np.tile(np.arange(2), 40)
    for radius in (0, 1, 3, 4, 7):
        i, j = bit_sliced_pairs(left, right, lists, words, radius)
        want = {(a, b) for a in range(40) for b in range(128) if bin(int(left[a]) ^ int(right[b])).count("1") <= radius}
        assert set(zip(i.tolist(), j.tolist())) == want


def test_blocks_follow_the_number_of_fingerprints(spark):
    assert [blocks_for(n, 4, 512) for n in (0, 10**6, 10**9, 10**11, 10**13)] == [6, 6, 7, 8, 10]
    rng = random.Random(4)
    base = [rng.getrandbits(64) for _ in range(60)]
    fps = sorted({b ^ sum(1 << k for k in rng.sample(range(64), n)) for b in base for n in (0, 2, 4, 9)})
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    df = spark.createDataFrame([(signed(f),) for f in fps], "fp long")
    from sensorloom.llm.common import components

    roots = [{r.node: r.root for r in components(links(df, 4, blocks)).collect()} for blocks in (None, 7, 8)]
    assert roots[0] == roots[1] == roots[2] and len(roots[0]) >= 120


def test_a_very_long_text(docs_of):
    long = " ".join(f"w{k * k % 997}" for k in range(200_000))
    got = {r.doc_id: r for r in near_duplicates(docs_of([(1, long), (2, long.upper()), (3, "short"), (3, "short")])).collect()}
    assert got[1].fingerprint == got[2].fingerprint == "%016x" % brute_fp(long) and got[2].component_id == 1 and got[3].component_id == 3
