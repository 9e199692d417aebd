import math
import random
import re

import numpy as np

from sensorloom.llm.lexical import BestOfItems, length_share, radix_order, search_documents, sums_by_key

WORD = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(docs, items, k):
    texts = [(i, WORD.findall((t or "").translate(LOWER))) for i, t in docs]
    texts = [x for x in texts if x[1]]
    n_docs, total = len(texts), sum(len(w) for _, w in texts)
    wanted: dict = {}
    for i, t in items:
        wanted.setdefault(i, set()).update(WORD.findall((t or "").translate(LOWER)))
    out = []
    for item, terms in wanted.items():
        scored = []
        for i, w in texts:
            m = 50 + (50 * len(w) * n_docs) // total
            s = 0
            for t in terms & set(w):
                df = sum(t in x for _, x in texts)
                s += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1))) * ((1000000000 * w.count(t)) // (1000 * w.count(t) + 20 * m))
            if s > 0:
                scored.append((-s, i is None, i or 0))
        out += [(item, r + 1, None if none else d, -s) for r, (s, none, d) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=str)


def run(spark, docs_of, docs, items, **more):
    given = spark.createDataFrame([(i, t, 1, "x") for i, t in items], "item_id long, text string, rank int, score string")
    return sorted(map(tuple, search_documents(docs_of(docs), given, **more).collect()), key=str)


def test_against_brute_force(spark, docs_of):
    rng = random.Random(3)
    vocab = [f"w{n}" for n in range(60)] + ["Ä", "é1", "B", "b"]
    text = lambda n: "".join(rng.choice(vocab) + rng.choice([" ", ". ", "\n", "_", "\x00"]) for _ in range(n))
    docs = [(i, text(rng.randrange(1, 40))) for i in range(300)]
    docs += [(1000 + i, docs[7][1]) for i in range(150)] + [docs[7]] * 3  # ties and repeated rows
    docs += [(2000, None), (2001, ""), (2002, "?! ..."), (None, text(9)), (None, docs[7][1]), (2003, text(60000))]
    items = [(i, text(rng.randrange(1, 12))) for i in range(12)] + [(20, None), (21, "nowhere at all"), (22, ""), (3, "w1 w2"), (23, docs[7][1])]
    want = brute(docs, items, 50)
    assert run(spark, docs_of, docs, items) == want
    assert run(spark, docs_of, docs, items, block_triples=100, block_terms=7) == want
    assert run(spark, docs_of, docs, items, k=3) == brute(docs, items, 3)


def test_empty_tables(spark, docs_of):
    assert run(spark, docs_of, [], [(1, "a")]) == []
    assert run(spark, docs_of, [(1, "a b")], []) == []


def test_radix_sums_and_heaps():
    rng = np.random.default_rng(1)
    keys = rng.integers(0, 1 << 50, 5000)
    keys[::3] = keys[0]
    assert (keys[radix_order(keys)] == np.sort(keys)).all() and len(radix_order(np.zeros(0, np.int64))) == 0
    values = rng.integers(0, 100, 5000)
    k, s = sums_by_key(keys, values)
    assert dict(zip(k.tolist(), s.tolist())) == {x: int(values[keys == x].sum()) for x in set(keys.tolist())}
    best = BestOfItems(2)
    best.add(np.array([4, 4, 4]), np.array([5, 5, 5]), [9, None, 3])
    best.add(np.array([4]), np.array([5]), [2])
    assert list(best.rows()) == [(4, 2, 5), (4, 3, 5)]


def test_lengths_beyond_64_bits():
    n, docs, total = np.array([10**9]), 10**12, 10**15
    assert length_share(n, docs, total, 50).tolist() == [50 + (50 * 10**9 * docs) // total]
