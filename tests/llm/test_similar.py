import random

import xxhash

from corpus_pipeline import near_dedup


def shingles(text):
    w = (text or "").lower().split()
    return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def fingerprint(text):
    w = (text or "").lower().split()
    hs = [xxhash.xxh64_intdigest(" ".join(w[i : i + 5]), 42) for i in range(max(1, len(w) - 4))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def kept_ids(rows):
    """The smallest id of every component of pairs with Jaccard >= 0.8 or fingerprints within 4 bits."""
    sets, root = [shingles(t) for _, t in rows], list(range(len(rows)))
    fps = [fingerprint(t) for _, t in rows]

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a == b or 5 * len(a & b) >= 4 * len(a | b) or (fps[i] ^ fps[j]).bit_count() <= 4:
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return sorted({min(r[0] for k, r in enumerate(rows) if find(k) == find(i)) for i in range(len(rows))})


def test_stage_against_brute_force(spark, docs_of):
    """Edited copies around similarity 0.8, chains of them, boilerplate that many texts share, short texts."""
    rng = random.Random(3)
    vocab = ["w%d" % i for i in range(3000)]
    common = [[rng.choice(vocab) for _ in range(60)] for _ in range(3)]
    rows = [(0, None), (1, ""), (2, " \n"), (3, "one"), (4, "ONE"), (5, "two words"), (6, "a b c d e f"), (7, "a b c d e g")]
    for i in range(60):
        base = [rng.choice(vocab) for _ in range(rng.choice([8, 40, 150, 400]))] + rng.choice(common)
        rows.append((100 * i + 100, " ".join(base)))
        for k in range(1, rng.randint(1, 6)):
            for _ in range(rng.randint(1, max(1, len(base) // 40))):
                base[rng.randrange(len(base))] = "x%d" % rng.randrange(10**6)
            rows.append((100 * i + 100 + k, "\t".join(base)))
    rng.shuffle(rows)
    rows.append(rows[-1])
    want = kept_ids(rows)
    assert len(want) < len(rows) - 60
    assert sorted(r.doc_id for r in near_dedup(spark, docs_of(rows), "").collect()) == want
    assert near_dedup(spark, docs_of([]), "").count() == 0


def test_texts_in_small_slices():
    """Large batches are worked on in slices of bounded size, no row lost, and a large text is a slice of its own."""
    import pyarrow as pa

    from sensorloom.llm.common import smaller

    texts = [b"x" * 2000] * 5000 + [b"y" * 3_000_000] + [b""] * 10
    parts = list(smaller([pa.record_batch([pa.array(range(len(texts))), pa.array(texts)], names=["i", "t"]), pa.record_batch([pa.array([], pa.int64()), pa.array([], pa.binary())], names=["i", "t"])]))
    assert [i for p in parts for i in p.column(0).to_pylist()] == list(range(len(texts)))
    assert max(p.num_rows for p in parts) <= 1024 and all(p.nbytes < 4_500_000 for p in parts) and len(parts) >= 10


def variants(rng, texts, words=60):
    """Texts of one frame whose every fourth word is one of two: all shingles are held by many texts, and few pairs are similar."""
    frame = [("w%d" % i, "v%d" % i) for i in range(words)]
    return [(i + 1, " ".join(w[rng.random() < 0.5 if k % 4 == 0 else 0] for k, w in enumerate(frame))) for i in range(texts)]


def test_pairs_of_large_groups_are_not_rows(spark, docs_of, monkeypatch):
    """Texts that share their rarest shingles with many dissimilar ones: only pairs that sketches let through are written, and the result is that of brute force."""
    from sensorloom.llm import similar

    rng = random.Random(5)
    rows = variants(rng, 400)
    rows += [(1000 + i, t.replace("w7 ", "x%d " % i, 1)) for i, t in rows[:40]]
    seen = []
    whole = similar.cut

    def counted(df):
        out = whole(df)
        seen.extend([out.count()] if out.columns == ["grp", "a", "b"] else [])
        return out

    monkeypatch.setattr(similar, "cut", counted)
    assert sorted(r.doc_id for r in near_dedup(spark, docs_of(rows), "").collect()) == kept_ids(rows)
    assert len(seen) >= 3 and max(seen) < 4 * len(rows)


def test_groups_of_small_chunks(spark):
    """Every pair of a shingle's holders is looked at, whatever their chunks and the widths of their sketches; roots are told apart."""
    import numpy as np

    from sensorloom.llm.similar import SKETCH, near_in_groups

    rng = np.random.default_rng(6)
    sets, rows, bodies = {}, [], []
    for node in range(60):
        base = sets.get(node - 1, np.zeros(0, np.uint64))[: rng.integers(200, 900)] if node % 4 else np.zeros(0, np.uint64)
        sets[node] = np.unique(np.concatenate([base, rng.integers(0, 2**63, rng.integers(1, 100) if node % 4 else 700, dtype=np.uint64)]))
        width = 1 << max(SKETCH, (2 * len(sets[node])).bit_length())
        odd = np.bincount((sets[node] & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1
        bodies.append((node, bytearray(np.packbits(odd.astype(np.uint8), bitorder="little").tobytes() + len(sets[node]).to_bytes(8, "little"))))
        rows += [(s, node, node % 7, 60) for s in (1, 2)]
    assert len({len(b) for _, b in bodies}) > 1
    large = spark.createDataFrame(rows, "s long, node long, root long, c long")
    got = {(r.a, r.b) for r in near_in_groups(large, spark.createDataFrame(bodies, "node long, sketch binary"), 4, 5, 8).collect()}
    near = {(a, b) for a in range(60) for b in range(a) if a % 7 != b % 7 and len(np.intersect1d(sets[a], sets[b])) * 9 >= (len(sets[a]) + len(sets[b])) * 4}
    assert len(near) > 10 and near <= got and len(got) < 3 * len(near)
    assert all(a > b and a % 7 != b % 7 for a, b in got)


def test_what_is_left_on_disk(spark, docs_of, tmp_path, monkeypatch):
    """Prefixes, sketches and texts go before the stages end; the session's setting for shuffle files is as it was."""
    from corpus_pipeline import personal_data
    from sensorloom.llm import common

    monkeypatch.setattr(common, "checkpoint_dir", lambda _: str(tmp_path))
    before = spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled")
    rows = [(i, t + " mail ann%d@site.org" % i) for i, t in variants(random.Random(7), 30)]
    for stage in (near_dedup, personal_data):
        assert stage(spark, docs_of(rows), "").count() <= 30
    left = [set(spark.read.parquet(str(p)).columns) for p in tmp_path.glob("sensorloom-*")]
    assert left and not any(c & {"prefix", "sketch", "t", "s", "free"} for c in left)
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == before


def test_links_grow_with_texts_not_with_pairs(spark, docs_of, monkeypatch):
    """Copies of two or five edits, where any two of two edits are similar and no others are: few edges connect them all."""
    from sensorloom.llm import similar

    rng, frame = random.Random(11), ["f%d" % i for i in range(200)]
    rows = []
    for i in range(240):
        words = list(frame)
        for k in rng.sample(range(8, 192, 8), 2 + 3 * (i % 2)):
            words[k] = "e%d_%d" % (i, k)
        rows.append((i + 1, " ".join(words)))
    sets, root = [shingles(t) for _, t in rows], list(range(len(rows)))
    pairs = [(i, j) for i in range(len(rows)) for j in range(i) if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]
    for i, j in pairs:
        low, high = sorted((root[i], root[j]))
        root = [low if r == high else r for r in root]
    assert len(pairs) > 25 * len(rows) and len(set(root)) > 1
    seen, whole = [], similar.components

    def counted(edges):
        seen.append(edges.count())
        return whole(edges)

    monkeypatch.setattr(similar, "components", counted)
    kept = similar.keep_dissimilar(docs_of(rows), similarity=0.8, shingle=5, radius=-1)
    assert sorted(r.doc_id for r in kept.collect()) == sorted({r + 1 for r in root})
    assert seen and max(seen) <= 3 * len(rows)


def connected(pairs):
    """What the pairs connect: a set of sets."""
    groups = []
    for a, b in pairs:
        meet = [g for g in groups if a in g or b in g]
        groups = [g for g in groups if g not in meet] + [set().union({a, b}, *meet)]
    return {frozenset(g) for g in groups}


def test_forest_and_families_of_small_chunks(spark):
    """A forest connects what all pairs connect, with fewer rows than nodes in a task; families' links connect what brute force connects, whatever the chunks."""
    import numpy as np

    from sensorloom.llm.similar import family_links, near_forest, near_in_groups, parity_sketch, shingle_hashes

    rng = random.Random(12)
    texts = {}
    for i in range(48):
        words = texts[i - 1].split() if i % 6 else ["b%d_%d" % (i, k) for k in range(rng.choice([60, 300]))]
        for _ in range(rng.randint(0, len(words) // 30)):
            words[rng.randrange(len(words))] = "y%d" % rng.randrange(10**6)
        texts[i] = " ".join(words)
    sets = {i: np.unique(shingle_hashes(t.encode(), 5, 42)) for i, t in texts.items()}
    root = {i: i // 2 if i % 6 < 2 else 100 + i for i in texts}
    large = spark.createDataFrame([(s, i, root[i], 48) for s in (1, 2, 3) for i in texts], "s long, node long, root long, c long").repartition(1)
    sketches = spark.createDataFrame([(i, bytearray(parity_sketch(x))) for i, x in sets.items()], "node long, sketch binary")
    true = [(a, b) for a in texts for b in range(a) if root[a] != root[b] and len(np.intersect1d(sets[a], sets[b])) * 9 >= (len(sets[a]) + len(sets[b])) * 4]
    assert len(true) > 30
    for most in (1 << 20, 1):
        forest = [(r.a, r.b) for r in near_forest(large, sketches, 4, 5, 8, most).collect()]
        assert connected(forest) == connected([tuple(r) for r in near_in_groups(large, sketches, 4, 5, 8).collect()])
        assert most == 1 or len(forest) < 4 * len(texts)
    same = [(a, b) for a in texts for b in range(a) if root[a] == root[b]]
    members = spark.createDataFrame([(7, i, root[i], bytearray(t.encode())) for i, t in texts.items()], "fam long, node long, root long, body binary")
    for chunk, size in ((1024, 8 << 20), (5, 8 << 20), (1024, 4000)):
        links = [(r.src, r.dst) for r in family_links(members, 4, 5, 5, 42, chunk, size).collect()]
        assert connected(links + same) == connected(true + same)
