import random
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from sensorloom.llm.packing import differencing, pack, windows_of


def test_round_trip(docs_of):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice(["alpha", "beta", "Ünïcode", "42", "zz"]) for _ in range(rng.choice([0, 1, 7, 300, 5000])))) for i in range(40)]
    rows += [(100, None), (101, ""), (102, "a <|endoftext|> b"), (7, rows[7][1])]
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {i: [*tok.encode(t or "", add_special_tokens=False).ids, 1] for i, t in rows}
    got = pack(docs_of(rows), group_pieces=50).collect()
    seqs, pieces = {}, {}
    for r in got:
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
        pieces.setdefault(r.doc_id, []).append(r)
        want = np.array(ids[r.doc_id][r.start : r.start + r.length], dtype="<u4")
        assert zlib.crc32(want) == r.ids_crc32 and r.doc_tokens == len(ids[r.doc_id])
    for i, want in ids.items():
        starts = sorted((r.start, r.length) for r in pieces[i])
        copies = sum(1 for j, _ in rows if j == i)
        assert sum(n for _, n in starts) == copies * len(want)
    for placed in seqs.values():
        at = 0
        for o, n in sorted(placed):
            assert o == at
            at += n
        assert at <= 2048
    assert sum(r.length for r in got) / (2048 * len(seqs)) > 0.9


def test_differencing_balances():
    rng = random.Random(5)
    for n, k in ((0, 3), (1, 4), (9, 3), (200, 40)):
        sizes = [rng.randint(1, 256) for _ in range(n)]
        parts = differencing(sizes, k)
        assert sorted(x for p in parts for x in p) == list(range(n)) and len(parts) == k
        sums = [sum(sizes[x] for x in p) for p in parts]
        if n == 200:
            assert max(sums) - min(sums) < 40
    assert all(sum([100, 90, 80][x] for x in p) <= 100 for p in windows_of([100, 90, 80], 100))


def test_empty_table(docs_of):
    assert pack(docs_of([])).count() == 0


def test_ids_over_a_whole_table(spark):
    """Every piece of the documents of sf0.01 holds the ids that the tokenizers file gives."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = docs.select("doc_id", "text").collect()
    ids = {r.doc_id: np.array([*e.ids, 1], dtype="<u4") for r, e in zip(rows, tok.encode_batch([r.text or "" for r in rows], add_special_tokens=False))}
    got = pack(docs).collect()
    assert all(zlib.crc32(ids[r.doc_id][r.start : r.start + r.length]) == r.ids_crc32 and r.doc_tokens == len(ids[r.doc_id]) for r in got)
    assert sum(r.length for r in got) == sum(map(len, ids.values()))


def test_differencing_against_all_partitions():
    """On small inputs the largest part is at most a sixth above that of the best of all partitions, and never above largest-first dealing by more."""
    import itertools

    rng = random.Random(2)
    for _ in range(60):
        n, k = rng.randint(3, 7), rng.randint(2, 3)
        sizes = [rng.randint(1, 60) for _ in range(n)]
        best = min(max(sum(s for s, p in zip(sizes, choice) if p == q) for q in range(k)) for choice in itertools.product(range(k), repeat=n))
        parts = differencing(sizes, k)
        assert sorted(x for p in parts for x in p) == list(range(n))
        assert max(sum(sizes[x] for x in p) for p in parts) <= best * 7 / 6
