import hashlib
import random

import pytest

from sensorloom.llm import passages
from sensorloom.llm.passages import remove_passages


def brute(rows, length):
    seen, out = {}, []
    texts = {i: (t or "").encode() for i, t in rows}
    for i in sorted(texts):
        b = texts[i]
        gone = bytearray(len(b))
        for s in range(len(b) - length + 1):
            w = b[s : s + length]
            if w in seen:
                gone[s : s + length] = b"\x01" * length
            else:
                seen[w] = i
        runs = sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1]))
        kept = bytes(c for c, g in zip(b, gone) if not g)
        out.append((i, len(b), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return out


def corpus():
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdeéfghi") for _ in range(rng.randint(1, 7)))
    passage = [" ".join(word() for _ in range(60)) for _ in range(3)]
    rows = [(1, None), (2, ""), (3, "short"), (4, "a" * 99), (5, "a" * 350), (6, "b" + "a" * 120), (7, "xyz" * 80), (8, "abcabc" * 70)]
    for i in range(10, 50):
        t = " ".join(word() for _ in range(rng.randint(5, 120)))
        for p in passage:
            if rng.random() < 0.4:
                k = rng.randrange(len(t) + 1)
                a = rng.randrange(120)
                t = t[:k] + p[a : a + rng.randint(80, 300)] + t[k:]
        rows.append((i, t))
    rows += [(60, rows[20][1]), (61, rows[20][1]), (62, rows[20][1][5:] + "!"), (63, rows[21][1] * 3)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("piece,bits", [(1 << 20, 27), (512, 8)])
def test_against_brute_force(docs_of, monkeypatch, piece, bits):
    """Whole corpus in one piece with roomy bitmaps; and in small overlapping pieces with crowded bitmaps."""
    rows = corpus()
    monkeypatch.setattr(passages, "PIECE", piece)
    got = sorted(tuple(r) for r in remove_passages(docs_of(rows).repartition(3), bits=bits).collect())
    assert got == sorted(brute(rows, 100))


def test_repeated_rows_null_ids_and_empty(docs_of):
    t = "".join(random.Random(1).choices("abcdefgh", k=160))
    got = sorted(((r.doc_id or 10**9), r.n_removed, bytes(r.kept)) for r in remove_passages(docs_of([(1, t), (1, t), (None, t)]), keep_text=True).collect())
    assert got == [(1, 0, t.encode())] * 2 + [(10**9, 160, b"")]
    assert remove_passages(docs_of([])).count() == 0


def test_rows_that_share_an_id(docs_of):
    """Marks of one text do not reach another of the same id, or of no id."""
    rng = random.Random(4)
    x, y = ("".join(rng.choices("abcdefghijklmnop", k=n)) for n in (120, 240))
    for i in (None, 7):
        got = {bytes(r.kept): r.n_removed for r in remove_passages(docs_of([(i, x + x), (i, y), (8 if i else i, "z")]), keep_text=True).collect()}
        assert got == {x.encode(): 120, y.encode(): 0, b"z": 0}
