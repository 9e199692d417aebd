import random

import numpy as np
import pytest

from sensorloom.llm.hashing import gram_features, text_chunks, word_hashes
from sensorloom.llm.toxicity import ToxicModel, held_out, score_toxicity, train_toxicity

BAD = ["zorgle", "blick", "frump"]


def data(n=900):
    rng = random.Random(5)
    rows, labels = [], []
    for i in range(n):
        words = ["w%d" % int(rng.expovariate(0.05)) for _ in range(rng.randint(1, 120))]
        toxic = int(rng.random() < 0.15)
        if toxic:
            words.insert(rng.randrange(len(words) + 1), rng.choice(BAD))
        rows.append((i, " ".join(words)))
        labels.append((i, 1, toxic))
    return rows, labels


def test_held_out_accuracy(spark, docs_of):
    rows, labels = data()
    lab = spark.createDataFrame(labels + [(None, 1, 1), (3, 1, None)], "doc_id long, quality int, toxic int")
    model = train_toxicity(docs_of(rows), lab.where(~held_out("doc_id", 4, 2)))
    assert 0 < len(model.features) < 500
    more = [(5000, None), (5001, ""), (5002, "zorgle"), (5003, "w1 " * 60000 + "blick"), (5002, "zorgle")]
    got = score_toxicity(docs_of(rows + more), model).withColumn("held", held_out("doc_id", 4, 2)).collect()
    assert len(got) == len(rows) + len(more)
    truth = {i: t for i, _, t in labels}
    held = [(r.predicted, truth[r.doc_id]) for r in got if r.held and r.doc_id in truth]
    assert len(held) > 150 and np.mean([a == b for a, b in held]) > 0.97
    by = {r.doc_id: r.score for r in got}
    assert by[5000] == by[5001] < 0.3 < by[5002]


def test_no_labels_and_empty(spark, docs_of):
    lab = spark.createDataFrame([], "doc_id long, toxic int")
    model = train_toxicity(docs_of([(1, "a")]), lab)
    assert model == ToxicModel(20, (), (), None)
    assert [(r.score, r.predicted) for r in score_toxicity(docs_of([(1, "a"), (None, None)]), model).collect()] == [(0.0, 0)] * 2
    assert score_toxicity(docs_of([]), model).count() == 0


@pytest.mark.parametrize("texts", [[b""], [b"A b", b"", b"b a B", b"\xc3\xa9t\xc3\xa9!x"]])
def test_hashes(texts):
    h, o = word_hashes(texts)
    import re

    words = [(re.sub(rb"[A-Z]", lambda m: m[0].lower(), w), k) for k, t in enumerate(texts) for w in re.findall(rb"[0-9A-Za-z\x80-\xff]+", t)]
    assert o.tolist() == [k for _, k in words]
    assert len({(int(a), w) for a, (w, _) in zip(h, words)}) == len({w for w, _ in words}) == len(set(h.tolist()))
    f, fo = gram_features(h, o, 20)
    pairs = sum(max(0, n - 1) + max(0, n - 2) + n for n in np.bincount(o, minlength=len(texts)))
    assert len(f) == len(fo) == pairs
    assert [r for r in text_chunks([b"x" * 5] * 4, 12)] == [(0, 2), (2, 4)]


def plain_features(text, bits):
    """Distinct features of a text by whole-number arithmetic, word by word."""
    import re

    mask = (1 << 64) - 1
    hashes = []
    for w in re.findall(rb"[0-9A-Za-z\x80-\xff]+", text or b""):
        h = sum((b + 32 if 65 <= b <= 90 else b) * pow(0x9E3779B97F4A7C15, k, 1 << 64) for k, b in enumerate(w)) & mask
        h = ((h ^ h >> 29) * 0xBF58476D1CE4E5B9) & mask
        hashes.append(h ^ h >> 32)
    out = {(h * 0xD6E8FEB86659FD93 & mask) >> (64 - bits) for h in hashes}
    for gap, salt in ((1, 0x1234567), (2, 0x89ABCDE)):
        for a, b in zip(hashes, hashes[gap:]):
            x = ((a * 0x9FB21C651E98DF25 + b) & mask) ^ salt
            out.add((((x ^ x >> 28) * 0x94D049BB133111EB) & mask) >> (64 - bits))
    return sorted(out)


def test_training_and_scores_against_plain_ftrl(spark, docs_of):
    """The whole operator against FTRL-proximal written with dictionaries, coordinate by coordinate."""
    from math import exp, log, sqrt

    rows, labels = data(160)
    rows += [(3, "another text of the same id"), (200, None), (201, "")]
    labels += [(200, 0, 0), (201, 0, 1)]
    bits, alpha, beta, l1, l2, epochs = 16, 1.0, 1.0, 0.5, 0.1, 3
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    docs = docs_of(rows)
    model = train_toxicity(docs, lab, bits=bits, alpha=alpha, beta=beta, l1=l1, l2=l2, epochs=epochs)
    hashes = {(r.doc_id, r.text): r.h for r in docs.selectExpr("doc_id", "text", "xxhash64(cast(coalesce(text, '') AS binary)) AS h").collect()}
    chosen = {}
    for i, t in rows:
        if i not in chosen or hashes[i, t] < hashes[i, chosen[i]]:
            chosen[i] = t
    truth = {i: y for i, _, y in labels}
    ids = sorted(truth)
    order = np.random.default_rng(0).permutation(len(ids))
    z, n, ones = {}, {}, sum(truth.values())
    bias, bias_n = log((ones + 0.5) / (len(ids) - ones + 0.5)), 0.0

    def weight(f):
        if abs(z.get(f, 0.0)) <= l1:
            return 0.0
        return -(z[f] - (l1 if z[f] > 0 else -l1)) / ((beta + sqrt(n[f])) / alpha + l2)

    for _ in range(epochs):
        for k in order:
            fs = plain_features((chosen[ids[k]] or "").encode(), bits)
            ws = [weight(f) for f in fs]
            g = 1 / (1 + exp(-(sum(ws) + bias))) - truth[ids[k]]
            for f, w in zip(fs, ws):
                sigma = (sqrt(n.get(f, 0.0) + g * g) - sqrt(n.get(f, 0.0))) / alpha
                z[f] = z.get(f, 0.0) + g - sigma * w
                n[f] = n.get(f, 0.0) + g * g
            bias_n += g * g
            bias -= alpha * g / (1 + bias_n**0.5)
    want = {f: weight(f) for f in z if weight(f)}
    assert want.keys() == set(model.features) and abs(bias - model.bias) < 1e-9
    assert all(abs(want[f] - w) < 1e-9 for f, w in zip(model.features, model.weights))
    for r in score_toxicity(docs, model).join(docs.select("doc_id", "text"), "doc_id").where("doc_id <> 3").collect():
        p = 1 / (1 + exp(-(bias + sum(want.get(f, 0.0) for f in plain_features((r.text or "").encode(), bits)))))
        assert abs(r.score - p) < 1e-9 and r.predicted == int(p >= 0.3)


def test_one_text_of_an_id_is_learned(spark, docs_of):
    """Four hundred rows of one id weigh as much as one."""
    rows, labels = data(200)
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    once, often = train_toxicity(docs_of(rows), lab), train_toxicity(docs_of(rows + [rows[0]] * 400), lab)
    assert once == often
