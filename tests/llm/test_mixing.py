import random

import numpy as np

from sensorloom.llm.mixing import fit_rates, mix, mixing_rates

WEIGHTS = {"quality=1,toxic=0": 0.8, "quality=0,toxic=0": 0.15, "quality=1,toxic=1": 0.05}


def data(spark, docs_of):
    rng = random.Random(3)
    rows, labels = [], []
    for i in range(400):
        q, t = int(rng.random() < 0.7), 0
        words = ["w%d" % rng.randrange(200) for _ in range(rng.randint(5, 60))]
        if q and rng.random() < 0.3:
            t, words[0] = 1, "zorgle"
        if not q:
            words = ["%%% " + w + " |" for w in words]
        rows.append((i, " ".join(words)))
        labels.append((i, q, t))
    rows += [(1000, None), (1001, ""), (5, rows[5][1])]
    labels += [(None, 1, 1), (7, None, 1)]
    return rows, {i: (q, t) for i, q, t in labels[:400]}, docs_of(rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_rates_meet_targets(spark, docs_of):
    rows, truth, docs, labels = data(spark, docs_of)
    got = mixing_rates(docs, labels, WEIGHTS).collect()
    assert len(got) == len(rows)
    assert all(0 <= r.rate <= 4 and abs(r.copies - r.rate) < 1 for r in got)
    right = [r.domain == "quality=%d,toxic=%d" % truth[r.doc_id] for r in got if r.doc_id < 400]
    assert np.mean(right) > 0.97
    mass = {}
    for r in got:
        mass[r.domain] = mass.get(r.domain, 0) + r.tokens * r.rate
    total = sum(mass.values())
    assert all(abs(mass[d] / total - w) < 0.05 for d, w in WEIGHTS.items()), (mass, total)
    assert [r.tokens for r in got if r.doc_id >= 1000] == [0, 0]


def optimum(p, t, shares, max_rate, total, weight):
    """Expected tokens at the least-squares optimum, by small fixed projected steps, many of them."""
    r, target = np.ones(len(t)), shares * total
    for _ in range(20000):
        r = np.clip(r - p @ (weight * ((t * r) @ p - target)), 0, max_rate)
    return (t * r) @ p


def test_against_numpy(spark):
    """Expected totals equal those of the optimum that a plain solver reaches, met targets and contradicting ones alike."""
    rng = np.random.default_rng(0)
    for alpha, wanted, max_rate in ((0.3, [0.5, 0.3, 0.2], 2.0), (1.0, [0.9, 0.1, 0.0], 1.0), (0.1, [0.0, 0.0, 1.0], 4.0)):
        p = rng.dirichlet([alpha] * 3, 200)
        t = rng.integers(1, 50, 200).astype(float)
        df = spark.createDataFrame([(a.tolist(), int(b)) for a, b in zip(p, t)], "posterior array<double>, tokens long")
        steps, reached = fit_rates(df, ("a", "b", "c"), dict(zip("abc", wanted)), max_rate=max_rate)
        e, share = t @ p, np.array(wanted)
        total = min(e.sum(), *(max_rate * x / s for x, s in zip(e, share) if s))
        r = np.ones(200)
        for v in steps:
            r = np.clip(r - p @ np.array(v), 0, max_rate)
        got = np.array([reached[d][0] for d in "abc"])
        assert np.allclose(got, (t * r) @ p) and np.allclose([reached[d][1] for d in "abc"], share * total)
        best = optimum(p, t, share, max_rate, total, 1 / e)
        loss = lambda n: float(((n - share * total) ** 2 / e).sum())
        met = np.abs(got - share * total).max() <= 2e-4 * total
        assert met or np.abs(got - best).max() < 2e-3 * total and loss(got) - loss(best) <= 1e-3 * (loss(e) - loss(best)), (got, best, len(steps))


def test_targets_are_met_on_a_whole_table(spark):
    """Over the documents of sf0.1 every domain, that of target 0 included, comes within a thousandth of the total of its target."""
    from sensorloom.llm.mixing import TARGETS

    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{n}.parquet") for n in ("documents", "labels"))
    got = mixing_rates(docs, labels, TARGETS).select("domain", "reached", "target").distinct().collect()
    total = sum(r.target for r in got)
    assert {r.domain for r in got} == set(TARGETS) and total > 1e6
    assert all(abs(r.reached - r.target) <= 1e-3 * total for r in got)


def test_many_domains_and_clashing_names(spark):
    rows = [(i, f"word{i % 30} " * 5 + f"also{i % 30}", i % 30) for i in range(600)] + [(3, None, 0)]
    names = ["posterior", "tokens", "_tokens", "__k", "w"]
    docs = spark.createDataFrame([(i, t, *range(5)) for i, t, _ in rows], "doc_id long, text string, " + ", ".join(f"`{n}` int" for n in names))
    labels = spark.createDataFrame([(i, k) for i, _, k in rows[:600]], "doc_id long, kind int")
    weights = {f"kind={k}": 1.0 if k else 0.0 for k in range(30)}
    got = mixing_rates(docs, labels, weights, label_cols=("kind",)).collect()
    assert len({r.domain for r in got}) == 30 and all(r.domain == f"kind={r.doc_id % 30}" for r in got if r.tokens)
    out = mix(docs, labels, weights, label_cols=("kind",))
    assert out.columns == docs.columns and {(r.posterior, r.tokens, r.w) for r in out.collect()} == {(0, 1, 4)}
    kept = {r.doc_id % 30 for r in out.where("text is not null").collect()}
    assert kept == set(range(1, 30))


def test_a_very_long_text_and_ties(spark, docs_of):
    rows = [(i, "plain words here") for i in range(50)] + [(60, "long " * 300_000)]
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(50)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in mixing_rates(docs_of(rows), labels, {"quality=0,toxic=0": 0.5, "quality=1,toxic=0": 0.5}).collect()}
    assert got[60].tokens == 300_000 and {got[i].domain for i in range(50)} == {"quality=0,toxic=0"}


def test_mix_keeps_the_wanted_domain(spark, docs_of):
    rows, truth, docs, labels = data(spark, docs_of)
    out = mix(docs, labels, WEIGHTS)
    kept = {r.doc_id for r in out.collect()}
    assert out.columns == docs.columns
    clean = {i for i, x in truth.items() if x == (1, 0)}
    assert len(clean & kept) >= 0.98 * len(clean)
    assert len(kept - clean) < 0.6 * (len(truth) - len(clean))


def test_without_labels_and_empty(spark, docs_of):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = mixing_rates(docs_of([(1, "a b"), (2, None)]), none, WEIGHTS).collect()
    assert [(r.rate, r.copies, r.domain) for r in got] == [(1.0, 1, None)] * 2
    some = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    assert mixing_rates(docs_of([]), some, WEIGHTS).count() == 0
