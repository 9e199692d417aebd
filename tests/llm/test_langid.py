import itertools
import random

import numpy as np

from sensorloom.llm.langid import LanguageModel, fit, forward_backward, identify_language, keep_identified, language_segments, train_language_model, word_slots

SYLLABLES = {"aa": ["ka", "lo", "mi", "tu"], "bb": ["sch", "ung", "ber", "ein"], "cc": ["éa", "ou", "què", "ñi"]}


def text(rng, lang, n):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 4))) for _ in range(n))


def corpus(spark, n=150):
    rng = random.Random(2)
    rows = [(i, text(rng, lang, rng.randint(5, 80)), lang) for i, lang in enumerate(itertools.islice(itertools.cycle(SYLLABLES), n))]
    rows += [(900, None, "aa"), (901, "ka lo", None)]
    return spark.createDataFrame([(i, t, lang, "x") for i, t, lang in rows], "doc_id long, text string, lang string, score string")


def test_held_out_and_code_switching(spark):
    docs = corpus(spark)
    model = train_language_model(docs, max_rows=30, epochs=20)
    assert model.labels == ("aa", "bb", "cc")
    assert all(model.moves[k, k] > model.moves[k, j] for k in range(3) for j in range(3) if j != k)
    rng = random.Random(9)
    new = [(i, text(rng, lang, 30), lang) for i, lang in enumerate(list(SYLLABLES) * 20)]
    mixed = text(rng, "aa", 60) + ". " + text(rng, "bb", 140)
    odd = [(500, None), (501, ""), (502, "12 34 !"), (503, "¿ — 😀"), (504, mixed), (505, text(rng, "cc", 50000)), (506, "éa")]
    df = spark.createDataFrame([(i, t) for i, t, _ in new] + odd, "doc_id long, text string")
    got = {r.doc_id: r for r in identify_language(df, model).collect()}
    assert sum(got[i].lang_pred == lang for i, _, lang in new) >= 58
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (500, 501, 502, 503))
    assert got[504].lang_pred == "bb" and 0.6 < got[504].score < 0.8
    assert got[505].lang_pred == got[506].lang_pred == "cc"
    kept = keep_identified(df.withColumn("score", df.doc_id), model, 0.3)
    assert {r.doc_id for r in kept.collect()} == set(got) - {500, 501, 502, 503} and kept.columns == ["doc_id", "text", "score"]
    assert identify_language(df.limit(0), model).count() == 0


def test_no_labels(spark):
    docs = spark.createDataFrame([(1, "a", None)], "doc_id long, text string, lang string")
    model = train_language_model(docs)
    assert model == LanguageModel((), None, None, None, None)
    assert [tuple(r) for r in identify_language(docs, model).collect()] == [(1, "und", 0.0)]


def test_forward_backward_against_enumeration():
    rng = np.random.default_rng(0)
    scores, moves, start = rng.normal(size=(7, 3)), rng.normal(size=(3, 3)), rng.normal(size=3)
    fresh = np.array([True, False, False, True, False, False, False])

    def weight(path):
        w = 0.0
        for t, s in enumerate(path):
            w += scores[t, s] + (start[s] if fresh[t] else moves[path[t - 1], s])
        return np.exp(w)

    want, pairs, total = np.zeros((7, 3)), np.zeros((3, 3)), 0
    for path in itertools.product(range(3), repeat=7):
        w = weight(path)
        total += w
        for t, s in enumerate(path):
            want[t, s] += w
            if not fresh[t]:
                pairs[path[t - 1], s] += w
    for block in (1, 2, 3, 128):
        post, moved, started = forward_backward(scores, fresh, moves, start, pairs=True, block=block)
        assert np.allclose(post, want / total) and np.allclose(moved, pairs / total)
        assert np.allclose(started, (want / total)[fresh].sum(axis=0))


def test_segments(spark):
    model = train_language_model(corpus(spark), max_rows=30, epochs=20)
    rng = random.Random(4)
    mixed = text(rng, "aa", 12) + " 7, " + text(rng, "bb", 15) + ". " + text(rng, "cc", 9)
    rows = [tuple(r) for r in language_segments(spark.createDataFrame([(1, mixed), (2, None), (3, "12"), (4, text(rng, "bb", 5)), (4, "ka")], "doc_id long, text string"), model).collect()]
    one = sorted(r for r in rows if r[0] == 1)
    assert sum(r[2] for r in one) == 36 and one[0][1] == 0 and all(a[1] + a[2] == b[1] for a, b in zip(one, one[1:]))
    truth = ["aa"] * 12 + ["bb"] * 15 + ["cc"] * 9
    said = [r[3] for r in one for _ in range(r[2])]
    assert sum(a == b for a, b in zip(truth, said)) >= 34 and all(0 < r[4] <= 1 for r in rows)
    assert sorted(r[:4] for r in rows if r[0] == 4) == [(4, 0, 1, "aa"), (4, 0, 5, "bb")] and not [r for r in rows if r[0] in (2, 3)]


def test_nothing_to_learn_and_many_languages(spark):
    """Labelled texts without a letter teach nothing; seventy languages are learned like four; names that clash are kept apart."""
    bare = spark.createDataFrame([(1, "123", "aa"), (2, "", "bb")], "doc_id long, text string, lang string")
    assert train_language_model(bare).labels == ()
    assert {r.lang_pred for r in identify_language(bare, train_language_model(bare)).collect()} == {"und"}
    assert keep_identified(bare, train_language_model(bare), 0.0).count() == 0
    rows = [(100 * k + j, f"x{chr(97 + k % 26)}q{chr(97 + k // 26)}z " * 6, f"l{k:02d}") for k in range(70) for j in range(2)]
    docs = spark.createDataFrame([(i, t, lang, 1, 2) for i, t, lang in rows], "doc_id long, text string, lang string, keep int, _keep int")
    model = train_language_model(docs, epochs=40)
    got = {r.doc_id: r.lang_pred for r in identify_language(docs, model).collect()}
    assert len(model.labels) == 70 and sum(got[i] == lang for i, _, lang in rows) >= 130
    kept = keep_identified(docs, model, 0.0)
    assert kept.columns == docs.columns and kept.count() == 140


def test_repeated_ids_in_the_sample(spark):
    """An id that stands often is one text of the sample, and leaves room for the others."""
    rng = random.Random(3)
    rows = [(1, f"ka lo {k % 3}", "aa") for k in range(400)] + [(10 + k, text(rng, "aa", 9), "aa") for k in range(50)] + [(100 + k, text(rng, "bb", 9), "bb") for k in range(60)]
    from sensorloom.llm.common import sample_texts

    known = spark.createDataFrame(rows, "i long, t string, l string")
    got = [(r.l, r.i) for r in sample_texts(known, 20, 1000).collect()]
    assert len(got) == len(set(got)) and sum(lang == "aa" for lang, _ in got) == sum(lang == "bb" for lang, _ in got) == 20
    assert sample_texts(known.limit(0), 20, 1000).count() == 0


def test_word_features():
    """Trigram, affix and word features are told by the word alone, wherever it stands."""
    grams, first, prefix, suffix, word, owner = word_slots(["Ka lo, katu".encode(), b"", "lo KA".encode(), "4 \u00e9a".encode()])
    assert owner.tolist() == [0, 0, 0, 2, 2, 3] and len(grams) == 2 + 2 + 4 + 2 + 2 + 3
    assert word[0] == word[4] and word[1] == word[3] and len(set(word.tolist())) == 4
    assert prefix[0] == prefix[4] and suffix[1] == suffix[3] and prefix[0] != prefix[2] and suffix[0] != suffix[2]
    assert grams[first[0] : first[1]].tolist() == grams[first[4] : first[5]].tolist()


def test_fit_raises_likelihood():
    """Training texts are labelled right and the learned transitions expect a language to go on."""
    rng = random.Random(6)
    langs = [lang for lang in SYLLABLES for _ in range(10)]
    texts = [text(rng, lang, 20).encode() for lang in langs]
    rows, weights, moves, start, lexicon = fit(texts, langs, tuple(SYLLABLES), 20, 3, 10, 0.1, 1e-7)
    assert weights[0].any() == False and rows.max() == len(weights) - 1  # noqa: E712
    from sensorloom.llm.langid import label_texts

    pred, score = label_texts(texts, (tuple(SYLLABLES), rows, weights, moves, start, lexicon))
    assert [tuple(SYLLABLES)[k] for k in pred] == langs and score.min() > 0.8
    assert fit([b"1", b""], ["aa", "bb"], ("aa", "bb"), 2, 1, 10, 0.1, 0) is None
