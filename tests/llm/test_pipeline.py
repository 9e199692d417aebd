import random

import corpus_pipeline
from sensorloom.llm.common import stored
from sensorloom.llm.simhash import keep_representatives, near_duplicates

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, note string"


def documents(spark):
    rng = random.Random(1)
    word = {"aa": lambda: rng.choice(["kalo", "mitu", "kami", "lotu", "tuka"]) + rng.choice(["ka", "mi"]), "bb": lambda: rng.choice(["schung", "berein", "ungein"]) + rng.choice(["ber", "ung"])}
    rows = []
    for i in range(200):
        lang = "ab"[i % 3 == 0] * 2
        text = " ".join(word[lang]() + str(rng.randrange(400)) for _ in range(rng.randint(20, 200)))
        if i % 7 == 0:
            text += " mail jane%d@site.org" % i
        rows.append((i, text, lang, "s", len(text), "n"))
    rows += [(300 + i, rows[i][1], "aa", "s", 1, "n") for i in range(20)]
    rows += [(400, None, None, "s", None, "n"), (401, "12 34", None, None, 5, None), rows[5], (None, "kaloka mituka alone in the world", "aa", None, 3, None)]
    return rows, spark.createDataFrame(rows, SCHEMA)


def test_stages_take_effect(spark, tmp_path):
    rows, docs = documents(spark)
    labels = [(i, int(i % 5 > 0), 0) for i in range(0, 200, 2)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    d = str(tmp_path)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_dedup", "personal_data", "mixing", "packing"]
    seen = [stored(docs)]
    for _, stage in corpus_pipeline.STAGES:
        seen.append(stored(stage(spark, seen[-1], d)))
    ids = [{r.doc_id for r in s.select("doc_id").collect()} for s in seen]
    assert all(s.columns == docs.columns for s in seen[:-1])
    assert ids[1] == ids[0] - {400, 401}
    assert ids[2] == ids[1] - set(range(300, 320)) and seen[2].count() == len(ids[2])
    texts = {r.doc_id: r for r in seen[3].collect()}
    assert ids[3] == ids[2] and texts[7].text.endswith("mail [EMAIL]") and texts[7].n_chars == len(texts[7].text)
    assert ids[4] <= ids[3] and len(ids[4]) > 0.5 * len(ids[3])
    assert ids[5] == ids[4]
    assert corpus_pipeline.run(spark, d).agg({"length": "sum"}).first()[0] == seen[5].agg({"length": "sum"}).first()[0]


def test_representatives(spark):
    rows, docs = documents(spark)
    kept = [r.doc_id for r in keep_representatives(docs).collect()]
    got = near_duplicates(docs).collect()
    want = {r.component_id for r in got if r.component_id is not None}
    assert sorted(k for k in kept if k is not None) == sorted(want) and kept.count(None) == 1


def test_stages_with_clashing_names_nulls_and_empty_tables(spark, tmp_path):
    """Columns named like the operators' own are kept with their values; empty tables give empty ones; nulls and repeated rows have their stated result."""
    names = ["k", "h", "keep", "tokens", "posterior", "base", "terms", "k1", "root", "node", "score", "__k", "__h"]
    rows, _ = documents(spark)
    rows = [(i, t, lang, "s", n, *range(len(names))) for i, t, lang, _, n, _ in rows[:60] + [rows[5]] + [r for r in rows if r[0] is None or r[0] >= 400]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n}` int" for n in names))
    spark.createDataFrame([(i, 1, 0) for i in range(30)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        got = out.collect()
        assert got and all([r[n] for n in names] == list(range(len(names))) for r in got)
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
    kept = [(r.doc_id, r.text) for r in corpus_pipeline.near_dedup(spark, docs, "").collect()]
    assert len(kept) == len(set(kept)) and sum(t is None for _, t in kept) <= 1
    same = corpus_pipeline.personal_data(spark, docs, "")
    assert same.count() == docs.count() and same.where("text is null and n_chars is null").count() == 1
    assert corpus_pipeline.packing(spark, docs.limit(0), "").count() == 0
