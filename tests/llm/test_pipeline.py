import random

import corpus_pipeline
from watchwell.llm import near_dup, packing, pii, toxicity
from watchwell.llm.common import stored, table


def test_stages_do_what_their_operators_say(spark, tmp_path):
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(200)]
    docs, labels = [], []
    for i in range(120):
        words = [rng.choice(vocabulary) for _ in range(60)]
        if i % 6 == 0:
            words[5] = "moron"
        if i % 10 == 1:
            words.append(f"user{i}@mail.example")
        docs.append((i, " ".join(words), "en", "s", 1))
        labels.append((i, 1, int(i % 6 == 0)))
    docs += [(200, docs[1][1], "en", "s", 1), (201, docs[2][1].replace("w1 ", "w2 ", 1), "en", "s", 1), (202, None, "en", "s", None), (203, "", "en", "s", 0)]
    columns = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(docs, columns).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    at = str(tmp_path)
    whole = table(spark, at, "documents")
    clean = corpus_pipeline.drop_toxic(spark, whole, at)
    scores = {r.doc_id: r.score for r in toxicity.score(whole, toxicity.train(whole, table(spark, at, "labels"))).collect()}
    assert clean.columns == whole.columns
    assert sorted(r.doc_id for r in clean.collect()) == sorted(d for d, s in scores.items() if s < 0.5) == [d[0] for d in docs if d[0] % 6 or d[0] >= 200 or d[0] == -1]
    single = corpus_pipeline.drop_near_duplicates(spark, clean, at)
    kept = sorted(r.doc_id for r in single.collect())
    assert kept == sorted({r.class_id for r in near_dup.classes(clean).collect()})
    assert 200 not in kept and 203 not in kept and 1 in kept
    masked = corpus_pipeline.mask_personal_data(spark, single, at).collect()
    assert len(masked) == len(kept)
    assert all("@" not in (r.text or "") and r.n_chars == (len(r.text) if r.text is not None else None) for r in masked)
    out = corpus_pipeline.run(spark, at)
    assert sorted(r.doc_id for r in out.collect()) == kept
    assert out.columns == packing.pack(single).columns and pii.KINDS
    assert [k for k, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "personal_data", "packing"]


COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, label int, key string, score double"


def test_stages_on_nulls_repeats_long_texts_and_clashing_columns(spark, tmp_path):
    """Rows without doc_id stay, of rows that share one a defined one stays, other columns go through."""
    rng = random.Random(5)
    text = lambda n: " ".join(f"w{rng.randrange(500)}" for _ in range(n))
    a, b = text(80), text(80)
    docs = [(1, a), (2, a + " end"), (3, b), (3, b), (3, text(70)), (None, a), (None, None), (4, None), (5, ""), (6, text(60_000)), (7, "tox " * 3)]
    rows = [(d, t, None, "s", None if t is None else len(t), 9, "k", 0.5) for d, t in docs]
    whole = spark.createDataFrame(rows, COLUMNS).repartition(3)
    whole.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(7, 1, 1), (1, 1, 0), (3, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    at = str(tmp_path)
    single = corpus_pipeline.drop_near_duplicates(spark, whole, at)
    assert single.columns == whole.columns
    kept = single.collect()
    assert sorted((r.doc_id or 0, r.label, r.key, r.score) for r in kept) == sorted((d, 9, "k", 0.5) for d in (0, 0, 1, 3, 4, 6, 7))
    again = corpus_pipeline.drop_near_duplicates(spark, whole.repartition(5, "text"), at).collect()
    assert sorted(map(str, again)) == sorted(map(str, kept))
    masked = corpus_pipeline.mask_personal_data(spark, single, at).collect()
    assert len(masked) == 7 and {r.text for r in masked} == {r.text for r in kept}
    clean = stored(corpus_pipeline.drop_toxic(spark, whole, at), "clean")
    assert len(corpus_pipeline.run(spark, at).collect()) == len(corpus_pipeline.drop_near_duplicates(spark, clean, at).collect())


def test_empty_documents(spark, tmp_path):
    spark.createDataFrame([], COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = table(spark, str(tmp_path), "documents")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).collect() == []
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
