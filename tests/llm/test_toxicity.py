import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pointlake.llm.toxicity import Sample, apply_model, drop_toxic, fit_category, fit_chain, label_chain, score_toxicity, text_features, toxicity_query, THRESHOLD
from tests.llm.conftest import SF, make_docs

SF_LARGER = "/root/testdata/sf0.1"


def _tables(spark):
    return [spark.read.parquet(f"{SF_LARGER}/{n}.parquet") for n in ("documents", "labels")]


@pytest.fixture(scope="module")
def larger(spark):
    docs, labels = _tables(spark)
    return docs, label_chain(docs, labels)


def test_held_out_labels_by_language(spark):
    """Recall and false positives of each quarter of the labels under a chain fitted on the others.

    About a twentieth of the labels is wrong on purpose, which bounds the recall.
    """
    docs, labels = _tables(spark)
    parts = []
    for part in range(4):
        chain = label_chain(docs, labels.filter(f"doc_id % 4 <> {part}"))
        held = docs.join(labels.filter(f"doc_id % 4 = {part}"), "doc_id")
        parts.append(score_toxicity(held, chain).join(held.select("doc_id", "lang", "toxic"), "doc_id").toPandas())
    found = pd.concat(parts)
    found["flagged"] = found["p_toxic"] >= THRESHOLD
    toxic = found["toxic"] == 1
    assert toxic.sum() == 449
    assert found.loc[toxic, "flagged"].mean() >= 0.9
    assert found.loc[~toxic, "flagged"].mean() < 0.003
    recall = found[toxic].groupby("lang")["flagged"].mean()
    assert len(recall) == 4 and (recall >= 0.75).all(), recall


def test_edge_texts(spark, larger):
    _, chain = larger
    docs = make_docs(spark, [None, "", "word " * 300_000 + "idiot scum moron trash", "clean words", "clean words", "!!"])
    rows = {r["doc_id"]: r["p_toxic"] for r in score_toxicity(docs, chain).collect()}
    assert rows[2] >= THRESHOLD > rows[3] == rows[4] and rows[0] is rows[1] is rows[5] is None
    kept = drop_toxic(docs.withColumn("p_toxic", F.lit("clash")), chain)
    assert sorted(r["doc_id"] for r in kept.collect()) == [0, 1, 3, 4, 5]
    assert score_toxicity(docs.limit(0), chain).count() == 0


def test_no_labels_no_chain(spark, larger):
    docs, _ = larger
    labels = spark.createDataFrame([(None, 1, 1), (1, None, 0), (10**9, 1, 0)], "doc_id long, quality int, toxic int")
    assert label_chain(docs, labels) is None
    few = make_docs(spark, ["a b", "a b"])
    assert drop_toxic(few, None).count() == 2
    assert [tuple(r) for r in score_toxicity(few, None).collect()] == [(0, None, None), (1, None, None)]


@pytest.mark.parametrize("empty", ["labels", "documents"])
def test_query_on_empty_tables(spark, tmp_path, empty):
    for name in ("labels", "documents"):
        df = spark.read.parquet(f"{SF}/{name}.parquet")
        (df.limit(0) if name == empty else df).write.parquet(str(tmp_path / f"{name}.parquet"))
    rows = toxicity_query(spark, str(tmp_path)).collect()
    assert all(r["p_toxic"] is None and r["toxic"] is False for r in rows)
    assert len(rows) == (0 if empty == "documents" else spark.read.parquet(f"{SF}/documents.parquet").count())


def test_labels_of_absent_documents_use_up_no_rows(spark):
    docs = make_docs(spark, [f"{'bad' if i % 2 else 'good'} words here {i}" for i in range(80)])
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(5_000)], "doc_id long, quality int, toxic int")
    chain = fit_chain(docs, labels, {"toxic": F.col("toxic") == 1}, rows=60)
    assert chain is not None and [round(r["p_toxic"]) for r in score_toxicity(docs, chain).orderBy("doc_id").collect()] == [0, 1] * 40


def test_model_finds_the_telling_words():
    rng = np.random.default_rng(0)
    vocabulary = [b"w%d" % i for i in range(300)]
    texts, labels = [], []
    for i in range(800):
        tokens = list(rng.choice(vocabulary, 30))
        if i % 5 == 0:
            tokens += rng.choice([b"bad", b"worse", b"worst"], 2).tolist()
        texts.append(b" ".join(tokens))
        labels.append(float(i % 5 == 0))
    bags = [text_features(t)[0] for t in texts]
    ones = np.ones((len(bags), 1))
    fold = np.arange(len(bags)) % 4
    model, outside = fit_category(Sample(bags), bags, ones, np.array(labels), fold)
    p = apply_model(model, bags, ones)
    assert ((p > 0.5) == np.array(labels, bool)).all() and len(model.hashes) < 80
    assert ((outside > 0.5) == np.array(labels, bool)).mean() > 0.97


def test_inflected_words_are_known_by_their_stem():
    rng = np.random.default_rng(1)
    ends = [b"%02d" % i for i in range(60)]
    texts = [b" ".join(rng.choice([b"w%d" % i for i in range(200)], 20)) + (b" vilest" + rng.choice(ends) if i % 4 == 0 else b"") for i in range(600)]
    bags, labels = [text_features(t)[0] for t in texts], np.arange(600) % 4 == 0
    model, _ = fit_category(Sample(bags), bags, np.ones((600, 1)), labels.astype(float), np.arange(600) // 2 % 3)
    p = apply_model(model, [text_features(t)[0] for t in (b"so vilestunseen", b"so vile", b"so w3")], np.ones((3, 1)))
    assert p[0] > 0.5 > max(p[1:])
