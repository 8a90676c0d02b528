import numpy as np
import pytest
from pyspark.sql import functions as F

from pointlake.llm import language
from pointlake.llm.language import fit, identify, keep_identified, language_query, least_score, to_windows, train
from tests.llm.conftest import DOCS, SF, make_docs


def test_held_out_accuracy(spark, sample):
    found = language_query(spark, SF)
    joined = found.join(sample.select("doc_id", "lang"), "doc_id").toPandas()
    held = joined[joined["held_out"]]
    assert len(held) > 40 and (held["lang"] == held["lang_pred"]).mean() > 0.97
    assert ((joined["score"] >= 0) & (joined["score"] <= 1)).all()


def test_edge_texts(spark, sample):
    net = fit(sample)
    docs = make_docs(spark, [None, "", "12 !? 34", "the", "the " * 200_000, "the ", "the "]).withColumn("score", F.lit("clash"))
    rows = {r["doc_id"]: r for r in identify(docs, net).collect()}
    assert [rows[i]["lang_pred"] for i in range(3)] == ["und"] * 3 and rows[2]["score"] == 0
    assert rows[4]["lang_pred"] == "en" and rows[5]["score"] == rows[6]["score"]
    kept = keep_identified(docs, net)
    assert kept.columns == docs.columns and {0, 1, 2}.isdisjoint(r["doc_id"] for r in kept.collect())
    assert identify(docs.limit(0), net).count() == 0


def test_without_labels_nothing_is_identified(spark):
    docs = make_docs(spark, ["some text"], lang=None)
    assert fit(docs) is None and fit(docs.limit(0)) is None
    assert identify(docs, None).first()["lang_pred"] == "und"


def test_scoring_is_the_same_convolution_as_training():
    rng = np.random.default_rng(1)
    windows = rng.integers(0, 256, size=(40, language.WINDOW), dtype=np.uint8)
    net = train(windows, np.arange(40) % 2, ["a", "b"], steps=2)
    for width, t in net.tables.items():
        n = windows.shape[1] - width + 1
        plain = sum(t[i][windows[:, i : i + n]] for i in range(width))
        assert np.allclose(net.responses(windows, width), plain, atol=1e-5)


def test_windows_cover_whole_texts():
    windows, owner = to_windows([b"abc" * 200, b"x"], 256)
    assert windows.shape == (4, 256) and owner.tolist() == [0, 0, 0, 1]
    assert bytes(windows[:3].tobytes()).rstrip(b"\0") == b"abc" * 200


def test_the_bound_follows_the_number_of_languages():
    assert [round(least_score(n), 3) for n in (1, 2, 4, 10)] == [1.0, 0.54, 0.28, 0.114]


@pytest.mark.parametrize("n", [2, 10])
def test_short_and_long_texts_of_few_and_many_languages_stay(spark, n):
    rng = np.random.default_rng(n)
    alphabets = ["abcdefghijklmnopqrstuvwxyz"[2 * i : 2 * i + 2] for i in range(n)]
    write = lambda letters, k=60: " ".join("".join(rng.choice(list(letters), 5)) for _ in range(k))
    rows = [(i, write(alphabets[i % n]), f"l{i % n}", "s", 0) for i in range(60 * n)]
    net = fit(spark.createDataFrame(rows, DOCS))
    texts = [write(a) for a in alphabets] + [write(a, 4) for a in alphabets] + ["12 34", None]
    kept = {r["doc_id"] for r in keep_identified(make_docs(spark, texts), net).collect()}
    assert kept == set(range(2 * n))
    assert keep_identified(make_docs(spark, texts), None).count() == 0
