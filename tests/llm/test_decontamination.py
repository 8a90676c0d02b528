import pickle
import random
import re

import pytest
from pyspark.sql import functions as F

from pointlake.llm.decontamination import NgramSet, decontaminate, find_contamination, merge_ranges
from pointlake.llm.text import words
from tests.llm.conftest import make_docs

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
ITEM = "one two three four five six seven eight nine ten eleven Zwölf"


def _plain(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def _brute(text, items):
    doc, hit, ids = _plain(text), set(), set()
    for item_id, item in items:
        w = _plain(item)
        size = min(10, len(w))
        for j in range(len(w) - size + 1 if size else 0):
            for i in range(len(doc) - size + 1):
                if doc[i : i + size] == w[j : j + size]:
                    hit.update(range(i, i + size))
                    ids.add(str(item_id))
    return len(doc), len(hit), sorted(ids)


@pytest.mark.parametrize("block_bytes", [10**9, 60])
def test_hits_against_brute_force(spark, block_bytes):
    items = [(1, ITEM), (2, "a short ITEM"), (3, None), (4, ""), (5, "!!"), (12, "one two three four five six seven eight nine ten")]
    texts = [
        None, "", "!!!", ITEM, f"Before {ITEM}, after", "A short\nitem and a SHORT item", ITEM.upper(), ITEM.replace(" ", "--"),
        "one two three four five six seven eight nine", "x " * 5000 + ITEM + " y" * 5000, "ten eleven zwölf", ITEM + " " + ITEM,
    ]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    docs = make_docs(spark, texts).withColumnRenamed("source", "hits")  # a clashing name
    found = find_contamination(docs, benchmark, block_bytes=block_bytes).collect()
    got = {r["doc_id"]: (r["hits"]["n_words"], r["hits"]["n_hit"], r["hits"]["item_ids"]) for r in found}
    assert got == {i: _brute(t, items) for i, t in enumerate(texts)}


def test_removal(spark):
    benchmark = spark.createDataFrame([(1, ITEM)], "item_id long, text string")
    docs = make_docs(spark, [f"Keep. {ITEM}! End", "clean", None, "clean"])
    assert [r["doc_id"] for r in decontaminate(docs, benchmark).orderBy("doc_id").collect()] == [1, 2, 3]
    cut = decontaminate(docs, benchmark, remove="spans").orderBy("doc_id")
    assert cut.columns == docs.columns
    assert [r["text"] for r in cut.collect()] == ["Keep. ! End", "clean", None, "clean"]
    with pytest.raises(ValueError):
        decontaminate(docs, benchmark, remove="words")


@pytest.mark.parametrize("remove", ["documents", "spans"])
def test_a_document_column_called_hits_stays(spark, remove):
    benchmark = spark.createDataFrame([(1, ITEM)], "item_id long, text string")
    docs = make_docs(spark, [ITEM, "clean"]).withColumn("hits", F.concat(F.lit("own "), "doc_id")).select("hits", "doc_id", "text", "lang")
    found = decontaminate(docs, benchmark, remove=remove).orderBy("doc_id")
    assert found.columns == docs.columns
    assert [r["hits"] for r in found.collect()] == (["own 1"] if remove == "documents" else ["own 0", "own 1"])


def test_empty_tables(spark):
    benchmark = spark.createDataFrame([(1, ITEM), (None, ITEM)], "item_id long, text string")
    docs = make_docs(spark, [ITEM])
    assert find_contamination(docs.limit(0), benchmark).count() == 0
    assert find_contamination(docs, benchmark.limit(0)).first()["hits"]["n_hit"] == 0
    assert find_contamination(docs, benchmark.filter("item_id IS NULL")).first()["hits"]["n_hit"] == 12


def test_ranges():
    assert merge_ranges([(5, 7), (0, 2), (2, 4), (6, 9)]) == [(0, 4), (5, 9)]


def test_ngrams_of_many_items_against_brute_force():
    rng = random.Random(4)
    items = [(rng.choice([None, *range(30)]), " ".join(rng.choices("abcd", k=rng.randrange(0, 14)))) for _ in range(80)]
    grams = NgramSet([(i, t.encode()) for i, t in items], 10)
    for _ in range(60):
        text = " ".join(rng.choices("abcde", k=rng.randrange(0, 40))) + " " + rng.choice(items)[1]
        spans, owners = grams.find(words(text.encode()))
        named = [(i, t) for i, t in items if i is not None]
        assert (len(_plain(text)), sum(b - a for a, b in spans)) == _brute(text, items)[:2]
        assert sorted(owners - {None}) == _brute(text, named)[2]


def test_the_set_stays_a_few_times_its_text():
    rng = random.Random(5)
    items = [(i, " ".join(f"w{rng.randrange(20_000)}" for _ in range(100)).encode()) for i in range(5000)]
    assert len(pickle.dumps(NgramSet(items, 10))) < 8 * sum(len(t) for _, t in items)
