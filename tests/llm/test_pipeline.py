import re

import numpy as np
import pytest
from tokenizers import Tokenizer

import __spark_entry__ as contract
import corpus_pipeline
from pointlake.llm.near import shingles
from tests.llm.conftest import SF
from tests.llm.test_decontamination import _brute as hits
from tests.llm.test_toxicity import INSULTS

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    """What each stage was given and what it made of it, by name."""
    root = tmp_path_factory.mktemp("stages")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    made = []
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(str(root / str(n)))
        after = spark.read.parquet(str(root / str(n)))
        made.append((name, docs.toPandas(), after.toPandas()))
        docs = after
    return made


def test_all_but_the_last_stage_return_documents(steps):
    assert [name for name, _, _ in steps] == [
        "language ID", "toxicity", "n-gram Jaccard join", "benchmark decontamination", "best-fit packing"
    ]
    assert all(list(after.columns) == COLUMNS for _, _, after in steps[:-1])
    assert all(set(after.doc_id) <= set(before.doc_id) for _, before, after in steps)


def test_language_keeps_texts_with_letters(steps):
    _, before, after = steps[0]
    lost = before[~before.doc_id.isin(after.doc_id)]
    assert len(lost) <= 0.01 * len(before) + sum(not re.search(r"[^\W\d_]", t or "") for t in before.text)


def test_toxicity_drops_few_but_toxic_documents(steps):
    # A handful of labels to learn from; the larger tables are tested with the operator.
    _, before, after = steps[1]
    toxic = before.text.map(lambda t: bool(INSULTS.search(t)))
    gone = ~before.doc_id.isin(after.doc_id)
    assert (gone & toxic).sum() >= 0.5 * toxic.sum() and (gone & ~toxic).sum() <= 0.1 * len(before)


def test_one_of_each_group_of_near_duplicates_stays(steps):
    _, before, after = steps[2]
    sets = {r.doc_id: set(shingles(r.text.encode()).tolist()) for r in before.itertuples()}
    root = {i: i for i in sets}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            common = len(sets[a] & sets[b])
            if common and common >= 0.8 * (len(sets[a]) + len(sets[b]) - common):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    assert set(after.doc_id) == {i for i in ids if find(i) == i}


def test_no_benchmark_passage_is_left(spark, steps):
    _, before, after = steps[3]
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    clean = {r.doc_id for r in before.itertuples() if hits(r.text, items)[1] == 0}
    assert set(after.doc_id) == clean


def test_sequences_hold_the_texts(steps):
    import public_tokenizers

    _, before, after = steps[4]
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces = after.sort_values(["doc_id", "piece"]).groupby("doc_id")["ids"]
    for key, parts in pieces:
        ids = np.frombuffer(b"".join(map(bytes, parts)), "<u4").tolist()
        assert ids[-1] == 0 and tokenizer.decode(ids[:-1]) == before.text[before.doc_id == key].iloc[0]
    assert after.groupby("sequence_id")["length"].sum().max() <= 2048


def test_registered(spark):
    names = contract.queries()
    assert {f"op{n}" for n in range(1, 11)} <= {n.split("_")[0] for n in names} and "pipeline" in names
    assert corpus_pipeline.ORACLE_SQL is None
