import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from pointlake.llm.packing import cut_documents, pack, packing_query, plan_best_fit
from pointlake.llm.tokens import context_totals, encoder, length_histogram, quantiles, token_counts_query, truncated_totals, VOCABULARY
from tests.llm.conftest import make_docs

TEXTS = [None, "", "a", "word " * 700, "word " * 700, "Zwölf  kurze\n\nWörter 　 ", "<|endoftext|>", "x" * 3000, "a", "a <|endoftext|> b", "<|endoftext|><|endoftext|>\n <|endoftext", "é<|endoftext|>  ", "<|endof<|endoftext|>text|>"]


def _reference(text):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return tokenizer.encode(text or "", add_special_tokens=False).ids


def test_ids_are_those_of_the_tokenizers_file(sample):
    encode = encoder(VOCABULARY)
    texts = [r["text"] for r in sample.select("text").collect()] + TEXTS[1:]
    assert all(encode(t) == _reference(t) for t in texts)


def test_plan_is_best_fit_decreasing():
    rng = random.Random(1)
    for _ in range(200):
        capacity = rng.choice([5, 16, 64])
        counts = {n: rng.randint(1, 9) for n in range(1, capacity + 1) if rng.random() < 0.7}
        _, sequences = plan_best_fit(counts, capacity)
        room = []
        for length in sorted(counts, reverse=True):
            for _ in range(counts[length]):
                open_at = [i for i, r in enumerate(room) if r >= length]
                if open_at:
                    room[min(open_at, key=lambda i: room[i])] -= length
                else:
                    room.append(capacity - length)
        assert sequences == len(room)


def test_pieces_round_trip_and_fill_sequences(spark):
    docs = make_docs(spark, TEXTS).withColumn("length", F.lit("clash")).repartition(3)
    rows = pack(cut_documents(docs, capacity=64), capacity=64).collect()
    texts, places = defaultdict(list), defaultdict(list)
    for r in rows:
        ids = np.frombuffer(bytes(r["ids"]), "<u4").tolist()
        assert len(ids) == r["length"] <= 64
        texts[r["doc_id"]].append((r["piece"], r["start"], ids))
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for i, text in enumerate(TEXTS):
        joined = [x for _, _, ids in sorted(texts[i]) for x in ids]
        assert joined == _reference(text) + [0]
        pieces = sorted(texts[i])
        assert [s for _, s, _ in pieces] == list(np.cumsum([0] + [len(x) for _, _, x in pieces])[:-1])
        assert all(len(ids) == 64 for _, _, ids in pieces[1:])
    for held in places.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 64
    _, best = plan_best_fit(Counter(r["length"] for r in rows), 64)
    assert len(places) == best


def test_packing_of_repeats_and_of_nothing(spark):
    same = make_docs(spark, [(7, "one two three")] * 50 + [(None, "x")])
    rows = pack(cut_documents(same)).collect()
    assert len(rows) == 51 and len({(r["sequence_id"], r["offset"]) for r in rows}) == 51
    assert pack(cut_documents(same.limit(0))).count() == 0


def test_histogram_and_totals(spark):
    docs = make_docs(spark, TEXTS).withColumn("documents", F.lit(1))
    lengths = [len(_reference(t)) for t in TEXTS]
    histogram = length_histogram(docs)
    assert {r["length"]: r["documents"] for r in histogram.collect()} == dict(Counter(lengths))
    for r in context_totals(histogram).collect():
        n = r["length"]
        assert r["documents_from"] == sum(x >= n for x in lengths)
        assert r["tokens_from"] == sum(x for x in lengths if x >= n)
        assert r["truncated_tokens"] == sum(min(x, n) for x in lengths)
        assert r["quantile"] == sum(x <= n for x in lengths) / len(lengths)
    limits = truncated_totals(histogram, [0, 5, 10**6]).collect()
    assert [(r["limit"], r["tokens"], r["documents_cut"]) for r in limits] == [
        (m, sum(min(x, m) for x in lengths), sum(x > m for x in lengths)) for m in (0, 5, 10**6)
    ]
    assert [r["length"] for r in quantiles(context_totals(histogram), [0.5, 1.0]).collect()] == [sorted(lengths)[(len(lengths) - 1) // 2], max(lengths)]
    assert context_totals(length_histogram(docs.limit(0))).count() == 0


# Runs before a word and a line, one that ends a text, and white space of three bytes.
LONG_RUNS = [" " * 150_000 + "<|endoftext|>" + " " * 150_000 + "<|endoftext|>x", "a" + " " * 1_500_000 + "b", "\n" * 1_500_000 + "b", "word" + " \n" * 60_000, "\u3000" * 110_000 + "\n 's \x1c" + "\t" * 100_001 + "!?"]


def test_very_long_runs_of_white_space(spark, tmp_path):
    encode, expected = encoder(VOCABULARY), [_reference(t) for t in LONG_RUNS]
    assert [encode(t) for t in LONG_RUNS] == expected
    make_docs(spark, LONG_RUNS).write.parquet(str(tmp_path / "documents.parquet"))
    lengths = token_counts_query(spark, str(tmp_path)).collect()
    assert {r["length"]: r["documents"] for r in lengths} == dict(Counter(map(len, expected)))
    packed = packing_query(spark, str(tmp_path)).groupBy("doc_id").agg(F.sum("length")).collect()
    assert {r[0]: r[1] for r in packed} == {i: len(ids) + 1 for i, ids in enumerate(expected)}
    held = defaultdict(list)
    for r in corpus_pipeline.pack(spark, spark.read.parquet(str(tmp_path / "documents.parquet")), "").collect():
        held[r["doc_id"]].append((r["piece"], bytes(r["ids"])))
    for i, ids in enumerate(expected):
        assert np.frombuffer(b"".join(b for _, b in sorted(held[i])), "<u4").tolist() == ids + [0]
