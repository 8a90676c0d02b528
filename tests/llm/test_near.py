import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from pointlake.llm import near
from pointlake.llm.near import _links, connect, keep_first, least_matches, near_duplicates, shingles
from pointlake.workspace import Workspace
from tests.llm.conftest import make_docs


def _brute(rows):
    sets = [set(shingles(t.encode() if t else None).tolist()) for _, t in rows]
    root, links = list(range(len(rows))), [0] * len(rows)

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a in range(len(rows)):
        for b in range(a):
            common = len(sets[a] & sets[b])
            if common and common >= 0.8 * (len(sets[a]) + len(sets[b]) - common) - 1e-9:
                links[a] += 1
                links[b] += 1
                root[find(a)] = find(b)
    ids = {}
    for n in range(len(rows)):
        ids.setdefault(find(n), []).append(rows[n][0])
    return sorted((rows[n][0], min(ids[find(n)]), links[n]) for n in range(len(rows)))


def _group(rng, copies, words, change):
    base = [f"w{rng.randrange(5000)}" for _ in range(words)]
    out = []
    for _ in range(copies):
        text = list(base)
        for _ in range(rng.randrange(change + 1)):
            text[rng.randrange(words)] = f"x{rng.randrange(10**6)}"
        out.append(" ".join(text))
    return out


@pytest.mark.parametrize("options", [{}, {"block_bytes": 30_000, "max_blocks": 100}, {"block_bytes": 30_000, "max_blocks": 2}])
def test_against_brute_force(spark, options):
    rng = random.Random(5)
    texts = _group(rng, 60, 120, 9) + _group(rng, 30, 300, 12) + ["same text of six words here"] * 20
    texts += [t for _ in range(15) for t in _group(rng, 2, 60, 3)] + ["two words", "Two, WORDS!", "", None, "!!", None]
    rng.shuffle(texts)
    rows = [(100 + i, t) for i, t in enumerate(texts)]
    docs = make_docs(spark, rows).withColumn("fp", F.lit("clash")).repartition(4)
    found = near_duplicates(docs, **options).collect()
    assert sorted((r["doc_id"], r["class_id"], r["n_links"]) for r in found) == _brute(rows)


def test_one_of_each_group_stays(spark):
    rng = random.Random(2)
    rows = [(i, t) for i, t in enumerate(_group(rng, 12, 200, 4) + ["a b c d e f"] * 5 + ["alone here it is", None, None, ""])]
    kept = keep_first(make_docs(spark, rows))
    classes = {c for _, c, _ in _brute(rows)}
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert {r["doc_id"] for r in kept.collect()} == classes


def test_ids_that_are_null_or_name_two_texts(spark):
    rows = [(5, "a b c d e f g"), (5, "other words than these in it"), (3, "a b c d e f g"), (None, "a b c d e f g"), (5, "a b c d e f g")]
    kept = keep_first(make_docs(spark, rows)).collect()
    assert sorted((r["doc_id"] or -1, r["text"][0]) for r in kept) == [(-1, "a"), (3, "a"), (5, "o")]
    assert near_duplicates(make_docs(spark, rows).limit(0)).count() == 0


@pytest.mark.parametrize("key", [7, None])
def test_repeats_of_a_row_are_one_member(spark, monkeypatch, key):
    rng = random.Random(3)
    one, other, third = ([t, f"{t} end"] for t in _group(rng, 1, 300, 0) + _group(rng, 1, 300, 0) + _group(rng, 1, 300, 0))
    # Rows that share the id but not the text are members of their own classes only.
    rows = [(key, one[0])] * 400 + [(key, one[1]), (key, other[0]), (None, third[0]), (None, third[1]), (9, one[0])]
    seen = []

    def links(members, *rest):
        seen.extend(r["fp"] for r in members.select("fp").collect())
        return _links(members, *rest)

    monkeypatch.setattr(near, "_links", links)
    found = near_duplicates(make_docs(spark, rows), block_bytes=30_000, max_blocks=2).collect()
    assert len(seen) == len({bytes(x) for x in seen}) == 4
    assert sorted(r["n_links"] for r in found) == sorted([401] * 402 + [0] + [1] * 2)


def test_the_stage_leaves_one_row_of_each_group(spark):
    near_texts = [f"{' '.join(f'w{n}' for n in range(100))} {end}" for end in "ab"]
    rows = [(5, near_texts[0]), (5, near_texts[1]), (5, "one two three four five six")] + [(8, "other words than these in it")] * 6
    rows += [(None, "no id has this text at all")] * 3 + [(None, near_texts[0]), (None, "!!"), (None, "!!"), (4, None)]
    kept = corpus_pipeline.near_duplicates(spark, make_docs(spark, rows).repartition(3), "")
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    found = sorted((r["doc_id"] or -1, (r["text"] or "")[:3]) for r in kept.collect())
    assert found == [(-1, "!!"), (-1, "!!"), (-1, "no "), (4, ""), (5, "one"), (5, "w0 "), (8, "oth")]


@pytest.fixture
def many_partitions(spark, monkeypatch):
    """A key is hot from fewer rows when there are more partitions to spread it over."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    monkeypatch.setattr(near, "FAIR_ROWS", 3)
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def test_hubs_are_spread_over_tasks(spark, monkeypatch, many_partitions):
    rng = random.Random(8)
    edges = [(0, n) for n in range(1, 60)] + [(rng.randrange(60, 200), rng.randrange(60, 200)) for _ in range(20)]
    rows = [(max(e).to_bytes(2), min(e).to_bytes(2)) for e in edges]
    table = spark.createDataFrame(rows, "node binary, root binary")
    with monkeypatch.context() as unspread:
        unspread.setattr(near, "FAIR_ROWS", 10**6)
        plain = sorted(map(tuple, connect(table, Workspace(spark)).collect()))
    spread = []
    join = near.skew_join
    monkeypatch.setattr(near, "skew_join", lambda *a, **k: spread.append(k["hot"] is not False) or join(*a, **k))
    assert sorted(map(tuple, connect(table, Workspace(spark)).collect())) == plain
    assert any(spread)
    assert {root for node, root in plain if int.from_bytes(node) < 60} == {(0).to_bytes(2)}


def test_hot_keys_keep_every_link(spark, many_partitions):
    rng = random.Random(9)
    texts = ["the same words in each of these rows"] * 40 + _group(rng, 40, 60, 3) + [None, "", "few words"]
    rows = list(enumerate(texts))
    found = near_duplicates(make_docs(spark, rows))
    assert sorted((r["doc_id"], r["class_id"], r["n_links"]) for r in found.collect()) == _brute(rows)


def test_pruning_spares_pairs_at_the_threshold():
    needed = least_matches()
    rng = random.Random(1)
    lost = 0
    for _ in range(3000):
        hits, done = 0, 0
        for step in needed:
            hits += sum(rng.random() < 0.8 for _ in range(20))
            done += 20
            lost += hits < step
    assert lost == 0 and needed == sorted(needed) and needed[-1] > 80
