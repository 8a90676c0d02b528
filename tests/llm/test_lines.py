import hashlib
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from pointlake.llm.lines import dedup_lines, drop_bitmaps, hot_lines, line_occurrences, lines_query
from pointlake.workspace import Workspace
from tests.llm.conftest import SF, make_docs

BLANKS = "\t\n\x0b\x0c\r "
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_kept(pairs):
    """``(doc_id, n_lines, n_dropped, kept)`` of each row of ``(doc_id, text)``."""
    order = lambda key: (key is None, key)
    holders = defaultdict(set)
    for key, text in pairs:
        for line in (text or "").split("\n"):
            holders[line.strip(BLANKS).translate(LOWER)].add(key)
    rows = []
    for key, text in pairs:
        lines = (text or "").split("\n")
        kept = []
        for line in lines:
            name = line.strip(BLANKS).translate(LOWER)
            if len(name) < 10 or min(holders[name], key=order) == key:
                kept.append(line)
        rows.append((key, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return rows


def found_rows(docs, **options):
    return [(r["doc_id"], r["n_lines"], r["n_dropped"], r["kept"]) for r in dedup_lines(docs, **options).collect()]


def shown(rows):
    return sorted(rows, key=lambda r: tuple(map(str, r)))


def test_query_equals_brute_force(spark):
    pairs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    found = sorted(tuple(r) for r in lines_query(spark, SF).collect())
    assert found == sorted((k, n, d, hashlib.sha256(t.encode()).hexdigest()) for k, n, d, t in brute_kept(pairs))
    assert sum(r[2] for r in found) > 50


def test_edge_texts(spark):
    same = "a line that repeats"
    pairs = [
        (5, None), (6, ""), (7, "\n"), (8, "\n\n"), (9, f"{same}\n{same}"), (4, f"  {same.upper()}\t\nshort\n"), (10, "short\nshort"),
        (11, "éÉÄ äöü ß 12345"), (12, "ééä äöü ß 12345"), (13, "éÉÄ äöü ß 12345\r"), (14, "123456789\n1234567890"), (15, "1234567890\n123456789"),
        (None, f"{same}\nonly without id"), (None, "only without id\nanother line here"), (20, "another line here"),
        (9, f"{same}\n{same}"), (9, "another text of nine\nanother line here"), (21, "another text of nine"),
    ]
    docs = make_docs(spark, pairs).withColumn("kept", F.lit("clash")).withColumn("bits", F.lit(1)).withColumn("first", F.lit(2))
    assert shown(found_rows(docs.repartition(3))) == shown(brute_kept(pairs))
    assert set(dedup_lines(docs).columns) == {*docs.columns, "n_lines", "n_dropped"}
    assert found_rows(docs.limit(0)) == []


@pytest.mark.parametrize("seed", range(3))
def test_random_lines_with_a_hot_one(spark, seed):
    rng = random.Random(seed)
    pool = [f"Line number {i:04d}" for i in range(60)]
    pairs = []
    for i in range(300):
        lines = [rng.choice(pool) for _ in range(rng.randint(0, 8))] + ["THE HOT LINE of all"] * rng.randint(0, 3)
        rng.shuffle(lines)
        pairs.append((rng.randrange(250), "\n".join(lines)))
    assert shown(found_rows(make_docs(spark, pairs).repartition(5))) == shown(brute_kept(pairs))


def test_hot_lines_are_few(spark):
    texts = [f"the same line everywhere\nown line of {i}" for i in range(500)]
    stored = Workspace(spark).save(line_occurrences(make_docs(spark, texts)), "lines")
    assert [r["first"] for r in hot_lines(stored, 16).collect()] == [0]


def test_bitmaps_are_compressed(spark):
    long_text = "\n".join(["a line that is shared"] + [f"own line {i:07d}" for i in range(200_000)] + ["and one more shared line"])
    docs = make_docs(spark, ["a line that is shared\nand one more shared line", long_text])
    rows = drop_bitmaps(docs, Workspace(spark)).collect()
    assert [(r["doc"], r["n_dropped"], [tuple(m) for m in r["marks"]]) for r in rows] == [(1, 2, [(0, 1), (200_001 // 64, 1 << (200_001 % 64))])]
    kept = {r["doc_id"]: r["kept"] for r in dedup_lines(docs).collect()}
    assert kept[1] == "\n".join(long_text.split("\n")[1:-1])


def test_no_python_in_the_plan(spark):
    plan = lines_query(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow"))
