from __future__ import annotations

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars int"
SF = "/root/testdata/sf0.001"


def make_docs(spark, texts, lang="en", extra=""):
    """A documents table of ``texts``, ids from 0; an ``(id, text)`` pair gives its own id."""
    rows = []
    for i, t in enumerate(texts):
        key, text = t if isinstance(t, tuple) else (i, t)
        rows.append((key, text, lang, "s", len(text or "")))
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="session")
def sample(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")
