from __future__ import annotations

import os
import sys

import numpy as np
import pandas as pd
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pointlake.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "pointlake-tests",
        "local[8]",
        **{
            "spark.sql.shuffle.partitions": "4",
            "spark.ui.enabled": "false",
            "spark.driver.memory": "6g",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def make_points(spark, objects: dict[tuple[int, int], np.ndarray], features: dict | None = None, dims: int = 4):
    """Point table of ``{(shard, root_id): coordinates}``; features default to noise."""
    rng = np.random.default_rng(1)
    rows = []
    for (shard, root), xyz in objects.items():
        vectors = features[(shard, root)] if features else rng.normal(size=(len(xyz), dims))
        for pid, (p, v) in enumerate(zip(xyz, vectors, strict=True)):
            rows.append((shard, root, pid, *map(float, p), [float(x) for x in v]))
    schema = "shard long, root_id long, pid long, x double, y double, z double, embedding array<float>"
    return spark.createDataFrame(pd.DataFrame(rows, columns=[f.split()[0] for f in schema.split(", ")]), schema)


def brute_edges(objects, k: int = 3):
    edges = set()
    for (shard, root), xyz in objects.items():
        xyz = np.asarray(xyz, dtype="float64").reshape(-1, 3)
        squares = ((xyz[:, None] - xyz[None]) ** 2).sum(axis=2)
        np.fill_diagonal(squares, np.inf)
        for i in range(len(xyz)):
            near = np.argsort(squares[i], kind="stable")[: min(k, len(xyz) - 1)]
            same = np.flatnonzero((xyz == xyz[i]).all(axis=1))
            if len(same) > k + 1:
                # Any k copies are nearest; the rule takes the next ones in id order.
                at = int(np.searchsorted(same, i))
                near = same[[(at + step) % len(same) for step in range(1, k + 1)]]
            for j in near:
                edges.add((shard, root, min(i, int(j)), max(i, int(j))))
    return edges


def curve(n: int, seed: int) -> np.ndarray:
    """Points along a wandering path, the usual shape of an object."""
    rng = np.random.default_rng(seed)
    return np.cumsum(rng.normal(size=(n, 3)) + 0.3, axis=0)
