import struct

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pointlake.functions.bits import interleave
from pointlake.functions.columns import (
    drop_columns,
    fixed_vector,
    id_from_name,
    id_partition,
    position_columns,
    with_literals,
)
from pointlake.functions.geometry import decode_point, decode_points, encode_point
from pointlake.functions.vectors import array_stats, mean_vector_by


def wkb(x, y, z, order="<", kind=0x80000001, srid=None):
    flag = 1 if order == "<" else 0
    if srid is not None:
        return struct.pack(f"{order}BII3d", flag, kind | 0x20000000, srid, x, y, z).hex()
    return struct.pack(f"{order}BI3d", flag, kind, x, y, z).hex()


def test_every_point_encoding():
    texts = [
        wkb(1, 2, 3),
        wkb(1, 2, 3, srid=4326),
        wkb(1, 2, 3, order=">"),
        wkb(1, 2, 3, kind=1001).upper(),
        wkb(-3.7, 19649.9, 0.5),
        None,
        "",
    ]
    found = decode_points(pa.array(texts))
    assert found.to_pylist() == [[1, 2, 3]] * 4 + [[-3, 19649, 0], None, None]


@pytest.mark.parametrize(
    "text", [struct.pack("<BI2d", 1, 1, 1.0, 2.0).hex(), wkb(3e9, 0, 0), wkb(float("nan"), 0, 0), wkb(1, 2, 3)[:-2]]
)
def test_bad_points_are_refused(text):
    with pytest.raises(ValueError):
        decode_points(pa.array([wkb(1, 2, 3), text]))


@settings(max_examples=50, deadline=None)
@given(st.lists(st.tuples(*[st.floats(-2e9, 2e9)] * 3), min_size=1, max_size=20), st.sampled_from("<>"))
def test_points_truncate_toward_zero(points, order):
    found = decode_points(pa.array([wkb(*p, order=order) for p in points]))
    assert found.to_pylist() == [[int(c) for c in p] for p in points]


def test_points_of_a_sliced_batch():
    texts = pa.array([wkb(i, i, i, srid=7 if i % 3 else None) for i in range(9)])
    assert decode_points(texts[4:7]).to_pylist() == [[i] * 3 for i in range(4, 7)]
    assert decode_points(pa.array([], pa.string())).to_pylist() == []


def test_point_columns_in_spark(spark):
    rows = spark.createDataFrame([(1, -2, 3), (40, 50, 60)], "a int, b int, c int")
    texts = rows.select(encode_point("a", "b", "c").alias("pt_position"), F.lit(1).alias("pt_position_x"))
    assert position_columns(texts) == ["pt_position"]
    assert texts.select(decode_point("pt_position")).collect()[0][0] == [1, -2, 3]


def test_id_partition_is_non_negative_and_keeps_null(spark):
    ids = [0, 1, 63, 64, -5, None, 123456789012345678]
    rows = spark.createDataFrame([(i,) for i in ids], "id long").select(id_partition("id", 64)).collect()
    assert [r[0] for r in rows] == [None if i is None else i % 64 for i in ids]


def test_vector_length_is_checked(spark):
    rows = spark.createDataFrame([([1.0, 2.0],), (None,)], "v array<double>")
    assert [r[0] for r in rows.select(fixed_vector("v", 2)).collect()] == [[1.0, 2.0], None]
    with pytest.raises(Exception, match="expected 3 elements, got 2"):
        rows.select(fixed_vector("v", 3)).collect()


def test_names_and_literals(spark):
    rows = spark.createDataFrame([("gs/x/123456789012345678.csv",), ("7.zip",)], "name string")
    assert [r[0] for r in rows.select(id_from_name("name")).collect()] == [123456789012345678, 7]
    assert with_literals(rows, {"shard": (3, "long")}).first()["shard"] == 3
    assert drop_columns(rows, ["absent"]).columns == ["name"]
    with pytest.raises(ValueError, match="absent"):
        drop_columns(rows, ["absent"], strict=True)


def test_interleave_orders_bits(spark):
    rows = spark.createDataFrame([(5, 3)], "a long, b long").select(interleave(["a", "b"], 3)).first()
    assert rows[0] == 0b011011
    with pytest.raises(ValueError):
        interleave(["a"] * 4, 16)


def test_means_and_stats(spark):
    rng = np.random.default_rng(0)
    vectors = rng.normal(size=(200, 5)).astype("float32")
    frame = pd.DataFrame({"g": np.arange(200) % 3, "v": list(vectors.tolist())})
    df = spark.createDataFrame(frame, "g int, v array<float>")
    for row in mean_vector_by(df, ["g"], "v", 5, F.count(F.lit(1)).alias("n")).collect():
        mine = vectors[np.arange(200) % 3 == row["g"]]
        assert row["n"] == len(mine)
        np.testing.assert_allclose(row["v"], mine.astype("float64").mean(axis=0), rtol=1e-5)
    stats = array_stats("v")
    row = df.select(*[c.alias(n) for n, c in stats.items()]).first()
    one = vectors[0].astype("float64")
    np.testing.assert_allclose(list(row), [one.mean(), one.std(), one.sum(), 5], rtol=1e-6)


def test_means_leave_null_elements_out(spark):
    rows = [("a", [2.0, 4.0]), ("a", [None, 8.0]), ("a", None), ("b", [None, 1.0])]
    df = spark.createDataFrame(rows, "k string, v array<double>")
    found = {r["k"]: r["v"] for r in mean_vector_by(df, ["k"], "v", 2).collect()}
    assert found == {"a": [2.0, 6.0], "b": [None, 1.0]}


def test_statistics_of_long_arrays_are_one_pass(spark):
    values = [float(i % 97) for i in range(200_000)]
    stats = array_stats("v")
    row = spark.createDataFrame([(values,)], "v array<double>").select(*[c.alias(n) for n, c in stats.items()]).first()
    assert row["std"] == pytest.approx(np.std(values)) and row["mean"] == pytest.approx(np.mean(values))
