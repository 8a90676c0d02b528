import csv
import random

import pytest

from pointlake.sources.dump import scan_dump
from pointlake.sources.records import quoted_records, split_openings

FIELDS = [("id", "bigint"), ("note", "text"), ("price", "numeric(10,2)")]


@pytest.fixture
def small_splits(spark):
    """Files are cut every few hundred bytes."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = {n: spark.conf.get(n) for n in names}
    spark.conf.set(names[0], "400")
    spark.conf.set(names[1], "1")
    yield
    for name, value in before.items():
        spark.conf.set(name, value)


def _note(rng, seed):
    kind = rng.randrange(6)
    if kind == 0:
        return '"' + "".join(rng.choice(["a", ",", '""', "\n", "é", " ", *["\r\n"] * (seed != 3)]) for _ in range(rng.randint(0, 60))) + '"'
    if kind == 1:
        return '"' + "long\n" * rng.randint(100, 400) + '"'  # longer than several splits
    return rng.choice(["", '""', "plain", "ünïcode", '"quoted, text"'])


def _write(tmp_path, name, rows, end="\n"):
    path = tmp_path / f"{name}.csv"
    path.write_bytes("".join(f"{r}{end}" for r in rows).encode())
    header = tmp_path / f"{name}_header.csv"
    header.write_text("".join(f'{f},"{t}"\n' for f, t in FIELDS))
    return str(path), str(header)


def _multi_line(spark, path):
    """The built-in reader, one task a file; it turns a carriage return before a newline into nothing."""
    reader = spark.read.schema("id long, note string, price decimal(10,2)").option("multiLine", True).option("escape", '"')
    return sorted(map(str, reader.option("mode", "FAILFAST").option("nullValue", "\x01").option("emptyValue", "").csv(path).collect()))


def _plain_reading(path):
    with open(path, encoding="utf-8", newline="") as lines:
        return sorted((int(i), note, price) for i, note, price in csv.reader(lines))


@pytest.mark.parametrize(("seed", "end"), [(1, "\n"), (2, "\r\n"), (3, "\n")])
def test_one_file_by_many_tasks(spark, tmp_path, small_splits, seed, end):
    rng = random.Random(seed)
    rows = [f"{i},{_note(rng, seed)},{rng.choice(['', '1.50'])}" for i in range(300)]
    path, header = _write(tmp_path, "dump", rows, end)
    found = scan_dump(spark, path, header)
    assert found.rdd.getNumPartitions() > 20
    rows = found.collect()
    assert sorted((r["id"], r["note"] or "", str(r["price"] or "")) for r in rows) == _plain_reading(path)
    if seed == 3:
        assert sorted(map(str, rows)) == _multi_line(spark, path)


def test_a_newline_across_a_border(spark, tmp_path, small_splits):
    body = ["x" * 190 for _ in range(12)]
    rows = ['1,"' + "\n".join(body) + '",1', "2,short,2", '3,"' + "y\n" * 500 + '"", and more",3', "", "4,,"]
    path, _ = _write(tmp_path, "torn", rows)
    records = [r[0] for r in quoted_records(spark, path).collect()]
    assert sorted(records) == sorted(r for r in rows if r)


def test_several_files_and_no_quotes(spark, tmp_path, small_splits):
    for i in range(3):
        _write(tmp_path, f"part{i}", [f"{i}{j},plain,1" for j in range(100)] + ['9,"a\nb",1'] * (i == 1))
    records = [r[0] for r in quoted_records(spark, f"{tmp_path}/part?.csv").collect()]
    assert len(records) == 301 and '9,"a\nb",1' in records
    plan = quoted_records(spark, f"{tmp_path}/part0.csv")._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" not in plan and "Python" not in plan


def test_faults_fail(spark, tmp_path, small_splits):
    path, header = _write(tmp_path, "open", ["1,plain,1", '2,"never closed,2', "3,x,3"])
    with pytest.raises(ValueError, match="no end"):
        scan_dump(spark, path, header)
    for name, bad in (("few", '1,"a\nb"'), ("many", '1,"a\nb",1,2'), ("kind", 'x,"a\nb",1')):
        path, header = _write(tmp_path, name, ["1,a,1"] * 50 + [bad])
        with pytest.raises(Exception, match="(?i)malformed"):
            scan_dump(spark, path, header).collect()
    empty, header = _write(tmp_path, "empty", [])
    assert scan_dump(spark, empty, header).count() == 0


def test_openings_are_a_prefix_per_file():
    splits = [("b", 0, 10, 2), ("a", 20, 10, 1), ("a", 0, 10, 3), ("a", 10, 10, 4)]
    assert split_openings(splits) == {("a", 0, 10): 0, ("a", 10, 10): 1, ("a", 20, 10): 1, ("b", 0, 10): 0}
