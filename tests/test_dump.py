import gzip
from decimal import Decimal

import pytest
from pyspark.sql import types as T

from pointlake.plans.dump_to_lake import dump_to_lake, prepared_dump
from pointlake.sources.dump import scan_dump
from pointlake.sources.schema import build_schema, column_type, normalize_type, read_sidecar


def _files(tmp_path, name, lines, fields, packed=False):
    csv = tmp_path / (f"{name}.csv.gz" if packed else f"{name}.csv")
    text = "\n".join(lines) + "\n"
    csv.write_bytes(gzip.compress(text.encode())) if packed else csv.write_text(text)
    header = tmp_path / f"{name}_header.csv"
    header.write_text("".join(f'{f},"{t}"\n' for f, t in fields))
    return str(csv), str(header)


@pytest.mark.parametrize(
    ("name", "expected"),
    [
        ("bigint", T.LongType()),
        (" Integer ", T.IntegerType()),
        ("smallint", T.ShortType()),
        ("real", T.FloatType()),
        ("double precision", T.DoubleType()),
        ("numeric", T.DecimalType(38, 18)),
        ("numeric(10,2)", T.DecimalType(10, 2)),
        ("numeric(7)", T.DecimalType(7, 0)),
        ("character varying(255)", T.StringType()),
        ("timestamp without time zone", T.TimestampNTZType()),
        ("timestamp(6) without time zone", T.TimestampNTZType()),
        ("timestamp with time zone", T.TimestampType()),
        ("USER-DEFINED", T.StringType()),
    ],
)
def test_column_type(name, expected):
    assert column_type(name) == expected


def test_unknown_type_lists_the_valid_ones():
    with pytest.raises(ValueError, match="geometry.*bigint"):
        column_type("geometry")
    assert normalize_type("Timestamp(6)  With Time Zone") == "timestamp with time zone"


def test_schema_keeps_booleans_as_text():
    schema = build_schema([("a", "boolean"), ("b", "bigint")])
    assert [f.dataType for f in schema] == [T.StringType(), T.LongType()]
    assert build_schema([("a", "boolean")], booleans_as_text=False)["a"].dataType == T.BooleanType()


FIELDS = [
    ("id", "bigint"),
    ("created", "timestamp without time zone"),
    ("valid", "boolean"),
    ("note", "text"),
    ("price", "numeric(10,2)"),
    ("seen", "timestamp with time zone"),
    ("reviewed", "boolean"),
]
LINES = [
    '1,2020-01-01 00:00:00.123456,t,"say ""hi"", ok",1.25,2020-01-01 00:00:00+00,t',
    '123456789012345678,2020-01-01 00:00:00,f,"",2.50,2020-06-01 10:00:00.5+00,f',
    "-3,,t,,,,x",
]


@pytest.mark.parametrize("packed", [False, True])
def test_scan_decodes_types_and_drops_bookkeeping(spark, tmp_path, packed):
    table = scan_dump(spark, *_files(tmp_path, "t", LINES, FIELDS, packed))
    assert table.columns == ["id", "note", "price", "seen", "reviewed"]
    rows = {r["id"]: r for r in table.collect()}
    assert rows[1]["note"] == 'say "hi", ok'
    assert rows[1]["price"] == Decimal("1.25")
    assert [rows[i]["reviewed"] for i in (1, 123456789012345678, -3)] == [True, False, None]
    # A quoted empty text stays empty, an unquoted one is null.
    assert rows[123456789012345678]["note"] == ""
    assert rows[-3]["note"] is None and rows[-3]["seen"] is None


@pytest.mark.parametrize("packed", [False, True])
@pytest.mark.parametrize("drop", [(), ("created",)])
def test_newline_in_quotes(spark, tmp_path, packed, drop):
    fields = [("id", "bigint"), ("note", "text"), ("created", "bigint")]
    table = scan_dump(spark, *_files(tmp_path, "n", ['1,"two\nlines",3', "2,x,4"], fields, packed), drop=drop)
    assert [(r["id"], r["note"]) for r in table.orderBy("id").collect()] == [(1, "two\nlines"), (2, "x")]
    assert table.count() == 2


@pytest.mark.parametrize("packed", [False, True])
@pytest.mark.parametrize("drop", [(), ("created",)])
@pytest.mark.parametrize("line", ["3,y", "4,z,5,7,8"])
def test_a_row_of_another_length_fails(spark, tmp_path, packed, drop, line):
    fields = [("id", "bigint"), ("note", "text"), ("created", "bigint")]
    table = scan_dump(spark, *_files(tmp_path, "l", ["1,a,2", line], fields, packed), drop=drop)
    for read in (table, table.select("id")):
        with pytest.raises(Exception, match="(?i)malformed"):
            read.collect()


def test_bad_value_fails(spark, tmp_path):
    files = _files(tmp_path, "b", ["1,x"], [("id", "bigint"), ("n", "integer")])
    with pytest.raises(Exception, match="(?i)malformed|x"):
        scan_dump(spark, *files).collect()


def test_sidecar_keeps_order(spark, tmp_path):
    _, header = _files(tmp_path, "s", [""], FIELDS)
    assert read_sidecar(spark, header) == FIELDS


def test_dump_to_lake_joins_decodes_and_partitions(spark, tmp_path):
    import struct

    def wkb(*p):
        return (struct.pack("<BI", 1, 0x80000001) + struct.pack("<3d", *p)).hex()

    table = _files(
        tmp_path,
        "syn",
        [f"{i},2020-01-01 00:00:00,{wkb(i, -i - 0.5, 2.9)},{i}.5" for i in range(20)],
        [("id", "bigint"), ("created", "timestamp without time zone"), ("pt_position", "USER-DEFINED"), ("size", "real")],
    )
    segment = _files(
        tmp_path,
        "seg",
        [f"{i},{i * 7},1.0" for i in range(0, 20, 2)],
        [("id", "bigint"), ("pt_root_id", "bigint"), ("size", "real")],
    )
    lake = dump_to_lake(
        spark, table, str(tmp_path / "lake"), n_partitions=4, segmentation=segment,
        zorder_columns=["pt_root_id", "id"], bloom_columns=["id"],
    )
    rows = {r["id"]: r for r in lake.collect()}
    assert len(rows) == 20
    assert rows[4]["pt_position"] == [4, -4, 2]
    assert (rows[4]["pt_root_id"], rows[4]["size_right"], rows[4]["pt_root_id_partition"]) == (28, 1.0, 0)
    assert rows[5]["pt_root_id"] is None and rows[5]["pt_root_id_partition"] is None
    with pytest.raises(ValueError, match="nope"):
        prepared_dump(spark, table, ["nope"], 4)


def test_points_are_joined_decoded(spark, tmp_path):
    """The join shuffles decoded points; those of the other table are decoded unless the join renames them."""
    import struct

    def wkb(*p):
        return (struct.pack("<BI", 1, 0x80000001) + struct.pack("<3d", *p)).hex()

    fields = [("id", "bigint"), ("pt_position", "USER-DEFINED")]
    table = _files(tmp_path, "syn", [f"{i},{wkb(i, 2, 3)}" for i in range(4)], fields)
    more = [*fields, ("pt_root_id", "bigint"), ("ctr_pt_position", "USER-DEFINED")]
    segment = _files(tmp_path, "seg", [f"1,{wkb(7, 8, 9)},5,{wkb(4, 5, 6)}"], more)
    rows = prepared_dump(spark, table, ["pt_root_id"], 4, segment)
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 2 and plan.index("Join") < plan.index("ArrowEvalPython")
    found = {r["id"]: r for r in rows.collect()}
    assert [found[i]["pt_position"] for i in range(4)] == [[i, 2, 3] for i in range(4)]
    assert found[1]["ctr_pt_position"] == [4, 5, 6] and found[2]["ctr_pt_position"] is None
    assert found[1]["pt_position_right"] == wkb(7, 8, 9)


def test_several_partition_columns(spark, tmp_path):
    files = _files(tmp_path, "m", ["1,10", "2,11", "3,12"], [("a", "bigint"), ("b", "bigint")])
    lake = dump_to_lake(spark, files, str(tmp_path / "m-lake"), ["a", "b"], 2)
    found = sorted((r["a"], r["a_partition"], r["b_partition"]) for r in lake.collect())
    assert found == [(1, 1, 0), (2, 0, 1), (3, 1, 0)]
