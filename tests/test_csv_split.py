"""CSV files read in splits, against the reader that takes a file as one, and type inference against plain Python."""

import datetime as dt
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import types as T

from revlens.sources.csv_split import csv_records, infer_types, open_behind, scan_csv_inferred, scan_csv_split
from revlens.sources.files import NA_TOKENS, scan_csv, sink_csv_overwrite

HEADER = "id,name,note\n"


@pytest.fixture
def small_splits(spark):
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")

    def set_(n):
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(n))
    yield set_
    spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def rows_of(df):
    return Counter(map(tuple, df.collect()))


def quoted(rng, longest):
    pieces = ["a", "b,", '""', "\n", " ", "xyz", "\r\n", "é", ",\n", '"",""', "1"]
    return '"' + "".join(rng.choice(pieces) for _ in range(rng.randint(0, longest))) + '"'


def csv_text(rng, n, longest=12):
    plain = ["", "word", "5'4\" tall", " \"odd\" blanks", "NA", "x y", "12", "\ttab"]
    field = lambda: quoted(rng, longest) if rng.random() < 0.5 else rng.choice(plain)
    return HEADER + "".join(f"{i},{field()},{field()}\n" + ("\n" if rng.random() < 0.05 else "") for i in range(n))


@pytest.mark.parametrize("size", [150, 500])
def test_equals_the_reader_of_whole_files(spark, tmp_path, small_splits, size):
    rng = random.Random(size)
    for name in ("one", "two", "three"):
        (tmp_path / f"{name}.csv").write_bytes(csv_text(rng, 40).encode())
    want = rows_of(scan_csv(spark, str(tmp_path)))
    small_splits(size)
    assert rows_of(scan_csv_split(spark, str(tmp_path))) == want
    if size == 150:
        assert csv_records(spark, str(tmp_path)).select("f", "s").distinct().count() > 6


def test_one_record_over_many_splits(spark, tmp_path, small_splits):
    long = "\n".join(f"line {i} with \"\"marks\"\", and commas" for i in range(40))
    (tmp_path / "a.csv").write_text(f'{HEADER}1,first,"{long}"\n2,"second","{long}\n"\n3,x,y')
    want = rows_of(scan_csv(spark, str(tmp_path)))
    small_splits(400)
    got = scan_csv_split(spark, str(tmp_path))
    assert rows_of(got) == want and got.count() == 3


def test_header_alone_crosses_borders(spark, tmp_path, small_splits):
    (tmp_path / "a.csv").write_text('\n"a ""long""\nname","second\n\n\ncolumn"\n1,2\n3,4\n')
    small_splits(12)
    got = scan_csv_split(spark, str(tmp_path))
    assert got.columns == scan_csv(spark, str(tmp_path)).columns
    assert rows_of(got) == Counter([("1", "2"), ("3", "4")])


def test_line_ends_marks_and_empty_files(spark, tmp_path, small_splits):
    (tmp_path / "a.csv").write_bytes("﻿id,name,note\r\n1,a,\"b\r\nc\"\r\n2,,NA\r\n".encode())
    small_splits(9)
    assert rows_of(scan_csv_split(spark, str(tmp_path))) == rows_of(scan_csv(spark, str(tmp_path)))
    none = tmp_path / "none"
    none.mkdir()
    (none / "b.csv").write_text(HEADER)
    assert scan_csv_split(spark, str(none)).count() == 0


def test_schema_is_bound_by_name(spark, tmp_path):
    (tmp_path / "a.csv").write_text("b,a\nx,1\n\"y\nz\",oops\n")
    schema = T.StructType([T.StructField("a", T.LongType()), T.StructField("c", T.StringType()), T.StructField("b", T.StringType())])
    assert rows_of(scan_csv_split(spark, str(tmp_path), schema)) == Counter([(1, None, "x"), (None, None, "y\nz")])


def test_written_rows_come_back(spark, tmp_path, small_splits):
    df = spark.range(100).selectExpr("id", "concat('q\"', id, '\n,', repeat('t', cast(id % 9 as int))) as t")
    sink_csv_overwrite(df.coalesce(1), f"{tmp_path}/x")
    small_splits(400)
    assert rows_of(scan_csv_split(spark, f"{tmp_path}/x", df.schema)) == rows_of(df)


def test_maps_in_bulk_equal_one_by_one():
    rng = np.random.default_rng(1)
    for _ in range(200):
        n = int(rng.integers(1, 30))
        to0, to1 = rng.random(n) < 0.3, rng.random(n) < 0.6
        for state in (False, True):
            now, want = state, []
            for a, b in zip(to0, to1):
                now = bool(b if now else a)
                want.append(now)
            assert open_behind(to0, to1, state).tolist() == want


def test_long_lines_do_not_recurse(spark, tmp_path):
    many = ",".join(["x"] * 60_000)
    (tmp_path / "a.csv").write_text(f'{HEADER}1,a,"{many}\n{many}"\n2,b,"' + '"" ' * 20_000 + '"\n')
    got = {r.id: r.note for r in scan_csv_split(spark, str(tmp_path)).collect()}
    assert got["1"] == f"{many}\n{many}" and got["2"].count('"') == 20_000


# ------------------------------------------------------------------ types

def kind_of(values):
    """Brute force: the first type that every value has."""
    values = [v for v in values if v is not None and v not in NA_TOKENS]

    def is_long(v):
        return re.fullmatch(r"\s*[+-]?[0-9]+\s*", v) is not None and -2**63 <= int(v) < 2**63

    def is_double(v):
        return re.fullmatch(r"\s*[+-]?(([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?|(?i:inf|infinity))\s*", v) is not None

    def is_time(v):
        m = re.fullmatch(r"(\d{4})-(\d{1,2})-(\d{1,2})([ T](\d{1,2}):(\d\d)(:(\d\d)(\.\d{1,6})?)?)?", v)
        if not m:
            return False
        try:
            dt.datetime(*(int(m[i]) for i in (1, 2, 3)), *(int(m[i] or 0) for i in (5, 6, 8)))
        except ValueError:
            return False
        return True
    tests = [("boolean", lambda v: v in ("True", "TRUE", "true", "False", "FALSE", "false")), ("bigint", is_long),
             ("double", is_double), ("timestamp_ntz", is_time)]
    return next((name for name, fits in tests if values and all(map(fits, values))), "string")


def test_inference_equals_brute_force(spark):
    rng = random.Random(4)
    pools = [["True", "false", "TRUE", ""], ["1", "-2", "+3", " 4 ", "007", "NA"], ["1", "2.5", "1e9", ".5", "7.", "-inf"],
             ["9223372036854775807", "9223372036854775808"], ["2024-01-31", "2024-1-3 4:05", "2024-02-29T10:00:00.25", "nan"],
             ["2023-02-29", "2024-01-01"], ["1", "true"], ["2024", "2024-01-01"], ["", "NA", "null"], ["1.0f", "2d"],
             ["12:30", "10"], ["0x10", "1"], ["text", "1"], ["1_000"], ["٣"], ["1e400", "1"]]
    cols = [[rng.choice(p + [None]) for _ in range(60)] for p in pools]
    names = [f"c {i}" for i in range(len(pools))]
    df = spark.createDataFrame(list(zip(*cols)), T.StructType([T.StructField(n, T.StringType()) for n in names])).repartition(5)
    assert [f.dataType.simpleString() for f in infer_types(df)] == [kind_of(c) for c in cols]


def test_the_only_text_stands_in_the_last_row(spark, tmp_path, small_splits):
    (tmp_path / "a.csv").write_text("a,b,c,d\n" + "".join(f"{i},{i}.5,true,2024-01-0{i % 9 + 1}\n" for i in range(400)) + "x,1,true,\n")
    small_splits(4000)
    got = scan_csv_inferred(spark, str(tmp_path))
    assert [f.dataType.simpleString() for f in got.schema] == ["string", "double", "boolean", "timestamp_ntz"]
    assert got.count() == 401 and got.where("d is null").count() == 1
    assert infer_types(got.limit(0).select("a")).simpleString() == "struct<a:string>"
