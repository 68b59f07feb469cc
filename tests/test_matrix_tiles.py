"""The matrix as text in tiles: nulls, several tiles, uneven lengths, plain lines."""
import pytest

from assay_spark.operators.reshape import numbered, transpose_tiles
from assay_spark.sources.files import read_matrix, write_matrix


@pytest.mark.parametrize("tile", [1, 2, 7, 4096])
def test_roundtrip_with_nulls(spark, tmp_path, tile):
    rows = [(10 * k, [None if (k + j) % 3 == 0 else k + j / 8 for j in range(5)]) for k in range(23)]
    df = spark.createDataFrame(rows, "id bigint, x array<double>").repartition(4)
    write_matrix(df, str(tmp_path / "m"), "id", "x", tile)
    got = read_matrix(spark, str(tmp_path / "m")).orderBy("sample").collect()
    assert [(r["sample"], r["x"]) for r in got] == [(k, v) for k, (_, v) in enumerate(rows)]


def test_no_group_is_longer_than_a_tile(spark):
    df = spark.createDataFrame([(k, [1.0 * k, 2.0 * k]) for k in range(50)], "id int, x array<double>")
    got = {(r["row_id"], r["start"]): r["x"] for r in transpose_tiles(df, "id", "x", 8).collect()}
    assert len(got) == 14 and max(map(len, got.values())) == 8
    assert got[1, 48] == [96.0, 98.0]


def test_missing_entries_are_null(spark, tmp_path):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, [3.0]), (3, [None, 6.0])], "id int, x array<double>")
    write_matrix(df, str(tmp_path / "m"), "id", "x")
    assert [r["x"] for r in read_matrix(spark, str(tmp_path / "m")).orderBy("sample").collect()] == [[1.0, 2.0], [3.0, None], [None, 6.0]]


def test_plain_lines(spark, tmp_path):
    (tmp_path / "m.txt").write_text("1,3.5,,-1\n0,1,2,nan\n\n")
    got = read_matrix(spark, str(tmp_path / "m.txt")).orderBy("sample").collect()
    assert [r["x"] for r in got[:2]] == [[1.0, 3.5], [2.0, None]] and got[2]["x"][1] == -1.0


def test_positions(spark):
    df = spark.range(1000).selectExpr("id * 7 % 1009 AS id").repartition(9)
    got = sorted((r["id"], r["_pos"]) for r in numbered(df, "id").collect())
    assert [p for _, p in got] == list(range(1000))
    assert numbered(df.limit(0), "id").count() == 0
