"""Core queries on the smallest tables against their SQL twins."""

import decimal
import glob
import os

import duckdb
import pytest

import __spark_entry__ as driver

DIR = "/root/testdata/sf0.001"
CORE = [n for n, q in driver.queries().items() if not q.__module__.startswith("paperloom.llm")]
SQL = driver.oracle_sql()

pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="needs the test tables")


def _norm(v):
    if isinstance(v, (float, decimal.Decimal)):
        return round(float(v), 6)
    return v if v is None or isinstance(v, (bool, int)) else str(v)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{DIR}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return con


@pytest.mark.parametrize("name", CORE)
def test_query(spark, duck, name):
    df = driver.queries()[name](spark, DIR)
    columns = sorted(df.columns)
    rows = sorted(repr(tuple(_norm(r[c]) for c in columns)) for r in df.collect())
    if name in SQL:
        result = duck.execute(SQL[name])
        names = [d[0] for d in result.description]
        assert sorted(names) == columns
        order = [names.index(c) for c in columns]
        assert rows == sorted(repr(tuple(_norm(r[i]) for i in order)) for r in result.fetchall())


def test_entry(spark):
    assert driver.entry(spark).count() > 0


def test_collected_files(spark, tmp_path):
    """Two lists that differ come out whole and in order, beyond twelve paths too."""
    rows = [(n, f"f{n:02}.pdf", n < 15) for n in range(40)] + [(3, "f03.pdf", True), (50, None, True), (51, "f00.pdf", False)]
    spark.createDataFrame(rows, "inspection_id bigint, source_description string, used_ocr_fallback boolean").write.parquet(f"{tmp_path}/inspections.parquet")
    spark.createDataFrame([(n,) for n in (10, 30, 30, 31, 50, 51)], "inspection_id bigint").write.parquet(f"{tmp_path}/blocks.parquet")
    made = [r.path for r in driver.queries()["collected_files"](spark, str(tmp_path)).collect()]
    assert made == [f"f{n:02}.pdf" for n in (*range(15), 30, 31)]
    assert [r.path for r in driver.queries()["file_union"](spark, str(tmp_path)).collect()] == made[:12]
