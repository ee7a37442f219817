"""The llm queries on the smallest tables: columns, repeats, SQL twins."""

import glob
import os

import duckdb
import pytest

from paperloom.llm.queries import QUERIES, SQL

DIR = "/root/testdata/sf0.001"
COLUMNS = {
    "p1_found": [("src", "string"), ("id_a", "bigint"), ("id_b", "bigint")], "p2_found": [("src", "string"), ("record_id", "bigint"), ("org_id", "bigint")], "p3_found": [("arm_id", "bigint")], "p4_found": [("inspection_id", "bigint"), ("line_no", "int"), ("noise", "string")],
    "p7_found": [("inspection_id", "bigint"), ("pii_kind", "string"), ("surface", "string")], "p8_ids": [("doc_id", "bigint"), ("ids", "array<int>")], "p9_found": [("doc_id", "bigint"), ("item_id", "bigint")], "p10_found": [("doc_id", "bigint"), ("sent_end", "int")],
}

pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="needs the test tables")


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, name):
    df = QUERIES[name](spark, DIR)
    rows = [tuple(map(str, r)) for r in df.collect()]
    assert rows
    if name in COLUMNS:
        assert df.dtypes == COLUMNS[name]
        assert len(set(rows)) == len(rows)
    if name in SQL:
        con = duckdb.connect()
        for path in glob.glob(f"{DIR}/*.parquet"):
            con.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
        assert sorted(rows) == sorted(tuple(map(str, r)) for r in con.execute(SQL[name]).fetchall())
