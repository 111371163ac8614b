import os
import re

import duckdb
import pytest

from quadrill.llm import queries as q

SF = "/root/testdata/sf0.01"


def test_one_query_an_operator():
    assert sorted(int(re.match(r"op(\d+)_", name)[1]) for name in q.queries()) == list(range(1, 11))


@pytest.mark.parametrize("name", sorted(q.oracle_sql()))
def test_same_rows_as_sql(spark, name):
    con = duckdb.connect()
    for file in os.listdir(SF):
        con.execute(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{file}'")
    found = con.execute(q.oracle_sql()[name])
    columns = [d[0] for d in found.description]
    df = q.queries()[name](spark, SF)
    assert sorted(columns) == sorted(df.columns)
    assert sorted(tuple(r[c] for c in columns) for r in df.collect()) == sorted(found.fetchall())
