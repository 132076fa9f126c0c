"""Every check query with SQL agrees with another engine on the smallest tables."""

import decimal
import glob
import os

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

import __spark_entry__ as entry

NAMES = sorted(set(entry.queries()) & set(entry.oracle_sql()))


@pytest.fixture(scope="module")
def duck(data):
    c = duckdb.connect()
    for f in glob.glob(f"{data}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from read_parquet('{f}/*.parquet')" if os.path.isdir(f) else f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


def rows(table):
    """(column names, sorted rows) of an Arrow table: whole numbers and times exact, only true doubles rounded."""

    def plain(x):
        if isinstance(x, float):
            return None if x != x else float(f"{x:.9g}")
        if isinstance(x, decimal.Decimal):
            return int(x) if x == x.to_integral_value() else float(f"{x:.9g}")
        return x

    cols = sorted(table.column_names)
    return cols, sorted(zip(*([plain(x) for x in table.column(c).to_pylist()] for c in cols), strict=True), key=repr)


@pytest.mark.parametrize("name", NAMES)
def test_same_as_sql(spark, duck, data, name):
    a, x = rows(entry.queries()[name](spark, data).toArrow())
    b, y = rows(duck.execute(entry.oracle_sql()[name]).to_arrow_table())
    assert a == b
    assert x == y


def test_large_directories_are_covered_as_in_sql(spark, tmp_path):
    """A directory of more than 10 000 names, the operator's bound, which the SQL does not have."""
    n = 10_100
    ids = [i // 10 * 100 + (2, 3, 4, 6, 7, 8, 12, 13, 14, 18)[i % 10] for i in range(n)]
    table = {"doc_id": pa.array(ids, pa.int64()), "text": ["t"] * n, "lang": ["en"] * n, "source": ["s"] * n, "n_chars": pa.array([1] * n, pa.int64())}
    pq.write_table(pa.table(table), tmp_path / "documents.parquet")
    c = duckdb.connect()
    c.execute(f"create view documents as select * from '{tmp_path}/documents.parquet'")
    got = rows(entry.queries()["p19_directory_coverage"](spark, str(tmp_path)).toArrow())
    assert got == rows(c.execute(entry.oracle_sql()["p19_directory_coverage"]).to_arrow_table())
    assert got == (["covered", "n", "root_id", "scope"], [(True, n, "root0", "/en")])


def test_a_microsecond_is_seen():
    at = [1709999603000000, None]
    one, other = (pa.table({"t": pa.array([at[0] + k, at[1]], pa.int64())}) for k in (0, 1))
    assert rows(one) == rows(one) and rows(one) != rows(other)


def test_entry(spark, data):
    assert entry.entry(spark).head(1)
