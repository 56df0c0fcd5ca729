"""Every query with SQL against DuckDB on the smallest tables; those without SQL must run and keep their columns."""

import os
from pathlib import Path

import duckdb
import pytest

import tessera.queries as core

DATA = os.environ.get("TESSERA_TEST_DATA", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="no test tables")


def same(a, b):
    def norm(df):
        out = []
        for row in df[sorted(df.columns)].itertuples(index=False):
            out.append(tuple("~" if v is None or v != v else f"{float(v):.8g}" if isinstance(v, (int, float)) or hasattr(v, "dtype") and v.dtype.kind in "fiu" else str(v) for v in row))
        return sorted(out)

    assert sorted(a.columns) == sorted(b.columns)
    assert norm(a) == norm(b)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("set timezone='UTC'")
    for f in Path(DATA).glob("*.parquet"):
        con.sql(f"create view {f.stem} as select * from '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(core.oracle_sql()))
def test_against_sql(spark, duck, name):
    same(core.queries()[name](spark, DATA).toPandas(), duck.sql(core.oracle_sql()[name]).df())


@pytest.mark.parametrize("name", sorted(set(core.queries()) - set(core.oracle_sql())))
def test_runs(spark, name):
    assert core.queries()[name](spark, DATA).count() > 0


@pytest.mark.parametrize("name", ["field_boost_keyword", "filled_topk", "bm25_overlap_rerank"])
def test_lists_of_the_best_do_without_all_pairs(spark, monkeypatch, name):
    from tessera.operators import lexical

    monkeypatch.delattr(lexical, "bm25")
    assert core.queries()[name](spark, DATA).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_core_does_not_import_the_subpackage():
    for f in (Path(core.__file__).parent).rglob("*.py"):
        if "llm" not in f.parts:
            assert "tessera.llm" not in f.read_text(), f
