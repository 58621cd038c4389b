import glob
import os

import duckdb
import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def sf():
    if not os.path.isdir(SF):
        pytest.skip("no test tables")
    return SF


@pytest.fixture(scope="session")
def con(sf):
    c = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


ODD = "doc_id long, text string, lang string, source string, n_chars long, score string, component_id int"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty and long texts, repeats, ties and columns whose names clash with results."""
    long = "abc déf 12 " * 3000
    rows = [(1, None), (2, ""), (3, "  \n\t "), (4, "Hello World again and again"), (4, "Hello World again and again"), (5, long), (None, "orphan text here"), (6, "x" * 9000), (7, "12345 !!! ..."), (8, "hello world AGAIN and again")]
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "clash", 0) for i, t in rows], ODD)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], ODD)
