"""Every query with an oracle, against DuckDB on the smallest driver tables."""

import os

import duckdb
import numpy as np
import pandas as pd
import pytest

from strataline import catalog

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no driver tables")
QUERIES, ORACLE = catalog.queries(), catalog.oracle_sql()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        path = f"{DATA}/{t}.parquet"
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path + '/*.parquet' if os.path.isdir(path) else path}')")
    return c


def plain(x):
    if isinstance(x, (list, np.ndarray)):
        return "[" + ",".join(map(plain, x)) + "]"
    if x is None or x is pd.NaT or x is pd.NA or (isinstance(x, float) and np.isnan(x)):
        return "null"
    if isinstance(x, (bool, np.bool_)):
        return str(bool(x))
    if isinstance(x, (int, np.integer)):
        return str(int(x))
    if isinstance(x, (float, np.floating)):
        return repr(round(float(x), 9)).removesuffix(".0")
    return pd.Timestamp(x).isoformat() if hasattr(x, "isoformat") else str(x)


def rows(frame):
    columns = sorted(frame.columns)
    return columns, sorted(tuple(plain(v) for v in r) for r in frame[columns].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_oracle(spark, con, name):
    assert rows(QUERIES[name](spark, DATA).toPandas()) == rows(con.execute(ORACLE[name]).df())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_runs_twice_alike(spark, name):
    first, second = (rows(QUERIES[name](spark, DATA).toPandas()) for _ in range(2))
    assert first == second and first[1]


def test_revision_dates_of_every_page(spark, con):
    listed, probed = (QUERIES[f"sc06_{x}"](spark, DATA).toPandas() for x in ("revision_dates", "revision_date_probes"))
    pages = con.execute("SELECT DISTINCT o_custkey FROM orders WHERE CAST(o_orderdate AS DATE) BETWEEN DATE '1996-01-01' AND DATE '1999-12-31'").df()
    assert len(probed) and not set(listed["page"]) & set(probed["page"])
    assert set(listed["page"]) | set(probed["page"]) == set(pages["o_custkey"])
    assert probed.groupby("page").size().max() <= 20


def test_blocks_of_odd_texts(spark, tmp_path):
    """Digits and spaces at the edges of lines, other space separators, lines of tabs alone."""
    line = "a line of nineteen."
    texts = [None, "", " " * 25, f"  {line}  ", f"{line} x", f"10 {line} 0", "\n".join(f"{k}{line}" for k in range(12)), f" {line}　", "\t" * 20, f"{line}x\n{' ' * 20}\n{line}x", f"{line}x\n{chr(9) * 20}\n\n{line}x", f"{line}x\r\n\x0b{line}"]
    pd.DataFrame({"doc_id": range(len(texts)), "text": texts}).to_parquet(f"{tmp_path}/documents.parquet")
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet')")
    got = rows(QUERIES["fn13_blocks"](spark, str(tmp_path)).toPandas())
    assert got == rows(c.execute(ORACLE["fn13_blocks"]).df())
    assert [n for _, n in sorted(got[1], key=lambda r: int(r[0]))] == ["null", "0", "0", "0", "1", "1", "12", "0", "1", "2", "3", "2"]
