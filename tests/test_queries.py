"""Every registered query of the library against its SQL on the small tables."""

import decimal
import math
import os
import subprocess
import sys

import duckdb
import pytest

from sigloom import queries

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def oracle():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "NULL"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (int, float, decimal.Decimal)):
        return f"{float(v):.9g}"
    return str(v)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, oracle, name):
    df = queries.QUERIES[name](spark, DATA)
    got = df.collect()
    if name not in queries.SQL:
        assert len(df.columns) == len(set(df.columns))
        return
    want = oracle.sql(queries.SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    columns = sorted(df.columns)
    at = [want.columns.index(c) for c in columns]
    assert sorted(tuple(plain(r[c]) for c in columns) for r in got) == sorted(tuple(plain(r[k]) for k in at) for r in want.fetchall())


def test_nothing_but_the_entry_needs_the_corpus_package():
    code = "import sys; sys.modules['sigloom.llm'] = None; import __spark_entry__ as e; assert 'doc_signal_score' in e.queries(); assert not [n for n in e.queries() if n.startswith('op') and n[2].isdigit()]"
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True, timeout=120)
