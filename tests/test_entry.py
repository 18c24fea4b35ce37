import os
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as entry
from convolake.plans import data_queries, reference_queries
from tools_compare import TABLES, different

SMALL = "/root/testdata/sf0.001"
CORE = {**reference_queries.SQL, **data_queries.SQL}


def test_every_sql_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_core_needs_no_llm():
    code = "import sys; sys.modules['convolake.llm'] = None; import __spark_entry__ as e; assert not [q for q in e.queries() if q.startswith(('p1', 'p8'))]; print(len(e.queries()))"
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    assert subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True, check=True).stdout.strip() > "0"


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test data here")
@pytest.mark.parametrize("name", sorted(CORE))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    assert not different(entry.queries()[name](spark, SMALL).toPandas(), con.execute(CORE[name]).df())
