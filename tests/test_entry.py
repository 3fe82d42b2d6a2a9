"""The driver's contract, with and without the corpus operators."""

import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__

ROOT = Path(__file__).resolve().parent.parent
TABLES = "region nation customer supplier part orders lineitem events".split()
SF = Path("/root/testdata/sf0.001")
SOME = ["find_vertices_filter", "find_vertex_by_id", "update_vertex_merge", "delete_vertex_detach", "neighbors_both_d2", "degree_all", "bfs_capped", "dfs_tree_order", "agtype_parse", "cypher_literal", "two_hop_pattern"]


def test_names():
    queries, oracles = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(oracles) <= set(queries) and len(queries) >= 50


@pytest.mark.skipif(not SF.exists(), reason="no test tables")
@pytest.mark.parametrize("name", SOME)
def test_against_sql(spark, name):
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = __spark_entry__.queries()[name](spark, str(SF))
    told = db.execute(__spark_entry__.oracle_sql()[name])
    columns = [d[0] for d in told.description]
    assert sorted(columns) == sorted(df.columns)
    assert sorted(map(repr, map(tuple, df.select(*columns).collect()))) == sorted(map(repr, told.fetchall()))


@pytest.mark.skipif(not SF.exists(), reason="no test tables")
def test_entry(spark):
    assert __spark_entry__.entry(spark).columns == ["vertex_id", "score"]


def test_without_corpus_operators(tmp_path):
    shutil.copytree(ROOT / "lattica", tmp_path / "lattica", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert len(q) >= 50 and o and not any(n.startswith('op') or n == 'pipeline' for n in q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin"})
