"""Every query beside its SQL on the smallest tables, and the entry without the optional parts."""

import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pandas as pd
import pytest

from rasterloom.plans.queries import ORACLE_SQL, QUERIES

ROOT = Path(__file__).resolve().parent.parent
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(small):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{small}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, small, con, name):
    got = QUERIES[name](spark, small).toPandas()
    if name not in ORACLE_SQL:
        assert len(got)
        return
    sql = con.execute(ORACLE_SQL[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(sql.columns)
    tidy = lambda t: t[columns].astype(object).where(t[columns].notna(), None).sort_values(columns, ignore_index=True)
    pd.testing.assert_frame_equal(tidy(got), tidy(sql), check_dtype=False)


def union_find(edges):
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            up[x] = x = up[up[x]]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {x: find(x) for x in list(up)}


def test_component_queries_beside_union_find(spark, small):
    edges = QUERIES["edge_weights8"](spark, small).where("w <= 60").toPandas()
    near = union_find(zip(edges.a.tolist(), edges.b.tolist()))
    got = QUERIES["connected_components_edges"](spark, small).toPandas()
    assert dict(zip(got.node, got.component)) == near
    cells = QUERIES["ms_cluster"](spark, small).toPandas()
    valid = QUERIES["valid_mask"](spark, small).where("valid").toPandas()
    assert {(x.r, x.c): x.segment_id for x in cells.itertuples()} == {(x.r, x.c): near.get(x.r * 100 + x.c, x.r * 100 + x.c) for x in valid.itertuples()}


@pytest.mark.parametrize("gone", [["llm", "corpus_pipeline.py"], ["llm"]])
def test_entry_without_the_optional_parts(tmp_path, gone):
    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", "spark-warehouse", *gone))
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert q and set(o) <= set(q) and 'pipeline' not in q and not any(n.startswith('op1_') for n in q); print(len(q))"
    done = subprocess.run([sys.executable, "-B", "-c", code], cwd=copy, capture_output=True, text=True, env={"PATH": "/usr/bin:/bin", "HOME": str(tmp_path)}, timeout=120)
    assert done.returncode == 0, done.stderr


def test_errors_inside_the_optional_parts_are_errors(tmp_path):
    if not (ROOT / "rasterloom" / "llm").exists():
        pytest.skip("no optional parts here")
    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", "spark-warehouse"))
    broken = copy / "rasterloom" / "llm" / "queries.py"
    broken.write_text("import a_module_that_is_not_there\n" + broken.read_text().replace("from __future__ import annotations\n", ""))
    done = subprocess.run([sys.executable, "-B", "-c", "import __spark_entry__ as e; e.queries()"], cwd=copy, capture_output=True, text=True, env={"PATH": "/usr/bin:/bin", "HOME": str(tmp_path)}, timeout=120)
    assert done.returncode != 0 and "a_module_that_is_not_there" in done.stderr
