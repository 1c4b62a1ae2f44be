"""The driver's entry: the queries' SQL gives their rows, and everything works without the llm subpackage."""

import subprocess
import sys
from collections import Counter
from pathlib import Path

import pytest

from rulespark import queries

SF = "/root/testdata/sf0.001"
REPO = Path(__file__).parent.parent


@pytest.mark.parametrize("name", ["join_theta", "join_computed_key", "semi_existential", "merge_set_union", "delete_rows", "tc_conversation", "components_chain", "extract_cost", "map_ops"])
def test_queries_equal_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    got = queries.QUERIES[name](spark, SF)
    result = con.execute(queries.SQL[name])
    names = [c[0] for c in result.description]
    assert Counter(tuple(r) for r in got.select(*names).collect()) == Counter(result.fetchall())


def test_without_the_subpackage(tmp_path):
    import shutil

    shutil.copytree(REPO / "rulespark", tmp_path / "rulespark", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(REPO / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'tc_conversation' in q and not any(k.startswith('op') or k == 'pipeline' for k in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "HOME": "/root"})


def test_nothing_else_imports_the_subpackage():
    for p in (REPO / "rulespark").rglob("*.py"):
        if "llm" not in p.parts:
            assert "rulespark.llm" not in p.read_text(), p
