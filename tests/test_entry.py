import importlib
import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry

ROOT = Path(__file__).resolve().parent.parent


def test_queries_and_sql_go_together():
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and all(callable(f) for f in queries.values()) and len(queries) > 80


def test_core_stands_without_the_optional_subpackage():
    code = "import sys; sys.modules['pixelgrove.llm'] = None; import __spark_entry__ as e; assert 'best_split' in e.queries() and not any(q.startswith('p1_') for q in e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)


def test_only_the_subpackage_names_itself():
    for f in (ROOT / "pixelgrove").rglob("*.py"):
        if "llm" not in f.relative_to(ROOT).parts:
            assert "llm" not in f.read_text(), f


def test_every_module_imports():
    for f in (ROOT / "pixelgrove").rglob("*.py"):
        importlib.import_module(".".join(f.relative_to(ROOT).with_suffix("").parts).removesuffix(".__init__"))


def test_flagship(spark):
    if Path("/root/testdata/sf0.001").exists():
        row = entry.entry(spark).collect()
        assert len(row) == 1 and row[0].gain > 0
