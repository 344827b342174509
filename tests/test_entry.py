import importlib.util
from pathlib import Path

import __spark_entry__ as entry
from lattica.queries import ORACLE, QUERIES


def test_flagship(spark):
    got = entry.entry(spark)
    assert got.columns == ["person", "label", "courtesyNode", "courtesyLabel", "courtesyName"] and got.count() == 10


def test_registry():
    known, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(known) and set(QUERIES) <= set(known)
    assert set(ORACLE) == set(QUERIES)
    if importlib.util.find_spec("lattica.llm"):
        found = {int(n[2:].split("_")[0]) for n in known if n.startswith("op")}
        assert found == set(range(1, 14)) and "pipeline" in known


def test_nothing_else_imports_the_llm_subpackage():
    root = Path(entry.__file__).parent
    for file in (root / "lattica").rglob("*.py"):
        if "llm" not in file.relative_to(root / "lattica").parts:
            assert "lattica.llm" not in file.read_text(encoding="utf-8")
