import re
from pathlib import Path

import __spark_entry__ as entry

HERE = Path(entry.__file__).parent


def test_entry_has_rows(spark, root):
    assert entry.entry(spark).count() > 0


def test_sql_belongs_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_nothing_else_imports_the_subpackage():
    for path in (HERE / "leadflow").rglob("*.py"):
        if "llm" not in path.parts:
            assert not re.search(r"(?:from|import)\s+[\w.]*\bllm\b", path.read_text()), path
