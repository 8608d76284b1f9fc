import importlib

import __spark_entry__


def test_entry_runs(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_nothing_outside_imports_the_optional_subpackage():
    from pathlib import Path

    root = Path(importlib.import_module("quernlake").__file__).parent
    outside = [p for p in root.rglob("*.py") if "llm" not in p.relative_to(root).parts]
    assert outside and not [p for p in outside if "quernlake.llm" in p.read_text()]
