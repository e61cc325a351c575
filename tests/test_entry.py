"""The driver's contract."""

from __future__ import annotations

import re
from pathlib import Path

import __spark_entry__ as entry


def test_names_and_sql():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(entry.queries()) > 80


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


def test_the_library_does_not_import_its_subpackage():
    root = Path(entry.__file__).parent
    for p in (root / "evisim").rglob("*.py"):
        if "llm" not in p.relative_to(root).parts:
            assert not re.search(r"evisim\.llm|from \.+llm|corpus_pipeline", p.read_text()), p
