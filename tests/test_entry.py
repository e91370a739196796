"""The driver contract, with and without the corpus subpackage."""

import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_names():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries()) and "pipeline_w1" in entry.queries()


def test_without_corpus_operators():
    """The rest imports and keeps its queries when the subpackage cannot be imported."""
    code = "import sys; sys.modules['logloom.llm'] = None; import __spark_entry__ as e; assert 'parse_auth' in e.queries() and not any(k.startswith('op') for k in e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, timeout=120)


def test_nothing_else_imports_the_subpackage():
    for path in (ROOT / "logloom").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT / "logloom").parts[:1]:
            assert "logloom.llm" not in path.read_text()


def test_smoke(spark, monkeypatch):
    import __spark_entry__ as entry

    rows = entry.entry(spark).collect()
    assert rows and set(rows[0].asDict()) == {"source", "event_type", "severity", "n"}
