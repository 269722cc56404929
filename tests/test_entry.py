import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry

ROOT = Path(__file__).parent.parent


def test_every_sql_has_a_query_and_entry_gives_rows(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).limit(1).count() == 1


def test_nothing_outside_imports_the_subpackage():
    for p in (ROOT / "strandloom").rglob("*.py"):
        if "llm" not in p.relative_to(ROOT / "strandloom").parts:
            assert "strandloom.llm" not in p.read_text(), p


def test_entry_without_the_subpackage(tmp_path):
    code = f"import sys; sys.path.insert(0, {str(ROOT)!r}); sys.modules['strandloom.llm'] = None; import __spark_entry__ as e; assert 'p3_found' in e.queries() and 'p9_found' not in e.queries()"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=tmp_path)
