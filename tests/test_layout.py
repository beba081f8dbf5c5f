"""The optional subpackage stays optional."""

import ast
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def imports(path: Path) -> set[str]:
    found = set()
    for n in ast.walk(ast.parse(path.read_text())):
        if isinstance(n, ast.Import):
            found |= {a.name for a in n.names}
        elif isinstance(n, ast.ImportFrom):
            found |= {n.module or "", *[f"{n.module}.{a.name}" for a in n.names]}
    return found


def test_nothing_else_imports_the_optional_part():
    for path in [*ROOT.glob("lakeloom/**/*.py"), ROOT / "bench.py"]:
        if "llm" not in path.relative_to(ROOT).parts:
            assert not any(n.startswith(("lakeloom.llm", "corpus_pipeline")) for n in imports(path)), path


def test_every_query_has_a_name_of_its_own():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert "hybrid_rrf" in entry.queries()


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns[:4] == ["q", "rank", "key", "score"]
