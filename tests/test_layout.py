import ast
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def imports(path):
    for node in ast.walk(ast.parse(path.read_text())):
        if isinstance(node, ast.Import):
            yield from (a.name for a in node.names)
        elif isinstance(node, ast.ImportFrom):
            yield f"{'.' * node.level}{node.module or ''}"


def test_nothing_else_imports_the_operators():
    for path in (ROOT / "factloom").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT).parts:
            assert not any("llm" in name for name in imports(path)), path


def test_entry_works_without_the_operators(tmp_path):
    for name in ("__spark_entry__.py", "factloom"):
        source = ROOT / name
        if source.is_dir():
            for path in source.rglob("*.py"):
                to = tmp_path / path.relative_to(ROOT)
                if "llm" not in to.relative_to(tmp_path).parts:
                    to.parent.mkdir(parents=True, exist_ok=True)
                    to.write_text(path.read_text())
        else:
            (tmp_path / name).write_text(source.read_text())
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 45 and 'pipeline' not in q; assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=120, env={"PATH": "/usr/bin:/bin"})


def test_every_oracle_has_a_query():
    sys.path.insert(0, str(ROOT))
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
