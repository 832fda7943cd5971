import ast
import pathlib
import subprocess
import sys

ROOT = pathlib.Path(__file__).resolve().parent.parent


def test_nothing_else_imports_the_training_data_operators():
    for path in (ROOT / "textloom").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT).parts:
            for node in ast.walk(ast.parse(path.read_text(encoding="utf-8"))):
                names = [a.name for a in node.names] if isinstance(node, ast.Import | ast.ImportFrom) else []
                names += [node.module or ""] if isinstance(node, ast.ImportFrom) else []
                assert not any("llm" in name.split(".") for name in names), path


def test_entry_imports_without_them(tmp_path):
    """A copy of the repository without the operators' folder and the pipeline still has its other queries."""
    code = f"import sys; sys.path.insert(0, {str(tmp_path)!r}); import __spark_entry__ as e; q = e.queries(); assert q and not any(k.startswith('op') for k in q) and 'pipeline' not in q; e.oracle_sql()"
    (tmp_path / "__spark_entry__.py").write_text((ROOT / "__spark_entry__.py").read_text(encoding="utf-8"), encoding="utf-8")
    for path in (ROOT / "textloom").rglob("*.py"):
        at = path.relative_to(ROOT)
        if "llm" not in at.parts:
            (tmp_path / at).parent.mkdir(parents=True, exist_ok=True)
            (tmp_path / at).write_text(path.read_text(encoding="utf-8"), encoding="utf-8")
    subprocess.run([sys.executable, "-c", code], check=True, cwd=tmp_path, env={"PATH": "/usr/bin:/bin"})
