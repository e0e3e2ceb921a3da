"""The entry module with and without the folders that may be taken away."""

import pathlib
import shutil
import subprocess
import sys

ROOT = pathlib.Path(__file__).resolve().parents[1]


def _import(folder):
    code = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), any(k.startswith('op') for k in e.queries()))"
    return subprocess.run([sys.executable, "-c", code], cwd=folder, capture_output=True, text=True, timeout=120)


def _copy(tmp_path, *left_out):
    target = tmp_path / "repo"
    target.mkdir()
    shutil.copy(ROOT / "__spark_entry__.py", target)
    shutil.copytree(ROOT / "cadenza", target / "cadenza", ignore=shutil.ignore_patterns("__pycache__", *left_out))
    if (ROOT / "corpus_pipeline.py").exists():
        shutil.copy(ROOT / "corpus_pipeline.py", target)
    return target


def test_entry_imports_without_the_text_folder(tmp_path):
    done = _import(_copy(tmp_path, "llm"))        # corpus_pipeline.py, if there, stays
    assert done.returncode == 0, done.stderr
    n, n_sql, has_text = done.stdout.split()
    assert int(n) >= 31 and n == n_sql and has_text == "False"


def test_entry_raises_errors_inside_a_module(tmp_path):
    target = _copy(tmp_path, "llm")
    (target / "cadenza" / "llm").mkdir()
    (target / "cadenza" / "llm" / "__init__.py").write_text("")
    (target / "cadenza" / "llm" / "queries.py").write_text("import a_module_that_is_not_there\n")
    done = _import(target)
    assert done.returncode != 0 and "a_module_that_is_not_there" in done.stderr
