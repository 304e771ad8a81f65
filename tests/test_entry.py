import os
import re
import shutil
import subprocess
import sys

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_every_sql_has_a_query():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_works_without_the_training_data_operators(tmp_path):
    shutil.copytree(f"{REPO}/strandlake", tmp_path / "strandlake", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{REPO}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); s = e.oracle_sql(); print(len(q), sum(n.startswith('op') or n == 'pipeline' for n in [*q, *s]))"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=os.environ | {"PYTHONPATH": ""}, capture_output=True, text=True)
    n, own = map(int, out.stdout.split())
    assert n > 50 and own == 0, out.stderr


def test_nothing_else_imports_them():
    for folder, _, files in os.walk(f"{REPO}/strandlake"):
        if f"{os.sep}llm" not in folder:
            for f in files:
                if f.endswith(".py"):
                    with open(os.path.join(folder, f)) as text:
                        assert not re.search(r"^\s*(from|import)\s.*\bllm\b|corpus_pipeline", text.read(), re.M), f


def test_entry(spark):
    import __spark_entry__ as entry

    rows = entry.entry(spark).collect()
    assert len(rows) == 64 and {r["n_clusters"] for r in rows} <= {0, 1, 2, 3, 4}
