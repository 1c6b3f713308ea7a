import os
import re
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_names_agree():
    sys.path.insert(0, ROOT)
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert len(e.queries()) > 80


def test_without_the_training_data_operators(tmp_path):
    for name in ("rankwell", "__spark_entry__.py"):
        src = os.path.join(ROOT, name)
        (shutil.copytree if os.path.isdir(src) else shutil.copy)(src, tmp_path / name)
    shutil.rmtree(tmp_path / "rankwell" / "llm", ignore_errors=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'shortlist' in q and not any(k.startswith('op') and k[2].isdigit() or k == 'pipeline' for k in q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"}, timeout=120)


def test_nothing_else_imports_llm():
    for folder, _, files in os.walk(os.path.join(ROOT, "rankwell")):
        if os.path.basename(folder) != "llm":
            for f in files:
                if f.endswith(".py"):
                    assert not re.search(r"\bllm\b", open(os.path.join(folder, f), encoding="utf-8").read())


def test_flagship(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
