"""The driver contract, with and without the text operators."""

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).parent.parent
SAY = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); print(len(q), len(s), sum(n[:2] == 'op' or n == 'pipeline' for n in q), set(s) <= set(q))"


def said(folder):
    r = subprocess.run([sys.executable, "-c", SAY], cwd=folder, capture_output=True, text=True)
    assert r.returncode == 0, r.stderr
    return r.stdout.split()


def copy(to):
    shutil.copy(ROOT / "__spark_entry__.py", to)
    shutil.copytree(ROOT / "fieldweave", to / "fieldweave", ignore=shutil.ignore_patterns("llm", "__pycache__"))


def test_without_the_text_operators(tmp_path):
    copy(tmp_path)
    n, sql, texts, known = said(tmp_path)
    assert int(n) > 60 and int(sql) > 60 and texts == "0" and known == "True"


def test_a_pipeline_without_its_operators_is_left_out(tmp_path):
    copy(tmp_path)
    (tmp_path / "corpus_pipeline.py").write_text("from fieldweave.llm import mixing\n")
    assert said(tmp_path)[2] == "0"
