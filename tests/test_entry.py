import shutil
import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry

OPTIONAL = {"pipeline"}


def test_registry():
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) >= 60
    core = {k for k in queries if not k.startswith("op") and k not in OPTIONAL}
    assert core - set(sql) == {"parse_names"}


def test_flagship(spark):
    rows = {r["type"]: r["n"] for r in entry.entry(spark).collect()}
    assert rows["lumped"] == rows["split"] == rows["probable_rename"] > 0


def test_the_rest_works_without_the_training_data_part(tmp_path):
    here = Path(entry.__file__).parent
    shutil.copytree(here / "chronotaxa", tmp_path / "chronotaxa", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(here / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) >= 60 and set(e.oracle_sql()) <= set(q) and not any(k.startswith('op') or k == 'pipeline' for k in q)"
    run = lambda: subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)}, capture_output=True, text=True, timeout=120)
    assert run().returncode == 0, run().stderr
    (tmp_path / "corpus_pipeline.py").write_text("import chronotaxa.llm.shared\n")
    assert run().returncode == 0, run().stderr
    (tmp_path / "corpus_pipeline.py").write_text("import no_such_module\n")
    assert run().returncode != 0
