import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__ as entry

ROOT = Path(entry.__file__).parent
SF = "/root/testdata/sf0.001"


def test_names_and_sql_agree():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.skipif(not Path(SF).exists(), reason="no tables here")
def test_entry(spark):
    assert entry.entry(spark).count() == 95


def test_import_without_the_llm_part(tmp_path):
    for p in ("__spark_entry__.py", "fingerlake"):
        (tmp_path / p).symlink_to(ROOT / p) if p.endswith(".py") else (tmp_path / p).mkdir()
    for p in (ROOT / "fingerlake").iterdir():
        if p.name not in ("llm", "__pycache__"):
            (tmp_path / "fingerlake" / p.name).symlink_to(p)
    (tmp_path / "__spark_entry__.py").unlink()
    (tmp_path / "__spark_entry__.py").write_text((ROOT / "__spark_entry__.py").read_text())
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 30 and not any(k.startswith('op') for k in q if k[2:3].isdigit()), q"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PYTHONPATH": str(tmp_path), "PATH": "/usr/bin:/bin"})
