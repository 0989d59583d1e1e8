import os
import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__
from corpusforge.plans import catalog

ROOT = Path(__file__).resolve().parent.parent


def test_names_agree():
    assert set(catalog.oracle_sql()) <= set(catalog.queries())
    assert {"hybrid_search", "bm25_topk", "dense_topk", "rrf_fusion", "intent_route"} <= set(__spark_entry__.queries())


@pytest.mark.skipif(not os.path.exists("/root/testdata/sf0.001"), reason="needs the test tables")
def test_entry(spark):
    out = __spark_entry__.entry(spark)
    assert {"qid", "chunk_id", "fused_rank"} <= set(out.columns) and out.count() > 0


def test_imports_without_the_training_data_part(tmp_path):
    """The rest works where the llm folders and the pipeline have been removed."""
    for name in ("corpusforge", "__spark_entry__.py"):
        target = tmp_path / name
        if (ROOT / name).is_dir():
            import shutil

            shutil.copytree(ROOT / name, target, ignore=shutil.ignore_patterns("llm", "__pycache__"))
        else:
            target.write_text((ROOT / name).read_text())
    code = "import __spark_entry__ as e; q = e.queries(); assert 'bm25_topk' in q and not any(n.startswith('op') and n[2].isdigit() or n == 'pipeline' for n in q); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={**os.environ, "PYTHONPATH": str(tmp_path)})
