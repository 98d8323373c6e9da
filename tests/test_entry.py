import pytest

import __spark_entry__ as E
from sample_tables import SF_SMALL


def test_entry_runs(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) == 30 and set(df.columns) == {"metric", "k", "value"}


def test_registry_consistent():
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q)
    assert len(q) >= 100


@pytest.mark.parametrize("key", ["ova_topk", "metrics_report", "rai_joint", "tokenize_ids", "training_batches",
                                 "triplet_audit", "balanced_clusters", "sink_sparse_matrix", "stream_ema"])
def test_oracle_small(spark, key):
    import sys, os
    sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))
    import check_oracle as C
    con = C.duck(SF_SMALL)
    r = C.compare(spark, con, key, E.queries()[key], E.oracle_sql()[key], SF_SMALL)
    assert r["status"] == "OK", r


def test_jobs_run_from_another_working_directory(tmp_path):
    """Worker-side functions ship by value: no installed package or repo cwd is needed."""
    import os
    import subprocess
    import sys
    repo = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    script = tmp_path / "drv.py"
    script.write_text(
        "import importlib.util\n"
        f"spec = importlib.util.spec_from_file_location('__spark_entry__', {os.path.join(repo, '__spark_entry__.py')!r})\n"
        "E = importlib.util.module_from_spec(spec); spec.loader.exec_module(E)\n"
        "from pyspark.sql import SparkSession\n"
        "s = SparkSession.builder.master('local[2]').config('spark.ui.enabled', 'false')"
        ".config('spark.sql.shuffle.partitions', '4').getOrCreate()\n"
        f"print('ROWS', E.queries()['ova_topk'](s, {SF_SMALL!r}).count())\n")
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, str(script)], cwd=str(tmp_path), env=env, capture_output=True,
                         text=True, timeout=300)
    assert "ROWS 5000" in out.stdout, out.stderr[-2000:]


def test_the_rest_works_without_the_training_data_operators(tmp_path):
    """Neither ``xmcforge/llm`` nor (in the second run) ``corpus_pipeline.py`` is needed."""
    import os
    import shutil
    import subprocess
    import sys
    repo = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    copy = tmp_path / "copy"
    shutil.copytree(os.path.join(repo, "xmcforge"), copy / "xmcforge", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(repo, "__spark_entry__.py"), copy)
    pipeline = os.path.join(repo, "corpus_pipeline.py")
    ask = "import __spark_entry__ as E; q, o = E.queries(), E.oracle_sql(); print(len(q), set(o) <= set(q), 'pipeline' in q, any(k.startswith('op1_') for k in q))"
    for with_pipeline in (True, False):
        if with_pipeline and os.path.exists(pipeline):
            shutil.copy(pipeline, copy)
        elif (copy / "corpus_pipeline.py").exists():
            (copy / "corpus_pipeline.py").unlink()
        out = subprocess.run([sys.executable, "-c", ask], cwd=copy, capture_output=True, text=True, timeout=120)
        assert out.returncode == 0, out.stderr[-2000:]
        count, *rest = out.stdout.split()
        assert int(count) >= 100 and rest == ["True", "False", "False"]
