from pyspark.sql import functions as F

from palaver import session


def test_written_tables_go_to_the_shared_folder(spark):
    df = session.materialise(spark.range(5).withColumn("x", F.lit("a")))
    base = spark.conf.get("spark.checkpoint.dir", None) or session.shared_dir._own
    name = lambda p: "/" + p.split(":")[-1].strip("/")
    assert df.count() == 5 and all(name(f).startswith(name(base)) for f in df.inputFiles())
    assert session.clean_up(spark) >= 1 and not session._MADE


def test_package_reaches_the_workers_from_any_folder(tmp_path):
    import subprocess
    import sys
    from pathlib import Path

    import pytest

    if not Path("/root/testdata/sf0.001").exists():
        pytest.skip("no test tables here")
    root = Path(__file__).resolve().parents[1]
    code = f"import sys; sys.path.insert(0, {str(root)!r})\nimport __spark_entry__ as e\nfrom palaver.session import local_session\ns = local_session('2', 2, '1g')\nprint('rows', e.queries()['word_errors'](s, '/root/testdata/sf0.001').count(), len(e.queries()['refine_chunks'](s, '/root/testdata/sf0.001').collect()))"
    import os

    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    run = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "rows" in run.stdout, run.stderr[-2000:]
