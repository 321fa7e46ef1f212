"""The package's Python code reaches the executors with the tasks: a driver
started outside the repository (no installed package) can run the parse."""

import os
import subprocess
import sys

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

SCRIPT = f"""
import sys
sys.path.insert(0, {REPO!r})
from threadsmith.session import build_session
import __spark_entry__ as E
spark = build_session("local[2]", 4)
print("ROWS", E.queries()["post_explode"](spark, "/root/testdata/sf0.001").count(),
      E.queries()["story_slug"](spark, "/root/testdata/sf0.001").count())
"""


def test_driver_outside_repo(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    r = subprocess.run([sys.executable, "-c", SCRIPT], cwd=tmp_path, env=env, capture_output=True,
                       text=True, timeout=600)
    assert r.returncode == 0, r.stderr[-2000:]
    assert "ROWS 419 200" in r.stdout


SUBMIT = f"""
import sys
sys.path.insert(0, {REPO!r})
from threadsmith.session import build_session
spark = build_session()
print("SEEN", spark.sparkContext.master, spark.conf.get("spark.sql.shuffle.partitions"))
"""


def test_submitted_settings_stay(tmp_path):
    import pyspark
    job = tmp_path / "job.py"
    job.write_text(SUBMIT)
    submit = os.path.join(os.path.dirname(pyspark.__file__), "bin", "spark-submit")
    r = subprocess.run([submit, "--master", "local[3]", "--conf", "spark.sql.shuffle.partitions=200",
                        "--conf", "spark.ui.enabled=false", str(job)],
                       env={**os.environ, "PYSPARK_PYTHON": sys.executable}, capture_output=True, text=True, timeout=300)
    assert "SEEN local[3] 200" in r.stdout, r.stderr[-2000:]
