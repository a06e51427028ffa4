"""Where written tables go, and jobs started from another folder."""

import os
import subprocess
import sys
from types import SimpleNamespace

import pytest

from codeq.session import shared_folder

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def session(master, **conf):
    return SimpleNamespace(sparkContext=SimpleNamespace(master=master), conf=conf)


def test_shared_folder():
    named = session("yarn", **{"spark.checkpoint.dir": "hdfs://a/b/"})
    assert shared_folder(named, "x").startswith("hdfs://a/b/codeq/x-")
    assert shared_folder(named, "x") != shared_folder(named, "x")
    local = {"spark.sql.warehouse.dir": "file:/w"}
    assert shared_folder(session("local[4]", **local), "x").startswith("file:/w/codeq/x-")
    assert shared_folder(session("yarn", **{"spark.sql.warehouse.dir": "s3a://w"}), "x").startswith("s3a://w/codeq/")
    with pytest.raises(ValueError, match="checkpoint.dir"):
        shared_folder(session("spark://host:7077", **local), "x")


ELSEWHERE = """
import importlib.util, sys
spec = importlib.util.spec_from_file_location("entry", sys.argv[1] + "/__spark_entry__.py")
entry = importlib.util.module_from_spec(spec)
spec.loader.exec_module(entry)
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
jobs = entry.queries()
for name in ("rule_pack_counts", "syntax_facts", "op4_token_counts"):
    if name in jobs:
        assert jobs[name](spark, "/root/testdata/sf0.001").count() > 0
"""


def test_jobs_run_from_another_folder(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", ELSEWHERE, ROOT], cwd=tmp_path, env=env, capture_output=True,
                          text=True, timeout=300, check=False)
    assert done.returncode == 0, done.stderr[-2000:]
