"""The shared folder: from the setting, of its own in one process, an error on a cluster."""

from __future__ import annotations

import os
import subprocess
import sys
from types import SimpleNamespace

import pytest

from gridloom.sources.storage import shared_dir

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_a_cluster_without_the_setting_is_told():
    conf = SimpleNamespace(get=lambda *a: None)
    spark = SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master="spark://host:7077", getConf=lambda: conf, applicationId="app"))
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_dir(spark)


def test_without_any_defaults(tmp_path):
    """A session in one process whose folder of defaults is empty; the entry ships the library by itself."""
    code = """
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from gridloom.plans.loops import cut
from gridloom.sources.files import scratch
from gridloom.sources.storage import shared_dir
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").getOrCreate()
assert shared_dir(spark).startswith("file:///") and shared_dir(spark) == shared_dir(spark)
assert cut(spark.range(3)).count() == 3
spark.range(3).write.parquet(path := scratch(spark, "t"))
assert spark.read.parquet(path).count() == 3
import __spark_entry__ as entry
df = entry.queries()["tiled_matmul"](spark, "/root/testdata/sf0.001")
assert df.count() and any(p.endswith("gridloom.zip") for p in spark.sparkContext._python_includes)
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"} | {"PYTHONPATH": ROOT, "SPARK_CONF_DIR": str(tmp_path)}
    assert subprocess.run([sys.executable, "-c", code], env=env, cwd=tmp_path, timeout=240).returncode == 0
