"""The package reaches the Python workers without PYTHONPATH, from another folder, also where a function is used on a caller's own table."""

from __future__ import annotations

import os
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]

SCRIPT = """
import sys
sys.path.insert(0, sys.argv[1])
from pyspark.sql import SparkSession, functions as F
s = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
from factloom.functions import paths
from factloom.functions.folding import folded
df = s.createDataFrame([("\\u00c9t\\u00e9",)], "t string")
assert df.select(folded(F.col("t"))).first()[0] == "ete"
assert df.select(paths.render_udf(F.lit("nsubj|<-nsubj<-be->prep->in->pobj->|pobj"), F.lit("a"), F.lit("b"))).first()[0] == "a is in b"
"""


def test_functions_ship_the_package(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", SCRIPT, str(ROOT)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=180)
    assert done.returncode == 0, done.stderr[-2000:]
