"""What the operators leave on disk."""

from __future__ import annotations

import os
import subprocess
import sys
from pathlib import Path

SCRIPT = """
import os, sys
from glyphmill.llm import simhash
from glyphmill.session import build_session
folder = sys.argv[1]
os.environ["SPARK_LOCAL_DIRS"] = folder + "/local"
spark = build_session("disk", 2, spark__sql__warehouse__dir=folder + "/wh", spark__checkpoint__dir=folder + "/ck", spark__ui__enabled="false")
docs = spark.createDataFrame([(i, " ".join(f"w{i % 40}x{j}" for j in range(40))) for i in range(60)], "doc_id bigint, text string")
assert simhash.keep_one(docs).count() == 40
print("LEFT", sum(f.endswith(".data") for _, _, fs in os.walk(folder + "/local") for f in fs), flush=True)
os._exit(0)
"""


def test_near_dedup_leaves_no_shuffle_files(tmp_path):
    """Steps that have ended must not keep their shuffles until the driver collects garbage: over a large input they
    add up to more than the disk holds."""
    repo = str(Path(__file__).resolve().parents[2])
    done = subprocess.run([sys.executable, "-c", SCRIPT, str(tmp_path)], env=os.environ | {"PYTHONPATH": repo}, capture_output=True, text=True, timeout=300)
    left = [x for x in done.stdout.splitlines() if x.startswith("LEFT")]
    assert left == ["LEFT 0"], done.stderr[-2000:]
