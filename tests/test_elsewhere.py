"""Jobs with Python functions run from a folder where the package is not on the workers' path."""

import subprocess
import sys
from pathlib import Path

CODE = """
import sys
sys.path.insert(0, {root!r})
from tidemark.session import local_session
from tidemark.operators.allometry import regression_band
from pyspark.sql import functions as F
spark = local_session(2, "elsewhere", "1g")
df = spark.range(20).select(F.lit("a").alias("k"), F.col("id").alias("x"), (F.col("id") * 2.0 + F.col("id") % 3).alias("y"))
print("rows", regression_band(df, ["k"], "x", "y", points=5).count(), regression_band(df, ["k"], "x", "y").first()["lo"] is not None)
"""


def test_workers_need_no_copy_of_the_package(tmp_path):
    root = str(Path(__file__).resolve().parents[1])
    done = subprocess.run(
        [sys.executable, "-c", CODE.format(root=root)], cwd=tmp_path, capture_output=True, text=True, timeout=300
    )
    assert "rows 5 True" in done.stdout, done.stderr[-2000:]
