"""The shared folder where the session names none."""

import os
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[2]


def test_without_a_checkpoint_folder(tmp_path):
    code = """
from tallybook.llm import shared, substrings
from tallybook.session import importable, local_session
spark = importable(local_session("plain", cores=2, shuffle_partitions=2))
assert spark.sparkContext.getConf().get("spark.checkpoint.dir") is None
folder = shared.shared_folder(spark)
assert folder == shared.shared_folder(spark)
assert shared.stored(spark.range(3), "three").count() == 3
docs = spark.createDataFrame([(k, " ".join(f"w{i}" for i in range(40))) for k in range(2)], "doc_id long, text string")
found = substrings.remove_duplicates(docs, finish=substrings.digests, schema=substrings.DIGESTS)
assert [r.n_removed for r in found.collect()] == [40, 40]
"""
    env = os.environ | {"SPARK_CONF_DIR": str(tmp_path), "PYTHONPATH": str(ROOT), "TMPDIR": str(tmp_path)}
    subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, env=env, check=True, timeout=180)
