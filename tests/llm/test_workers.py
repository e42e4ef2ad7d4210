"""All queries and the pipeline run where workers have no copy of the package: only the driver's sys.path names it."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
SCRIPT = """
import sys
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", sys.argv[2]).getOrCreate()
spark.sparkContext.setLogLevel("OFF")
def seen(batches):
    import importlib.util
    import pyarrow as pa
    for b in batches:
        yield pa.RecordBatch.from_pydict({"found": [importlib.util.find_spec("tidewise") is not None]})
assert not any(r.found for r in spark.range(3).mapInArrow(seen, "found boolean").collect()), "workers see the package"
before = dict(spark.conf.getAll)
sys.path.insert(0, sys.argv[1])
import __spark_entry__
for name, query in __spark_entry__.queries().items():
    if name.startswith("op") or name == "pipeline":
        print(name, query(spark, sys.argv[3]).count(), flush=True)
after = dict(spark.conf.getAll)
after.pop("spark.sql.execution.arrow.maxBytesPerBatch")  # set once, where queries open their tables
assert before == after, "an operator changed the session's settings"
"""


def test_workers_need_no_copy_of_the_package(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    for name in ("documents", "labels", "embeddings"):
        spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet").write.parquet(f"{tmp_path}/data/{name}.parquet")
    (tmp_path / "elsewhere").mkdir()
    env = {k: v for k, v in os.environ.items() if k not in ("PYTHONPATH", "SPARK_REMOTE")}
    run = subprocess.run([sys.executable, "-c", SCRIPT, ROOT, str(tmp_path / "shared"), str(tmp_path / "data")], cwd=tmp_path / "elsewhere", env=env, capture_output=True, text=True, timeout=900)
    assert run.returncode == 0, run.stderr[-3000:]
    counts = dict(line.split() for line in run.stdout.splitlines() if line.startswith(("op", "pipeline")))
    assert len(counts) == 11 and int(counts["op1_pii"]) == docs.count()
    assert [p.name for p in (tmp_path / "shared").glob("*/pipeline-*/*") if p.is_dir()] == ["3-mixing"]
