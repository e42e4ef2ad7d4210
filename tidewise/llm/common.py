"""What the operators of this subpackage share: reading, sizing, checkpoints and worker caches."""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table of a query, through Spark's own reader, so that any store Spark knows will do.

    Queries start here, so here, and nowhere in the operators, a session that names no bound gets one of
    8 MB for the Arrow batches that Python workers are sent."""
    if BATCH_BYTES not in spark.conf.getAll:
        spark.conf.set(BATCH_BYTES, str(8 << 20))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sliced(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The batches in slices of at most so many rows, so that a Python worker unpacks a few texts at a
    time.  The session bounds the batches themselves (see BATCH_BYTES)."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Uses the shared folder that spark.checkpoint.dir names.  Where none is named, a session in one
    process (as in tests) gets a folder of its own; a cluster raises."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not named and (sc.master == "local" or sc.master.startswith("local[")):
        named = tempfile.mkdtemp(prefix="tidewise-checkpoint-")
    if not named:
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    sc.setCheckpointDir(named)


def removed(spark: SparkSession, folder: str) -> None:
    """Deletes a folder through the file system that holds it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def checkpointed(df: DataFrame) -> DataFrame:
    """Writes df to the shared checkpoint folder and cuts its lineage."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def repeats_itself(plan: Any) -> bool:
    """Whether a logical plan only reads files or checkpoints and maps their rows, so that rows come in the
    same order and partitions however often, and for whatever columns, it runs."""
    kind = plan.getClass().getSimpleName()
    if kind in ("LogicalRelation", "DataSourceV2ScanRelation", "LocalRelation"):
        return True
    if kind == "LogicalRDD":
        return bool(plan.rdd().isCheckpointed())
    children = plan.children()
    return kind in ("Project", "Filter", "SubqueryAlias", "Generate", "Union") and all(repeats_itself(children.apply(i)) for i in range(children.size()))


def numbered(docs: DataFrame, name: str) -> DataFrame:
    """docs with a number for each row that stays the same however often and for whatever columns the
    plan runs: what does more than read and map files is checkpointed first."""
    plan = docs._jdf.queryExecution().optimizedPlan()
    return (docs if plan.deterministic() and repeats_itself(plan) else checkpointed(docs)).withColumn(name, F.monotonically_increasing_id())


def text_or_empty(name: str = "text") -> Any:
    return F.coalesce(F.col(name), F.lit(""))


def fold(modulus: int, column: str = "doc_id") -> Any:
    """crc32 of the id as text, modulo `modulus`; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % modulus


def worker_cache(name: str, version: Any, make: Callable[[], Any]) -> Any:
    """A value that lives as long as the Python worker process, whatever number of tasks it serves; only
    the last version of a name is kept."""
    import sys
    import types

    home = sys.modules.setdefault("_tidewise_worker", types.ModuleType("_tidewise_worker"))
    if getattr(home, name, (None,))[0] != version:
        setattr(home, name, (version, make()))
    return getattr(home, name)[1]
