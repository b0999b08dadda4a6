"""Writing a small intermediate table once instead of recomputing it in every branch."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``.

    Where none is named, a folder of the warehouse serves a local session, or a cluster whose
    warehouse is not a machine's own folder; any other cluster gets an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    warehouse = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
    own_folder = warehouse.startswith("file:") or "://" not in warehouse
    if own_folder and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return f"{warehouse}/_settled"


def at_once(spark: SparkSession, work: Callable, items: Sequence, threads: int = 4) -> list:
    """Run independent Spark work for several items side by side, results in order.

    Each item is a set of distributed jobs; running a few together fills the cluster while
    one of them is at its driver-side step.
    """
    with ThreadPool(min(threads, max(1, len(items)))) as pool:
        return pool.map(inheritable_thread_target(spark)(work), items)


def settle(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage, survives the loss of executors, and gives later joins a real size
    to plan with.  Used for entity- and bucket-level tables that several branches need.
    """
    path = f"{checkpoint_dir(df.sparkSession)}/settled-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` computed once into the shared folder, with its partitions and their order kept."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(checkpoint_dir(df.sparkSession))
    return df.checkpoint(eager=True)
