"""Intermediate tables written to shared storage.

A written table cuts the lineage, is computed once however many branches read
it, keeps Parquet column pruning and filter pushdown, and survives the loss of
executors, which cached or locally checkpointed blocks do not.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Mapping
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, Observation, SparkSession


def scratch_root(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names, or ``/tmp`` of the default file system.

    Where that is the local one and executors are other machines, they would each write
    to a disk of their own: that is an error, and the setting is to be made.
    """
    if root := spark.conf.get("spark.checkpoint.dir", None):
        return root.rstrip("/")
    context = spark.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path("/tmp")
    files = path.getFileSystem(context._jsc.hadoopConfiguration())
    if files.getUri().getScheme() == "file" and not re.match(r"local(\[|$)", context.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return str(files.makeQualified(path).toString()).rstrip("/")


def _own_folder(spark: SparkSession) -> str:
    return f"{scratch_root(spark)}/claimspark/{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, label: str) -> str:
    """A path in the scratch folder that nothing else uses."""
    return f"{_own_folder(spark)}/{label}-{uuid.uuid4().hex}"


def clear_scratch(spark: SparkSession) -> bool:
    """Delete what this application wrote to the scratch folder; results that still read it are lost."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_own_folder(spark))
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the scratch folder and return a scan of the written table."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def materialise_with(df: DataFrame, label: str, **measures: Column) -> tuple[DataFrame, dict]:
    """``materialise``, with aggregates of the rows taken while they are written."""
    observation = Observation()
    stored = materialise(df.observe(observation, *[m.alias(name) for name, m in measures.items()]), label)
    return stored, observation.get


def build_all(
    spark: SparkSession, builders: Mapping[str, Callable[[], DataFrame]], workers: int = 5
) -> dict[str, DataFrame]:
    """Call the builders ``workers`` at a time and return their DataFrames by name.

    Jobs that builders start themselves run side by side, so they fill executors
    that a single job leaves idle in its last stages.
    """
    with ThreadPoolExecutor(workers) as pool:
        inherit = inheritable_thread_target(spark)
        jobs = {name: pool.submit(inherit(build)) for name, build in builders.items()}
        return {name: job.result() for name, job in jobs.items()}


def materialise_all(
    spark: SparkSession, builders: Mapping[str, Callable[[], DataFrame]], workers: int = 5
) -> dict[str, DataFrame]:
    """Write the DataFrames that the builders return, ``workers`` jobs at a time."""
    writers = {name: lambda n=name, b=build: materialise(b(), n) for name, build in builders.items()}
    return build_all(spark, writers, workers)
