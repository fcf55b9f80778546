"""The folder that the driver and all executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """What spark.checkpoint.dir names; a folder of our own only where that is unset and all runs on one machine, as in tests."""
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not folder:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = f"file://{tempfile.mkdtemp()}"
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(folder)
    return folder


def written(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the shared folder; its lineage ends there, and the shuffle files it took are removed."""
    spark = df.sparkSession
    shared_folder(spark)
    own = df.select("*")  # a plan that nothing else runs, so nothing else reads its shuffles
    out = own.checkpoint()
    plan = own._jdf.queryExecution().executedPlan()
    # they would stay until the driver happens to collect its garbage; without adaptive execution they still do
    if plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
        parts = spark.sparkContext._jsc.sc().shuffleDriverComponents()
        for shuffle in list(plan.context().shuffleIds().keySet()):
            parts.removeShuffle(shuffle, False)
    return out
