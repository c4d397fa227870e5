"""Parallelism of Python steps over inputs with few splits."""

from __future__ import annotations

from pyspark.sql import DataFrame


def spread(df: DataFrame) -> DataFrame:
    """Deal the rows of a scan with fewer splits than cores over all cores, before a step in Python that costs more than moving them.

    Large inputs have more splits than cores and stay as they are: nothing is shuffled. Plans that already exchange rows stay too; looking at
    their partitions would run them.
    """
    plan = df._jdf.queryExecution().executedPlan().toString()
    if "Exchange" in plan or "FileScan" not in plan:
        return df
    want = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(want) if df.rdd.getNumPartitions() < want else df
