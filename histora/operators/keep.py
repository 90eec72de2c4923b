"""Tables that are written down on the way, once, where the cluster shares files."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

#: Whether Spark drops the shuffle files of a job when it ends, rather than when the driver happens to collect its garbage.
DROPPED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def kept(df: DataFrame) -> DataFrame:
    """df written below the session's checkpoint folder and read from there: its lineage is cut and it is computed once.

    The files outlive lost executors, and go when the driver ends. Without a checkpoint folder Spark's own error is raised.
    The shuffles that made them are dropped at once, as nothing reads them again.
    """
    spark = df.sparkSession
    home = spark.sparkContext.getCheckpointDir()
    if not home:
        return df.checkpoint()
    at = f"{home}/kept-{uuid.uuid4().hex}"
    was = spark.conf.get(DROPPED, None)
    spark.conf.set(DROPPED, "true")
    try:
        df.write.parquet(at)
    finally:
        spark.conf.unset(DROPPED) if was is None else spark.conf.set(DROPPED, was)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)
    return spark.read.schema(df.schema).parquet(at)
