"""Rounds of iterative operators: frames written once to the cluster's shared folder, so that lineage stays short."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession, what: str) -> str:
    """A new path below spark.checkpoint.dir; a folder of this machine is chosen only for a local master."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        chosen = spark.sparkContext._jsc.sc().getCheckpointDir()
        if chosen.isDefined():
            root = chosen.get()
        elif spark.sparkContext.master.startswith("local"):
            root = f"file:///tmp/spark-checkpoints-{uuid.uuid4().hex[:8]}"
        else:
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{root.rstrip('/')}/{what}-{uuid.uuid4().hex}"


def written(df: DataFrame, what: str) -> DataFrame:
    """df, written once and read back."""
    path = shared_folder(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def forget(df: DataFrame) -> None:
    """Removes the files of a written frame that nothing reads any more."""
    jvm, conf = df.sparkSession._jvm, df.sparkSession._jsparkSession.sessionState().newHadoopConf()
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)
