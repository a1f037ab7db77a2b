"""Tables that several stages read: written once, to the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_CUT: dict[str, list[str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir. Where it is unset: a folder of this machine if all runs here, as in tests;
    on a cluster that is an error, as executors would not see each other's files."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        named = context.getConf().get("spark.checkpoint.dir", "")
        if not named and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(named or "file://" + tempfile.mkdtemp(prefix="docloom-"))
    return context.getCheckpointDir()


def fresh_path(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


def cut(df: DataFrame, what: str = "cut", compression: str = "snappy") -> DataFrame:
    """df, written to the shared folder and read again: lost executors don't lose it, and it is computed once."""
    spark = df.sparkSession
    path = fresh_path(spark, what)
    _CUT.setdefault(shared_dir(spark), []).append(path)
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, most_bytes: int = 256 << 20) -> DataFrame:
    """df over all cores where it is a file of at most `most_bytes` that is read in fewer partitions than there are cores, as one of a single row group
    is; else as it is: a larger table has row groups enough, and its texts are not shuffled."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= cores or int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) > most_bytes:
        return df
    return df.repartition(cores)


def cuts(spark: SparkSession) -> list[str]:
    """Paths of the tables that cut() wrote and that were not dropped."""
    return list(_CUT.get(shared_dir(spark), ()))


def drop_cuts(spark: SparkSession, paths: list[str]) -> None:
    """Deletes such tables. To be called when what was made of them is written elsewhere."""
    known = _CUT.get(shared_dir(spark), [])
    for path in paths:
        if path in known:
            folder = spark._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
            known.remove(path)
