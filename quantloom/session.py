"""Session settings shared by the tests, the bench and standalone use.

A cluster's own session is taken as it is; nothing here overrides it.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = "*", memory: str = "8g", partitions: int = 8) -> SparkSession:
    """A local session with the settings that the queries expect."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("quantloom")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, for checkpoints, kept tables and stream state.

    ``spark.checkpoint.dir`` of the session holds. Where it is unset a local
    session gets a temporary folder for its lifetime; on a cluster, where such
    a folder would be another one on each host, that is an error.
    """
    known = spark.conf.get("spark.checkpoint.dir", None)
    if known:
        return known
    made = spark.conf.get("quantloom.sharedDir", None)
    if not made:
        master = spark.conf.get("spark.master", "")
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        made = tempfile.mkdtemp(prefix="quantloom-")
        spark.conf.set("quantloom.sharedDir", made)
    return made


def remove(spark: SparkSession, folder: str) -> None:
    """Delete a folder with all it holds, if it is there."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def remove_at_exit(spark: SparkSession, folder: str) -> None:
    """Delete a folder once the program ends, when nothing can read it any more."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def gone() -> None:
        try:
            files.delete(path, True)
        except Exception:  # the JVM may have ended before
            pass

    atexit.register(gone)


def kept(df: DataFrame) -> DataFrame:
    """Cut the lineage with a table in the shared folder: written once, read by columns."""
    spark = df.sparkSession
    folder = f"{shared_dir(spark)}/kept-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    remove_at_exit(spark, folder)
    return spark.read.schema(df.schema).parquet(folder)


def spread(df: DataFrame) -> DataFrame:
    """The rows over all cores where a scan gives too few partitions for costly work on each row.

    A table of many files or row groups is taken as it lies; only one that
    would leave more than half of the cores idle is moved.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() * 2 < cores else df


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
