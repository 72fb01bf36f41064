"""Session helpers: a builder for local work, the UTC rule, and written tables.

A *written table* is how this package cuts lineage: the rows go to Parquet in
the folder every executor can see (``spark.checkpoint.dir``) and are read back.
That survives lost executors, gives the optimizer real sizes to decide joins on,
and lets several branches of one plan share an expensive step.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

LOCAL_SCRATCH: dict[str, str] = {}


def session(app: str = "tidemark", master: str | None = None, partitions: int = 8) -> SparkSession:
    """A session for tests and benchmarks. On a cluster, bring your own."""
    spark = (
        SparkSession.builder.appName(app)
        .master(master or f"local[{os.environ.get('BENCH_CPUS', '8')}]")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("TIDEMARK_DRIVER_MEMORY", "4g"))
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")  # no call-site capture per column
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def use_utc(spark: SparkSession) -> None:
    """Times are naive UTC everywhere; pin the session so casts do not shift them."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def shared_folder(spark: SparkSession) -> str:
    """The folder for written tables, taken from the session.

    A machine-local folder is used only when the session names none *and* runs
    in local mode; on a cluster a missing setting is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    set_by_user = spark.sparkContext.getCheckpointDir()
    if set_by_user:
        return set_by_user.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder shared by the cluster")
    app = spark.sparkContext.applicationId
    if app not in LOCAL_SCRATCH:
        LOCAL_SCRATCH[app] = tempfile.mkdtemp(prefix="tidemark-")
    return LOCAL_SCRATCH[app]


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark)}/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str = "table") -> DataFrame:
    """Write ``df`` to the shared folder and read it back (cuts the lineage)."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove_table(spark: SparkSession, path: str) -> None:
    """Remove a table of our own in the shared folder; one that is not there is no error."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
