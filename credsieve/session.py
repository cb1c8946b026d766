"""Session settings this engine relies on, and reliable lineage cuts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"
#: Shuffled files go when the job that made them ends.
CLEANUP_CONF = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def local_session(cores: int = 8, name: str = "credsieve") -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of the cluster; on a single machine one of its own if none is set.

    With executors elsewhere a local folder would lose their files, so that is an error.
    """
    configured = spark.conf.get(CHECKPOINT_CONF, None)
    if configured:
        return configured
    current = spark.sparkContext.getCheckpointDir()
    if current is None:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError(f"set {CHECKPOINT_CONF} to a folder that all executors share")
        current = tempfile.mkdtemp(prefix="run-", dir="/tmp")
        spark.sparkContext.setCheckpointDir(current)
    return current


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path nobody uses yet in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


_written: list[str] = []


def remove_settled(spark: SparkSession) -> None:
    """Remove the tables that ``settled`` wrote for this program.  Frames made from them
    cannot be read any more, so this comes last; they may hold secrets in plain text."""
    while _written:
        folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_written.pop())
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def settled(df: DataFrame, *, small: bool = False) -> DataFrame:
    """``df`` computed once and read back from a table in the shared folder.

    A lost executor then cannot make a later read see different rows or row ids, and
    several uses do not compute it again.  ``small`` spends time on disk: the table is
    packed closer, and what was shuffled to make it goes as soon as it is written.
    """
    spark = df.sparkSession
    path = fresh_path(spark, "settled")
    _written.append(path)
    if small:
        before = spark.conf.get(CLEANUP_CONF, "false")
        spark.conf.set(CLEANUP_CONF, "true")
        try:
            df.write.option("compression", "zstd").parquet(path)
        finally:
            spark.conf.set(CLEANUP_CONF, before)
    else:
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._settled_at = path
    return out


def released(*frames: DataFrame) -> None:
    """Remove the tables behind frames that ``settled`` gave, which nothing reads any more."""
    for df in frames:
        path = getattr(df, "_settled_at", None)
        if path in _written:
            _written.remove(path)
            folder = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
