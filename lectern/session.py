"""Session settings and the shared folder used to cut lineage."""
from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_LOCAL_DIRS: dict[str, str] = {}
#: Shuffle files go when the query that wrote them ends, not when the driver next collects garbage.
CLEAN_SHUFFLES = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}


def build_session(cores: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A local session for tests and the bench; clusters bring their own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("lectern")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        # building a long expression is mostly call-site capture otherwise
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a temporary one only on a local master."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        folder = named
    else:
        sc = spark.sparkContext
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder shared by the cluster")
        folder = _LOCAL_DIRS.setdefault(sc.applicationId, tempfile.mkdtemp(prefix="spark-"))
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex[:12]}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """A written table survives executor loss, and unlike a checkpoint computes ``df`` once."""
    return materialize(df, "lineage")


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]):
    """Session settings for the length of one run."""
    old = {k: spark.conf.get(k, None) for k in values}
    try:
        for k, v in values.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def materialize(df: DataFrame, label: str = "stage") -> DataFrame:
    """Write ``df`` as Parquet below the shared folder and read it back: several aggregates then
    share one pass, each reading only its own columns. Nothing reads the shuffles of the write again, so they go with it."""
    path = scratch_path(df.sparkSession, label)
    with settings(df.sparkSession, CLEAN_SHUFFLES):
        df.write.parquet(path)
    held = df.sparkSession.read.schema(df.schema).parquet(path)    # a known schema saves a job over the footers
    held.scratch = path
    return held


def discard(*held: DataFrame) -> None:
    """Delete tables that ``materialize`` wrote, once all that reads them has been written itself."""
    for df in held:
        jvm = df.sparkSession.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(df.scratch)
        path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def spread(scan: DataFrame, most_bytes: int | None = None) -> DataFrame:
    """Repartition a plain file scan that has fewer partitions than there are cores.

    Meant before work that costs far more than a shuffle, such as extraction from text, on inputs
    of a few files; a large table has enough splits and is returned as it is. With ``most_bytes``, for work whose memory follows
    the rows of a task, splits that may be larger are dealt into shares of at most about that many bytes of the files.
    """
    spark, splits = scan.sparkSession, scan.rdd.getNumPartitions()
    parts = max(splits, spark.sparkContext.defaultParallelism)
    if most_bytes is not None:
        split_bytes = spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
        parts = max(parts, splits * -(-split_bytes // most_bytes))
    return scan.repartition(parts) if parts > splits else scan
