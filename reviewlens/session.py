"""Session helpers: a local session for tests/bench, and the shared scratch folder."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def get_spark(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "reviewlens",
              extra: dict | None = None) -> SparkSession:
    """Local session used by tests, bench and the examples.

    On a cluster the caller builds its own session; operators never create one.
    """
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.ansi.enabled", "true")
    )
    for k, v in (extra or {}).items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession, name: str | None = None) -> str:
    """A fresh folder under the cluster's shared checkpoint folder.

    The folder comes from ``spark.checkpoint.dir`` (or ``SparkContext.getCheckpointDir``).
    Only a local-mode session without that setting (as in tests) gets a folder of its own
    under the system temp dir, and the setting is then recorded on the session; on a cluster
    an unset folder is an error, because a machine-local folder is not visible to executors.
    Spark's writers make the folder; ``remove_scratch`` (also run at exit) removes it.
    """
    sc = spark.sparkContext
    base = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder before writing scratch data")
        base = tempfile.mkdtemp(prefix="reviewlens-ckpt-")
        sc.setCheckpointDir(base)
        base = sc.getCheckpointDir() or base
    path = base.rstrip("/") + "/" + (name or "scratch") + "-" + uuid.uuid4().hex[:12]
    _MADE.append(path)
    return path


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: one result for several consumers, and no lineage to run again."""
    path = f"{shared_dir(df.sparkSession, name)}/t.parquet"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Folders given out by ``shared_dir`` and not yet removed.
_MADE: list[str] = []


def _file_system(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def remove_scratch(spark: SparkSession) -> None:
    """Remove the folders that ``shared_dir`` gave out; tables read from them end with it."""
    while _MADE:
        fs, p = _file_system(spark, _MADE.pop())
        fs.delete(p, True)


def path_state(spark: SparkSession, path: str) -> tuple | None:
    """Names, sizes and times of the files of ``path`` in whatever store it is; None if there is nothing."""
    fs, p = _file_system(spark, path)
    if not fs.exists(p):
        return None
    files = fs.listStatus(p)
    return tuple(sorted((f.getPath().getName(), f.getLen(), f.getModificationTime()) for f in files))


@atexit.register
def _at_exit() -> None:
    spark = SparkSession.getActiveSession()
    with contextlib.suppress(Exception):  # the session may have ended before
        if spark is not None:
            remove_scratch(spark)
