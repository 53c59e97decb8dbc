"""Session settings and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import SparkSession

CLUSTER_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def build_session(app_name: str = "rillmark", master: str | None = None, **settings: str) -> SparkSession:
    """A session with the settings the operators are tuned for."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**CLUSTER_SETTINGS, **settings}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach, as the session names it.

    Only a local session may fall back to a folder of this machine.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    folder = tempfile.mkdtemp(prefix="rillmark-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


#: What the innermost ``scratch`` block of this thread has to remove; None outside any.
_MADE: ContextVar[list[str] | None] = ContextVar("made", default=None)


def new_path(spark: SparkSession, name: str) -> str:
    """A path under the shared folder that nothing has used before."""
    path = f"{shared_folder(spark).rstrip('/')}/rillmark/{name}-{uuid.uuid4().hex}"
    made = _MADE.get()
    if made is not None:
        made.append(path)
    return path


@contextmanager
def scratch(spark: SparkSession):
    """Removes the folders that operators made inside this block, in this thread; consume or store results before it ends.

    What other threads make meanwhile, such as running streams, stays.
    """
    made: list[str] = []
    token = _MADE.set(made)
    try:
        yield
    finally:
        _MADE.reset(token)
        for path in made:
            hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
            hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop_path, True)


#: Rows that a task of a shuffle should hold, and compressed bytes up to which adaptive execution may merge partitions.
TASK_ROWS, TASK_BYTES = 250_000, "4m"


def task_count(rows: int, most: int = TASK_ROWS) -> int:
    """Partitions for ``rows``, so that what a task holds does not grow with them."""
    return max(1, -(-rows // most))


@contextmanager
def dealt_by_rows(spark: SparkSession, rows: int, most: int = TASK_ROWS):
    """Shuffles that run inside this block have partitions for ``rows``, never fewer than the session asks for.

    Adaptive execution merges partitions by their compressed size, which says little about the memory they take.
    """
    wanted = {"spark.sql.shuffle.partitions": str(max(int(spark.conf.get("spark.sql.shuffle.partitions")), task_count(rows, most))),
              "spark.sql.adaptive.advisoryPartitionSizeInBytes": TASK_BYTES}
    before = {key: spark.conf.get(key, None) for key in wanted}
    for key, value in wanted.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)


def materialise(df, name: str = "cut"):
    """Write ``df`` to the shared folder once and read it back.

    Later jobs start from the files, so a lost executor costs a re-read and not
    a re-computation, and every job sees the same rows.
    """
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def path_exists(spark: SparkSession, path: str) -> bool:
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    filesystem = hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration())
    return filesystem.exists(hadoop_path)


def child_names(spark: SparkSession, path: str) -> list[str]:
    """Names of the entries directly under ``path``; none if it does not exist."""
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    filesystem = hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not filesystem.exists(hadoop_path):
        return []
    return sorted(entry.getPath().getName() for entry in filesystem.listStatus(hadoop_path))


def touch(spark: SparkSession, path: str) -> None:
    """Create an empty file."""
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    filesystem = hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration())
    filesystem.create(hadoop_path, True).close()
