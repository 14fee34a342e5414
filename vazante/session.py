"""Session helpers: a tuned builder, table reading and lineage cuts in the shared folder."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"


def build_session(master: str = "local[*]", shuffle_partitions: int = 8, app: str = "vazante") -> SparkSession:
    """A session with adaptive execution, UTC and Arrow; cluster settings given elsewhere win."""
    return (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("VAZANTE_DRIVER_MEMORY", "8g"))
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` as the cluster sets it.

    Only where it is unset and everything runs on one machine (a ``local`` master, as in tests) a temporary
    folder is made, set on the context and removed at exit; on a cluster a missing setting is an error.
    """
    value = spark.sparkContext.getConf().get(CHECKPOINT_KEY) or spark.conf.get(CHECKPOINT_KEY, None)
    if value:
        return value.rstrip("/")
    known = spark.sparkContext._jsc.sc().getCheckpointDir()
    if known.isDefined():
        return known.get().rstrip("/")
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError(f"{CHECKPOINT_KEY} must name a folder that all executors share")
    path = tempfile.mkdtemp(prefix="vazante-")
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    spark.sparkContext.setCheckpointDir("file://" + path)
    return "file://" + path


_open: list[set[str]] = []


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path for one written table in the shared folder, removed when its ``scratch`` or the driver ends."""
    path = f"{shared_dir(spark)}/vazante/{name}-{uuid.uuid4().hex}"
    if _open:
        _open[-1].add(path)
    else:
        atexit.register(remove_path, spark, path)
    return path


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables cut inside are deleted at its end: a long session wraps each query, its writing included."""
    _open.append(set())
    try:
        yield
    finally:
        for path in _open.pop():
            remove_path(spark, path)


def remove_path(spark: SparkSession, path: str) -> None:
    """Delete a path of any Hadoop file system; a stopped session or absent path is ignored."""
    try:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:
        return


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Cuts the lineage like a reliable checkpoint (a lost executor re-reads the files)
    but stays columnar and compressed, so later readers prune columns.
    """
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, folder: str, name: str, spread: bool = False) -> DataFrame:
    """Scan one table of a data folder.

    ``spread`` is for scans that feed heavy per-row work: where the files give fewer partitions than
    there are cores (a single small file, say), rows are dealt out first. Larger tables are left as
    they are, so no text is shuffled for it at scale.
    """
    scan = spark.read.parquet(f"{folder}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return scan.repartition(cores) if spread and scan.rdd.getNumPartitions() < cores else scan
