"""Session building, the shared work folder, and shipping of this package to executors."""

from __future__ import annotations

import atexit
import logging
import os
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from tallyloom.schema import Config

log = logging.getLogger(__name__)
_local_dir: dict[str, str] = {}
#: Folder of this process among those that share the work folder.
_run = uuid.uuid4().hex
#: Path and schema of stored tables.
_stored: dict[tuple, tuple] = {}
#: Bucketed tables in the catalogue.
_tables: list[str] = []


def build_session(config: Config | None = None, hive: bool = False, **conf: str) -> SparkSession:
    """The running session or a new one: UTC, adaptive execution, Kryo for what still uses Java serialisation."""
    c = config or Config()
    b = (
        SparkSession.builder.appName(c.app_name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(c.shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.autoBroadcastJoinThreshold", str(c.broadcast_bytes))
        .config("spark.serializer", "org.apache.spark.serializer.KryoSerializer")
    )
    if c.master:
        b = b.master(c.master)
    if "PYSPARK_GATEWAY_PORT" not in os.environ:  # else whoever submitted the application has settled its resources
        b = b.config("spark.default.parallelism", str(c.default_parallelism)).config("spark.executor.memory", c.executor_memory).config("spark.driver.memory", c.driver_memory)
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    if hive:
        b = b.enableHiveSupport()
    return b.getOrCreate()


def stop_session() -> None:
    """Stops the active session if there is one."""
    if (s := SparkSession.getActiveSession()) is not None:
        s.stop()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``. Only a local master without that setting gets a folder of this machine."""
    if path := spark.conf.get("spark.checkpoint.dir", ""):
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if "dir" not in _local_dir:
        _local_dir["dir"] = tempfile.mkdtemp(prefix="tallyloom-")
        atexit.register(shutil.rmtree, _local_dir["dir"], True)
    spark.sparkContext.setCheckpointDir(_local_dir["dir"])
    return f"file://{_local_dir['dir']}"


def new_path(spark: SparkSession, name: str) -> str:
    """An unused path in the shared folder."""
    return f"{shared_dir(spark)}/tallyloom/{_run}/{name}-{uuid.uuid4().hex}"


def stored(spark: SparkSession, name: str, source: str, make: Callable[[], DataFrame]) -> DataFrame:
    """What make gives, written once per application to a table in the shared folder and read back by all who ask for the same name and source. It is made anew when the files at the
    source, a path, have changed."""
    p = spark._jvm.org.apache.hadoop.fs.Path(source)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    files = fs.listStatus(p)
    key = (spark.sparkContext.applicationId, name, source, tuple(sorted((str(f.getPath()), f.getLen(), f.getModificationTime()) for f in files)))
    if key not in _stored:
        path = new_path(spark, name)
        df = make()
        df.write.option("compression", "zstd").parquet(path)
        _stored[key] = (path, df.schema)
    path, schema = _stored[key]
    return spark.read.schema(schema).parquet(path)


def release_tables(spark: SparkSession, keep_stored: bool = False) -> None:
    """Deletes the tables that queries of this application left in the shared folder; keep_stored: but those of ``stored``. Frames that still read them must not be used any more."""
    while _tables:
        spark.sql(f"DROP TABLE IF EXISTS {_tables.pop()}")
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/tallyloom/{_run}")
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not keep_stored:
        _stored.clear()
        fs.delete(path, True)
    elif fs.exists(path):
        kept = {p.rsplit("/", 1)[1] for p, _ in _stored.values()}
        for f in fs.listStatus(path):
            if f.getPath().getName() not in kept:
                fs.delete(f.getPath(), True)


def materialize(df: DataFrame, name: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """df, written once to a table in the shared folder and read back.

    It cuts the lineage so that a lost executor costs one task's work, computes a frame that is used twice only once, and gives the optimiser its true size.
    """
    path = new_path(df.sparkSession, name)
    w = df.write.option("compression", "zstd")
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)
    fields = [f for f in df.schema.fields if f.name not in partition_by] + [f for f in df.schema.fields if f.name in partition_by]
    return df.sparkSession.read.schema(type(df.schema)(fields)).parquet(path)


def bucketed(df: DataFrame, name: str, key: str) -> DataFrame:
    """df, written once to a table in the shared folder that is bucketed by key into ``spark.sql.shuffle.partitions`` buckets, and read back: aggregates and joins by key of what is read
    from it need no shuffle."""
    spark = df.sparkSession
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    table = f"tallyloom_{name.replace('-', '_')}_{uuid.uuid4().hex}"
    df.repartition(n, key).write.option("compression", "zstd").option("path", new_path(spark, name)).bucketBy(n, key).sortBy(key).saveAsTable(table)
    _tables.append(table)
    return spark.table(table)


def spread(df: DataFrame, key: str) -> DataFrame:
    """df in as many partitions as there are cores at least, for work in Python that costs far more than the shuffle; unchanged if it has them already."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(2 * cores, key)


def ship_package(spark: SparkSession) -> None:
    """Sends this package to the executors, once per application; a local master needs nothing."""
    sc = spark.sparkContext
    if sc.master.startswith("local[") or sc.master == "local" or getattr(sc, "_tallyloom_shipped", False):
        return
    root = Path(__file__).parent
    folder = tempfile.mkdtemp(prefix="tallyloom-ship-")  # the driver's own; executors fetch the file from it
    atexit.register(shutil.rmtree, folder, True)
    path = Path(folder) / "tallyloom.zip"
    with zipfile.ZipFile(path, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    sc.addPyFile(str(path))
    sc._tallyloom_shipped = True
    log.info("shipped %s", path)
