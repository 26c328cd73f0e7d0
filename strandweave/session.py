"""Session settings and the scratch tables that cut lineage between iterative steps."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Settings every job benefits from; a cluster may override any of them.
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
}


#: Bytes of rows that go to a Python worker at a time, unless the session says otherwise: ten thousand whole texts
#: would be held several times over, by the JVM and by the worker.
BATCH_BYTES = {"spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20)}


def local_session(cores: int | str = "*", app: str = "strandweave", **conf: str) -> SparkSession:
    """A local session for tests and benchmarks; clusters bring their own."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    settings = {
        **DEFAULTS,
        "spark.sql.shuffle.partitions": "8",
        "spark.ui.enabled": "false",
        "spark.driver.memory": "12g",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    ship_package(spark)
    return spark


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, wherever the session was started from, and bound what they get at a time."""
    context = spark.sparkContext
    for key, value in BATCH_BYTES.items():
        if spark.conf.get(key, None) is None:
            spark.conf.set(key, value)
    folder = Path(__file__).parent
    if getattr(context, "_strandweave_shipped", False) or not folder.is_dir():
        return
    archive = Path(tempfile.mkdtemp(prefix="strandweave-")) / "strandweave.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for source in sorted(folder.rglob("*.py")):
            out.write(source, source.relative_to(folder.parent))
    context.addPyFile(str(archive))
    context._strandweave_shipped = True


def _scratch_root(spark: SparkSession) -> str:
    """Shared folder named by ``spark.checkpoint.dir``; a temporary one only in local mode."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
    root = tempfile.mkdtemp(prefix="strandweave-")
    spark.conf.set("spark.checkpoint.dir", root)
    return root


def scratch_path(spark: SparkSession) -> str:
    """A new folder name in the shared scratch folder; Spark removes it when the session ends."""
    path = f"{_scratch_root(spark)}/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(hadoop_path)
    fs.deleteOnExit(hadoop_path)
    return path


def save_scratch(df: DataFrame, *partition_by: str) -> DataFrame:
    """Write ``df`` as a parquet table in the shared scratch folder and read it back.

    Unlike a cached block the table survives the loss of executors, its lineage is a plain
    scan, and its size is known to the optimizer when it picks join strategies.
    """
    spark = df.sparkSession
    path = f"{scratch_path(spark)}/table"
    writer = df.write.mode("error")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    saved = spark.read.schema(df.schema).parquet(path)
    saved._scratch_folder = path
    return saved


def drop_scratch(saved: DataFrame) -> None:
    """Remove a table of :func:`save_scratch` that nothing reads any more, before the session ends.

    Spark removes shuffle files of finished steps once the driver has collected their plans, so it is told to.
    """
    spark = saved.sparkSession
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(saved._scratch_folder)
    hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop_path, True)
    spark._jvm.System.gc()


#: Rows (of a few numbers each) up to which a saved table is broadcast into a join.
BROADCAST_ROWS = 2_000_000


def small_side(saved: DataFrame) -> DataFrame:
    """Hint a saved table for broadcasting if it is small enough; otherwise Spark decides."""
    return F.broadcast(saved) if saved.count() <= BROADCAST_ROWS else saved


def spread(df: DataFrame) -> DataFrame:
    """Use every core on an input of a few unsplittable files; large inputs are left alone."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
