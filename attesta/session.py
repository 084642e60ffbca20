"""Session helpers shared by every part of the library."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import SparkSession


CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def local_session(cores: int | str = 8, shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session for tests and the benchmark; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def ship(spark: SparkSession) -> SparkSession:
    """Send this package to the executors once per context, so Python workers can import it anywhere."""
    sc = spark.sparkContext
    if getattr(sc, "_attesta_shipped", False):
        return spark
    here = os.path.dirname(os.path.abspath(__file__))
    target = os.path.join(tempfile.mkdtemp(prefix="attesta-"), "attesta_pkg.zip")
    with zipfile.ZipFile(target, "w") as z:
        for folder, _, names in os.walk(here):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.join("attesta", os.path.relpath(full, here)))
    sc.addPyFile(target)
    sc._attesta_shipped = True
    return spark


def shared_dir(spark: SparkSession) -> str:
    """A fresh path under the folder that driver and executors share (``spark.checkpoint.dir``).

    Where the cluster names none (tests, a laptop), a folder beside the local warehouse is set.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = os.path.join(tempfile.gettempdir(), "attesta-checkpoints")
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{base.rstrip('/')}/attesta-{uuid.uuid4().hex}"


def cut(df, spark: SparkSession | None = None):
    """Materialise ``df`` as Parquet in the shared folder and read it back: lineage ends there.

    The files survive the loss of any executor, unlike a local checkpoint. Shuffle files of the write are not needed
    after it, so Spark is told to delete them at once.
    """
    spark = spark or df.sparkSession
    path = shared_dir(spark)
    before = spark.conf.get(CLEAN_UP, None)
    spark.conf.set(CLEAN_UP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEAN_UP, before or "false")
    return spark.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, *frames) -> None:
    """Delete the files behind frames made by :func:`cut` once nothing reads them any more."""
    for df in frames:
        for f in df.inputFiles()[:1]:
            folder = spark._jvm.org.apache.hadoop.fs.Path(f).getParent()
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
