"""Session helpers: a tuned local session and the shared scratch folder.

Every intermediate table that cuts lineage goes to the folder that the cluster names in
``spark.checkpoint.dir``.  Only on a local master (tests, a laptop) without that setting a folder
of this process is made and used instead; a cluster without it is refused.
"""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

_local_dir: str | None = None
_shipped: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Make this package importable in the session's Python workers, wherever they start.

    Adds a zip of the package to the application once; the driver serves it to the executors.
    """
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        root = os.path.dirname(os.path.abspath(__file__))
        if os.path.isdir(root):  # not when this itself runs from such a zip
            path = os.path.join(tempfile.mkdtemp(prefix="bytefold-code-"), "bytefold_code.zip")
            with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as out:
                for folder, _, files in os.walk(root):
                    for name in sorted(f for f in files if f.endswith(".py")):
                        full = os.path.join(folder, name)
                        out.write(full, os.path.relpath(full, os.path.dirname(root)))
            spark.sparkContext.addPyFile(path)
        _shipped.add(app)
    return spark


def local_session(cores: int = 8, partitions: int = 8, app: str = "bytefold", memory: str = "8g") -> SparkSession:
    """A local session with the settings the library expects (UTC, AQE, Arrow)."""
    return ship(
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share; made here only on a local master that names none."""
    global _local_dir
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if _local_dir is None:
        _local_dir = "file://" + tempfile.mkdtemp(prefix="bytefold-")
    return _local_dir


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder, removed when the driver ends."""
    path = f"{shared_dir(spark)}/bytefold/{label}-{uuid.uuid4().hex}"
    atexit.register(remove_path, spark, path)
    return path


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there, by the Hadoop file system."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)


def remove_path(spark: SparkSession, path: str) -> None:
    """Delete a folder through the Hadoop file system; a stopped session is no error."""
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session may be gone at exit
        pass


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    This cuts the lineage with a table that survives the loss of any executor.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, key: str) -> DataFrame:
    """A scan in at least as many partitions as there are cores.

    A file of few row groups is read by few tasks, however much work its rows make.  Where the
    scan gives fewer partitions than cores (a small file, never a large table) the rows are
    spread by a unique key; otherwise the scan is left as it is.  Only for plans without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(2 * cores, key) if df._jdf.queryExecution().toRdd().getNumPartitions() < cores else df


def table(spark: SparkSession, sf_dir: str, name: str, spread_by: str | None = None) -> DataFrame:
    """One table of a data folder (a file or a folder of part files)."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df, spread_by) if spread_by else df
