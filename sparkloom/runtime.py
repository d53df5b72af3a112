"""Session helpers: where rounds of iterative jobs are written, and how tables are read."""

from __future__ import annotations

import os
import tempfile
import uuid
import warnings
import zipfile

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """Folder that every executor can read, taken from ``spark.checkpoint.dir``.

    Where the session leaves it unset a temporary folder is made on a local master (tests, a single machine);
    on a cluster that is an error, as no machine's own folder would outlive it or be seen by the others.
    """
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        jdir = spark.sparkContext._jsc.sc().getCheckpointDir()
        root = jdir.get() if jdir.isDefined() else None
    if not root:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir is not set: name a folder that all executors can read")
        root = "file://" + tempfile.mkdtemp(prefix="sparkloom-")
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def _fs_path(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def remove_path(spark: SparkSession, path: str) -> None:
    """Delete a folder written by :func:`materialize`; a missing one is no error, one that cannot be deleted gives a warning."""
    try:
        fs, p = _fs_path(spark, path)
        fs.delete(p, True)
    except Py4JJavaError as e:
        warnings.warn(f"{path} was not removed: {e.java_exception}", stacklevel=2)


def path_exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs_path(spark, path)
    return fs.exists(p)


def delete_on_exit(spark: SparkSession, path: str) -> None:
    """Lets a folder go with the driver; it must be there by now."""
    fs, p = _fs_path(spark, path)
    fs.deleteOnExit(p)


def list_names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none where it is missing."""
    fs, p = _fs_path(spark, path)
    return [x.getPath().getName() for x in fs.listStatus(p)] if fs.exists(p) else []


class Materialized:
    """A table written to the shared folder: lineage ends at its files, which outlive any executor."""

    def __init__(self, df: DataFrame, path: str):
        self.df, self.path = df, path

    def drop(self) -> None:
        remove_path(self.df.sparkSession, self.path)


def materialize(df: DataFrame, name: str = "round") -> Materialized:
    """Write ``df`` once as parquet below the shared folder and read it back.

    Used in place of ``checkpoint()`` in loops: the plan runs once and not twice, and the files hold
    statistics for the next plan. Superseded rounds are dropped by the caller.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/sparkloom-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    delete_on_exit(spark, path)  # what no caller drops goes with the driver, on any file system
    return Materialized(spark.read.schema(df.schema).parquet(path), path)


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors once per application, so that their Python workers can import it."""
    sc = spark.sparkContext
    if getattr(sc, "_sparkloom_shipped", False):
        return
    here = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="sparkloom-"), "sparkloom_package.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(here):
            for n in sorted(names):
                if n.endswith(".py"):
                    full = os.path.join(folder, n)
                    z.write(full, os.path.join("sparkloom", os.path.relpath(full, here)))
    sc.addPyFile(path)
    sc._sparkloom_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one table of a data folder; files or folders ``<name>.parquet``.

    Unions in a plan are kept from passing on their inputs' partitioning: with adaptive coalescing the two
    sides of a later join could otherwise have different numbers of partitions and the join fail.
    """
    spark.conf.set("spark.sql.unionOutputPartitioning", "false")
    ship(spark)
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def build_session(cpus: str = "*", app: str = "sparkloom", **conf: str) -> SparkSession:
    """Local session with the settings the tests and the bench use."""
    b = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for k, v in conf.items():
        b = b.config(k, v)
    s = b.getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    return s
