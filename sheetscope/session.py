"""Session settings and the checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A session for tests and benchmarks; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("sheetscope")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The session's own folder inside the checkpoint folder.

    The cluster names it in ``spark.checkpoint.dir``. Where it is unset, a folder on the
    session's default file system is set. On a local file system only a local session
    may do so: the executors of a cluster do not see each other's disks.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        context.setCheckpointDir(named or _default_folder(spark))
    return context.getCheckpointDir()


def _default_folder(spark: SparkSession) -> str:
    """A checkpoint folder on the default file system, which all executors must share."""
    context = spark.sparkContext
    system = context._jsc.hadoopConfiguration().get("fs.defaultFS", "file:///")
    if system.startswith("file:"):
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        return tempfile.mkdtemp(prefix="sheetscope-")
    return f"{system.rstrip('/')}/user/{context.sparkUser()}/sheetscope-checkpoints"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    The rows survive the loss of an executor, are computed once however often they
    are read, and their true size is known to the planner.
    """
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ship_package(spark: SparkSession) -> None:
    """Send this package to the session's Python workers, once a context.

    Workers need not have it installed, nor share the driver's path.
    """
    context = spark.sparkContext
    if getattr(context, "_sheetscope_sent", False):
        return
    home = Path(__file__).parent
    archive = Path(tempfile.mkdtemp(prefix="sheetscope-")) / "sheetscope.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for source in sorted(home.rglob("*.py")):
            z.write(source, source.relative_to(home.parent))
    context.addPyFile(str(archive))
    context._sheetscope_sent = True
