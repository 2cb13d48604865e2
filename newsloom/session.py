"""Session settings every operator relies on."""

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share, as the cluster names it in spark.checkpoint.dir.

    Only where that setting is absent and all is on one machine is a folder of our own made; on a
    cluster each executor would write to its own disk, so there it is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    given = spark.sparkContext._jsc.sc().getCheckpointDir()
    if not named and given.isDefined():  # set on the context by the caller
        return given.get()
    if not named:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = "file://" + os.path.join(tempfile.gettempdir(), "newsloom-checkpoints")
    return named


def cut(df: DataFrame, eager: bool = True) -> DataFrame:
    """df with its lineage cut by a checkpoint in the shared folder."""
    spark = df.sparkSession
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_folder(spark))
    return df.checkpoint(eager)


#: A side of a join of at most so many short rows is broadcast; a larger one is shuffled.
BROADCAST = 200_000


def small(df: DataFrame) -> DataFrame:
    """df for the smaller side of a join: written and counted first, and broadcast only if the count allows that."""
    df = cut(df)
    return F.broadcast(df) if df.count() <= BROADCAST else df


def counted(df: DataFrame) -> DataFrame:
    """As small(), but a side that the count forbids to broadcast is merged, whatever Spark estimates of its size."""
    df = cut(df)
    return F.broadcast(df) if df.count() <= BROADCAST else df.hint("merge")


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the workers, once a Spark application, where their search path hasn't got it."""
    root = Path(__file__).resolve().parents[1]
    paths = {Path(p).resolve() for p in [*os.environ.get("PYTHONPATH", "").split(os.pathsep), os.getcwd()] if p}
    application = spark.sparkContext.applicationId
    if root in paths or application in _shipped:
        return
    package = Path(tempfile.mkdtemp()) / "newsloom.zip"  # on the driver, which serves it to all executors
    with zipfile.ZipFile(package, "w") as held:
        for path in sorted((root / "newsloom").rglob("*.py")):
            held.write(path, path.relative_to(root))
    spark.sparkContext.addPyFile(str(package))
    _shipped.add(application)


def local(cores: str = "8", partitions: int = 8) -> SparkSession:
    """A session on this machine, for tests and the bench."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("newsloom")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark
