"""Tables as folders of snapshots, replaced whole, and the merges that make the next snapshot."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def insert_ignore(old: DataFrame, new: DataFrame, key: str, order: list[str]) -> DataFrame:
    """old, and of new the first row of each key that old hasn't got. Rows whose key is null are left out."""
    rest = [c for c in new.columns if c != key]
    first = new.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(F.struct(*order, *[c for c in rest if c not in order])).alias("m"))
    first = first.select(key, *[F.col("m")[c].alias(c) for c in rest])
    return old.unionByName(first.join(old.select(key), key, "left_anti").select(*old.columns))


def upsert(old: DataFrame, new: DataFrame, key: str, keep_old: tuple[str, ...] = ()) -> DataFrame:
    """old with new merged by key: new values where they aren't null, but old ones first for `keep_old`."""
    a, b = old.alias("a"), new.alias("b")

    def merged(c: str) -> Column:
        x, y = F.col(f"a.{c}"), F.col(f"b.{c}")
        return F.coalesce(x, y) if c in keep_old or c == key else F.coalesce(y, x)

    return a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}"), "full").select(*[merged(c).alias(c) for c in old.columns])


def write_snapshot(df: DataFrame, folder: str, number: int) -> str:
    """Writes snapshot `number` of a table; a retry of the same number replaces it, so a repeated batch changes nothing."""
    path = f"{folder}/snapshot={number:012d}"
    df.write.mode("overwrite").parquet(path)
    return path


def exists(spark: SparkSession, folder: str) -> bool:
    """Whether a folder holds anything that was written whole."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/_SUCCESS")
    return bool(path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path))


def latest_snapshot(spark: SparkSession, folder: str) -> DataFrame | None:
    """The newest whole snapshot (one with its success mark), None without any."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop
    root = hadoop.fs.Path(folder)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return None
    names = sorted(s.getPath().toString() for s in fs.listStatus(root) if fs.exists(hadoop.fs.Path(s.getPath(), "_SUCCESS")))
    return spark.read.parquet(names[-1]) if names else None


def upsert_entities(old: DataFrame, new: DataFrame, name: str = "canonical_name", number: str = "knowledge_id") -> DataFrame:
    """old and, of new, the entities whose name old hasn't got: one a name, that with the first number; rows without a name are left out."""
    return insert_ignore(old.select(name, number), new.select(name, number), name, [number])


def append_ledger(rows: DataFrame, folder: str) -> None:
    """Adds rows to a ledger, one JSON object a line; what is there is never changed."""
    rows.write.mode("append").json(folder)


def write_report(row: DataFrame, folder: str) -> None:
    """Replaces a report by one of a few rows, as one file of JSON lines."""
    row.coalesce(1).write.mode("overwrite").json(folder)
