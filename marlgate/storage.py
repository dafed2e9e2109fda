"""Intermediate tables in the folder that the cluster shares."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Only where the session names none and all its tasks run on this machine (tests, a local shell) a temporary folder is made and
    noted in the session.  On a cluster that would be another folder on every machine, so it is an error there.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if found:
        return found
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError(f"spark.checkpoint.dir has to name a folder that all machines share (master is {master})")
    own = tempfile.mkdtemp(prefix="marlgate-")
    atexit.register(shutil.rmtree, own, True)
    spark.conf.set("spark.checkpoint.dir", own)
    return own


def own_dir(spark: SparkSession) -> str:
    """The folder of this application's intermediate tables."""
    return f"{shared_dir(spark).rstrip('/')}/marlgate/{spark.sparkContext.applicationId}"


def cut(df: DataFrame, name: str, by: str | None = None, parts: int = 0) -> DataFrame:
    """Writes ``df`` as Parquet in the shared folder and reads it back: later stages restart from the files, not from the lineage.

    With ``by`` it is a table of ``parts`` buckets by that column: what joins and groups by it later moves no rows.  Rows that lie so
    already are not moved here either.  Lazy results read these files, so they stay until ``clear``.
    """
    spark = df.sparkSession
    path = f"{own_dir(spark)}/{uuid.uuid4().hex}/{name}"
    if by is None:
        df.write.option("compression", "zstd").parquet(path)
        return spark.read.schema(df.schema).parquet(path)
    table = f"{_TABLES}{uuid.uuid4().hex}"
    dealt = df.repartition(parts, by)
    dealt.write.format("parquet").option("compression", "zstd").option("path", path).bucketBy(parts, by).saveAsTable(table)
    return spark.table(table)


def unbucketed(table: DataFrame) -> DataFrame:
    """The rows of a bucketed ``cut`` as plain files."""
    return table.sparkSession.read.schema(table.schema).parquet(table.inputFiles()[0].rsplit("/", 1)[0])


# Names of bucketed tables begin so; their files lie in the shared folder.
_TABLES = "marlgate_cut_"


def file_bytes(spark: SparkSession, path: str) -> int:
    """The size of a table's files."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(place).getLength()


def parts_for(spark: SparkSession, size: int, each: int = 2 * 1024 * 1024) -> int:
    """A number of partitions that grows with the input, so that a partition does not: the session's own at least."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // each))


def clear(spark: SparkSession) -> None:
    """Deletes the intermediate tables of this application: to be called once its results are written."""
    for name in spark.catalog.listTables(pattern=f"{_TABLES}*"):
        spark.sql(f"DROP TABLE IF EXISTS {name.name}")
    path = spark._jvm.org.apache.hadoop.fs.Path(own_dir(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
