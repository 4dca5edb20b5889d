"""Where intermediate tables go: one shared folder that driver and executors all reach.

Lineage is cut by writing a Parquet table under ``spark.checkpoint.dir`` and reading it back, so a
lost executor costs a re-read and not a recomputation. Only where that setting is absent (tests,
notebooks) a folder of our own is used.
"""

from __future__ import annotations

import hashlib
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BROADCAST_ROWS = 100_000
SALTS = 64

_own: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder named by the session, or a private one when the session names none."""
    told = spark.conf.get("spark.checkpoint.dir", "")
    if not told:
        option = spark.sparkContext._jsc.sc().getCheckpointDir()
        told = option.get() if option.isDefined() else ""
    if told:
        return told.rstrip("/")
    if not _own:
        _own.append("file://" + tempfile.mkdtemp(prefix="corvine-"))
    return _own[0]


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read back; same schema."""
    spark, schema = df.sparkSession, df.schema
    path = f"{shared_dir(spark)}/corvine/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def drop_shared(spark: SparkSession, df: DataFrame) -> None:
    """Delete the files behind a table that :func:`written` returned and nobody reads any more."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for parent in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/corvine/" in parent:
            path = jvm.org.apache.hadoop.fs.Path(parent)
            path.getFileSystem(conf).delete(path, True)


def stamp(df: DataFrame) -> str:
    """Digest of the names, sizes and times of the files behind ``df``: another one when they change."""
    spark = df.sparkSession
    conf, path_of = spark.sparkContext._jsc.hadoopConfiguration(), spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    seen = []
    for f in sorted(df.inputFiles()):
        path = path_of(f)
        status = path.getFileSystem(conf).getFileStatus(path)
        seen.append(f"{f} {status.getLen()} {status.getModificationTime()}")
    return hashlib.sha256("\n".join(seen).encode()).hexdigest()


def broadcast_if_small(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` marked for broadcast when it is counted to have at most ``most`` rows; else left to a shuffled join."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def first_rows(df: DataFrame, keys: list[str], order: list[Column], most: int, name: str) -> DataFrame:
    """The first ``most`` rows of each key with their number in column ``name``.

    A key may hold most of the table: every row meets only its salt's rows first, and at most
    ``SALTS * most`` of a key meet in the second step.
    """
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*df.columns), F.lit(SALTS)))
    once = salted.withColumn(name, F.row_number().over(Window.partitionBy(*keys, "_salt").orderBy(*order))).filter(F.col(name) <= most)
    return once.drop(name, "_salt").withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col(name) <= most)
