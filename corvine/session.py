"""Session settings the engine is tuned for; an existing session is used as it is."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_session(master: str = "local[8]", shuffle_partitions: int = 8, **more: str) -> SparkSession:
    conf = SETTINGS | {"spark.sql.shuffle.partitions": str(shuffle_partitions), "spark.driver.memory": "8g"} | more
    builder = SparkSession.builder.master(master).appName("corvine")
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ship(spark)
    return spark


_shipped: set[str] = set()


#: Rows of a batch that a Python worker holds; texts may be long, so the default of 10,000 is too many.
BATCH_ROWS = "1024"


def ship(spark: SparkSession) -> None:
    """Send the package to the executors once per application, so that their Python workers import it."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        _shipped.add(app)
        here = os.path.dirname(os.path.abspath(__file__))
        folder = tempfile.mkdtemp(prefix="corvine-zip-")
        atexit.register(shutil.rmtree, folder, True)
        copy = os.path.join(folder, "tree")
        shutil.copytree(here, os.path.join(copy, "corvine"), ignore=shutil.ignore_patterns("__pycache__"))
        spark.sparkContext.addPyFile(shutil.make_archive(os.path.join(folder, "corvine_package"), "zip", copy))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables of a data folder; the path may be in any store Spark reads."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
