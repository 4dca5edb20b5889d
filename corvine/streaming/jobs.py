"""Structured Streaming: incremental ingestion, request metrics, task states and rolling latency."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from corvine.operators import lexindex
from corvine.storage import shared_dir


def place(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/corvine/{name}-{uuid.uuid4().hex}"


def table_stream(spark: SparkSession, sf_dir: str, name: str, files_per_trigger: int = 1) -> DataFrame:
    """A table of a data folder as a stream of files."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").parquet(f"{sf_dir}/{name}*")


def request_rates(events: DataFrame, window: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Requests, mean latency and hits per window of event time; state is dropped behind the watermark."""
    e = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return e.groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("requests"), F.round(F.avg("value"), 4).alias("latency")).select(F.col("w.start").alias("start"), "event_type", "requests", "latency")


def run_to_end(stream: DataFrame, mode: str, spark: SparkSession, name: str) -> DataFrame:
    """Process what is there, then return the last complete result (``complete``) or all rows (``append``)."""
    out = place(spark, name)

    def put(batch: DataFrame, n: int) -> None:
        # a batch that is repeated after a failure replaces what it wrote
        batch.write.mode("overwrite").parquet(out if mode == "complete" else f"{out}/batch={n}")

    q = stream.writeStream.outputMode(mode).foreachBatch(put).option("checkpointLocation", place(spark, f"{name}-state")).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out).select(*stream.columns)


def ingest(docs: DataFrame, postings_path: str, checkpoint: str):
    """Documents (tenant_id, doc_id, text) into the table of counted documents: a row each, with its terms and their frequencies.

    A batch appends its rows, without a shuffle, under its own batch number, so a repeated batch overwrites itself and
    nothing is counted twice; readers keep the latest version of a document. A version without tokens is a row without terms, so that it too
    replaces the one before.
    """

    def put(batch: DataFrame, n: int) -> None:
        lexindex.counted(batch).withColumn("version", F.lit(n).cast("long")).write.mode("overwrite").parquet(f"{postings_path}/batch={n}")

    return docs.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(rows: DataFrame) -> DataFrame:
    """Postings of the latest version of each document."""
    last = rows.groupBy("tenant_id", "doc_id").agg(F.max("version").alias("version"))
    late = last.filter("version > 0").limit(1).count() > 0  # a single batch has but one version of each
    kept = rows.join(last, ["tenant_id", "doc_id", "version"], "left_semi") if late else rows
    each = kept.select("tenant_id", "doc_id", "len", F.explode(F.arrays_zip("terms", "tfs")).alias("_p"))
    return each.select("tenant_id", F.col("_p.terms").alias("term"), "doc_id", "len", F.col("_p.tfs").cast("long").alias("tf"))


#: States of an ingestion task and its progress.
STEPS = [("QUEUED", 0), ("EXTRACTING", 5), ("CHUNKING", 15), ("GRAPH_EXTRACTION", 35), ("INDEXING", 55), ("SAVING", 90), ("COMPLETED", 100)]
TASK = "task_id long, status string, progress int, events long"


def task_states(events: DataFrame) -> DataFrame:
    """``events``: task_id, step (number of the step reached), failed. The state only moves forward; a failure is final."""

    def advance(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        step, failed, n = state.get if state.exists else (0, False, 0)
        for part in parts:
            step, failed, n = max(step, int(part["step"].max())), failed or bool(part["failed"].any()), n + len(part)
        state.update((step, failed, n))
        name, progress = STEPS[min(step, len(STEPS) - 1)]
        yield pd.DataFrame({"task_id": [key[0]], "status": ["FAILED" if failed else name], "progress": [progress], "events": [n]})

    return events.groupBy("task_id").applyInPandasWithState(advance, TASK, "step int, failed boolean, n long", "append", GroupStateTimeout.NoTimeout)


def rolling_latency(events: DataFrame, n: int = 100) -> DataFrame:
    """``events``: user_id, at, value. Mean of the last ``n`` values of each user, by state of at most ``n`` numbers."""

    def roll(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = list(state.get[0]) if state.exists else []
        for part in parts:
            held = (held + part.sort_values("at")["value"].tolist())[-n:]
        state.update((held,))
        yield pd.DataFrame({"user_id": [key[0]], "latency_ms": [round(sum(held) / len(held), 1)], "held": [len(held)]})

    return events.groupBy("user_id").applyInPandasWithState(roll, "user_id long, latency_ms double, held int", "held array<double>", "append", GroupStateTimeout.NoTimeout)
