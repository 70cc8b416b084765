"""The transcript table, kept as an append-only log of writes.

Every streaming query (known by its checkpoint) has a folder of its own, `run=<id>`,
and every micro-batch of it a folder `write=N` in there, so a batch that is replayed
after a failure replaces its own files and nothing else: a new query on the same table
adds to what is there. `version` says when a batch was written and orders runs; readers
resolve repeated keys (the first write fixes a row, later ones change the translation).
`compact` folds the log into a snapshot, which comes before every run.
"""

from __future__ import annotations

import hashlib
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phrasestream import schemas
from phrasestream.operators.ledger import resolve_transcripts, tenant_scope

SNAPSHOT = "snapshot"


def write_batch(rows: DataFrame, path: str, batch_id: int, run: str = "batch", version: int | None = None) -> None:
    """`rows` may carry `write_seq` to order repeated keys inside the batch."""
    if "write_seq" not in rows.columns:
        rows = rows.withColumn("write_seq", F.lit(0).cast("bigint"))
    written = int(time.time() * 1000) if version is None else version
    rows.withColumn("version", F.lit(written).cast("bigint")).write.mode("overwrite").partitionBy("tenant_id").parquet(
        f"{path}/run={run}/write={batch_id:09d}")


def transcript_sink(stream: DataFrame, path: str, checkpoint: str, **trigger):
    """Start a streaming query that upserts into the table at `path`."""
    run = hashlib.sha256(checkpoint.encode()).hexdigest()[:16]
    return (
        stream.writeStream.foreachBatch(lambda rows, batch_id: write_batch(rows, path, batch_id, run))
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def read_transcripts(spark: SparkSession, path: str, tenant_id=None, all_tenants: bool = False) -> DataFrame:
    """The resolved table for one tenant (or, explicitly, all of them)."""
    log = spark.read.schema(
        schemas.TRANSCRIPTS + ", write_seq bigint, version bigint, run string, write bigint"
    ).parquet(path)
    rows = log if all_tenants else tenant_scope(log, tenant_id)
    return resolve_transcripts(rows, ["version", "run", "write", "write_seq"])


def compact(spark: SparkSession, path: str, target: str) -> None:
    """Write the resolved table to `target` (a fresh path) as its snapshot."""
    write_batch(read_transcripts(spark, path, all_tenants=True), target, 0, run=SNAPSHOT, version=0)
