"""Structured Streaming ingest: the batch source mapping and tokenisation
applied incrementally to files as they land.

The reference reads one file whole; this is the same operator chain (S1 -
S4, F1 - F3, T*) run by ``readStream`` over a folder, so new files are
processed once, exactly, with progress kept in a checkpoint folder on
shared storage.  Output goes through ``foreachBatch`` to a table folder.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators import clean as C


def stream_posts(spark: SparkSession, path: str, schema, fmt: str = "parquet",
                 text_col: str = "post_content", id_col: str | None = None,
                 max_files_per_trigger: int | None = None) -> DataFrame:
    """Streaming posts -> LDA tokens (>= min tokens), same expressions as batch."""
    r = spark.readStream.schema(schema).format(fmt)
    if fmt == "csv":
        r = r.option("header", True).option("multiLine", True).option("escape", '"')
    if fmt == "json":
        r = r.option("mode", "DROPMALFORMED")
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    src = r.load(path)
    if id_col and id_col != "post_id":
        src = src.withColumnRenamed(id_col, "post_id")
    return C.lda_tokenize(src, text_col=text_col)


def run_to_table(stream: DataFrame, out_path: str, checkpoint: str,
                 available_now: bool = True) -> StreamingQuery:
    """Write each micro-batch to ``out_path/batch_id=N``; a replayed batch
    overwrites its own folder, so retries never duplicate rows."""
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(os.path.join(out_path, f"batch_id={batch_id}"))

    w = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()


def checkpoint_subdir(spark: SparkSession, name: str) -> str:
    """A folder under the session's shared checkpoint dir."""
    from ..session import ensure_checkpoint_dir
    return os.path.join(ensure_checkpoint_dir(spark), "postlens-stream", name)
