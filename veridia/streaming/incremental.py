"""Results that keep arriving: the same operators over a stream of files, batch by batch.

The engine's inputs are files that grow by whole files. A stream reads each of
them once, whatever was read before the last stop, and keyed appends make a batch
that is repeated after a failure harmless.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.semantics import truthy
from ..sources.writers import append_new


def follow_json_lines(spark: SparkSession, path: str, schema: str, files_at_once: int = 1000) -> DataFrame:
    """A stream of the JSON Lines files that appear in a folder, of at most so many files a batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).option("pathGlobFilter", "*.jsonl*").json(path)


def append_results(stream: DataFrame, path: str, keys: list[str], checkpoint: str) -> StreamingQuery:
    """Append the stream's rows whose key is not in ``path`` yet, until all files at hand are read."""

    def write(batch: DataFrame, _: int) -> None:
        append_new(batch, path, keys)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def running_funnel(stream: DataFrame) -> DataFrame:
    """Rows, compiled and executed ones per configuration so far; for output in complete or update mode."""
    keys = [F.coalesce(F.col(c), F.lit("?")).alias(n) for c, n in (("model_id", "model"), ("prompt_template", "strategy"))]
    n = lambda c: F.count(F.when(truthy(c), 1))
    return stream.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"), n("compile_passed").alias("compiled"), n("execution_passed").alias("executed"))
