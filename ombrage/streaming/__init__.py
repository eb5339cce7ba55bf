"""Streaming use of the batch operators.

Counters and merges are per document, so a stream of documents needs no state: each
micro-batch goes through the same operators, detection and substitution in one map.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators.anonymise import pseudonymise


def read_documents(spark: SparkSession, path: str, schema: str = "doc_id long, text string", files_a_trigger: int = 1000) -> DataFrame:
    """Documents as they arrive in a folder of Parquet files."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_trigger).parquet(path)


def anonymise_stream(docs: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, block_list: frozenset[str] = frozenset()) -> StreamingQuery:
    """Each micro-batch detected and anonymised, then given to sink(result, batch id).
    A repeated batch gives the same rows, so an idempotent sink makes it exactly once."""

    def each(batch: DataFrame, number: int) -> None:
        sink(pseudonymise(batch, block_list), number)

    return docs.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
