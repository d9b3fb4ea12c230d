"""Follow a growing table: every micro-batch becomes a run of an interval ledger.

Structured Streaming remembers which files it has listed, the ledger which records were processed. A micro-batch that is
replayed after a failure, or from a lost checkpoint, finds its numbers in the ledger and processes nothing twice; records
whose batch failed are pending in the next one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from weftgraph.operators.intervals import IncrementalRun
from weftgraph.session import shared_dir


def follow(spark: SparkSession, path: str, schema: StructType, run: IncrementalRun, process: Callable[[DataFrame], DataFrame], name: str, once: bool = True) -> StreamingQuery:
    """Start processing the parquet files under ``path``: all that are there now (``once``), or on and on.

    The stream's own state lies under ``name`` in the folder that all executors share. Empty batches make no run.
    """

    def batch(df: DataFrame, _: int) -> None:
        if not df.isEmpty():
            run.run(df, process)

    writer = spark.readStream.schema(schema).parquet(path).writeStream.foreachBatch(batch).option("checkpointLocation", f"{shared_dir(spark).rstrip('/')}/{name}")
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="1 minute")).start()
