"""Incremental runs by Structured Streaming: what a batch run gives, file by file, resumed exactly."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans.pipeline import Options, enrich
from ..sources.bookmarks import BOOKMARK

STORE, ROCKS = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def start(spark: SparkSession, source: str, target: str, checkpoint: str, options: Options = Options(), schema=BOOKMARK, files_per_batch: int = 1000, forget_after: str | None = None) -> StreamingQuery:
    """Processes the JSON-lines files that are new in `source`, each id once over all runs, and appends to `target`.

    The ids seen are streaming state in `checkpoint`, with the files read, so a run that is stopped or loses executors
    goes on where it was, and a second run without new files writes nothing. Both folders must be shared. That state
    grows with the ids; where an id comes again only within a known time, forget_after (such as "7 days" since it was
    read) bounds it. State lives in RocksDB on the executors' disks unless the session names another store.
    """
    if not spark.conf.get(STORE, ""):
        spark.conf.set(STORE, ROCKS)
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).json(source)
    rows = rows.where("id is not null")
    if forget_after is None:
        fresh = rows.dropDuplicates(["id"])
    else:
        fresh = rows.withColumn("_read_at", F.current_timestamp()).withWatermark("_read_at", forget_after).dropDuplicatesWithinWatermark(["id"]).drop("_read_at")
    return enrich(fresh, options).writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start(target)
