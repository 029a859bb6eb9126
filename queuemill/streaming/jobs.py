"""Structured Streaming jobs; each equals its batch form once the input is read.

Every micro-batch writes under its own batch number, so a batch that is run again after a failure
replaces what it wrote before.
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StringType, StructField, StructType

from queuemill.operators import decisions as D
from queuemill.operators import lifecycle as L
from queuemill.sources.io import is_missing
from queuemill.streaming import ticket_state as TS

TS_READS = ("event_id", "ticket_id", "at", "kind", "to_team", "category", "detail", "resolution")


def read_stream(spark: SparkSession, path: str, schema: StructType, kind: str = "json", files_per_batch: int = 1000) -> DataFrame:
    """Files as they arrive; half-written JSON lines are skipped as in the batch scan."""
    reader = spark.readStream.option("maxFilesPerTrigger", files_per_batch).format(kind)
    if kind != "json":
        return reader.schema(schema).load(path)
    with_bad = StructType([*schema.fields, StructField("_corrupt_record", StringType())])
    return reader.schema(with_bad).load(path).where(F.col("_corrupt_record").isNull()).drop("_corrupt_record")


def start(stream: DataFrame, each_batch, checkpoint: str, mode: str = "append") -> StreamingQuery:
    return (stream.writeStream.outputMode(mode).foreachBatch(each_batch)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def stream_decision_summary(decisions: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """The running summary under its batch number; `latest_batch` reads the newest whole one."""
    def write(batch: DataFrame, number: int):
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")
    return start(D.summary(decisions), write, checkpoint, mode="complete")


def latest_batch(spark: SparkSession, path: str) -> DataFrame:
    log = spark.read.parquet(path)
    newest = log.agg(F.max("batch")).first()[0]
    return log.where(F.col("batch") == newest).drop("batch")


def state_log(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except Exception as error:
        if is_missing(error) or "UNABLE_TO_INFER_SCHEMA" in str(error):
            return None
        raise


def latest_state(log: DataFrame) -> DataFrame:
    """One row per ticket: the one of the newest batch that touched it."""
    rest = [c for c in L.FOLDED if c != "ticket_id"]
    last = log.groupBy("ticket_id").agg(F.max_by(F.struct(*rest), "batch").alias("s"))
    return last.select("ticket_id", "s.*")


#: Keyed state needs RocksDB. Timers fire in batches that have data: without it a run over what is there would never end.
KEYED = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
         "spark.sql.streaming.noDataMicroBatches.enabled": "false"}


def stream_ticket_state(events: DataFrame, log_path: str, checkpoint: str, keep: int = TS.KEEP, idle_ms: int = TS.IDLE_MS) -> StreamingQuery:
    """State of the touched tickets after every micro-batch, under its batch number; `TicketState` keeps it by key, so a batch
    reads nothing but its own events. A ticket's events of one batch stream through one task."""
    spark = events.sparkSession
    names = [f.name for f in L.EVENT_SCHEMA.fields if f.name in events.columns and f.name in TS_READS]
    folded = (events.select(*names).where(F.col("ticket_id").isNotNull()).groupBy("ticket_id")
              .transformWithState(TS.TicketState(keep, idle_ms), TS.OUT, "Update", "ProcessingTime"))

    def write(batch: DataFrame, number: int):
        # Written under the batch number: a batch that runs again replaces its first attempt.
        batch.write.mode("overwrite").parquet(f"{log_path}/state/batch={number}")

    before = {key: spark.conf.get(key) for key in KEYED}
    try:
        for key, value in KEYED.items():        # read when the query starts; other queries keep theirs
            spark.conf.set(key, value)
        return start(folded, write, checkpoint, mode="update")
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def scores_of(model: PipelineModel):
    """What a routing bundle says of a batch of arrivals, for `stream_intake`."""
    def score(batch: DataFrame) -> DataFrame:
        scored = model.transform(batch.where("ord IS NOT NULL").withColumn("id", F.col("ord")))
        return scored.select("ord", "category", F.col("team_suggested").alias("team"), F.round("team_suggested_confidence", 4).alias("confidence"))
    return score


def stream_intake(arrivals: DataFrame, score, opened_path: str, events_path: str, checkpoint: str, last_id: int = 0,
                  first_event_id: int = 0, abstain_below: float = L.fixed.ABSTAIN_BELOW,
                  rejected_path: str | None = None) -> StreamingQuery:
    """Arriving tickets scored by `score(batch)` and opened; ids continue from the batches before. Arrivals that open no ticket are
    written to `rejected_path` with the reason."""
    def apply(batch: DataFrame, number: int):
        spark = batch.sparkSession
        log = state_log(spark, opened_path)
        taken = last_id if log is None else log.where(F.col("batch") < number).agg(F.coalesce(F.max("id"), F.lit(last_id))).first()[0]
        opened, events = L.intake(batch, score(batch), taken, first_event_id + 2 * (taken - last_id), abstain_below)
        opened.write.mode("overwrite").parquet(f"{opened_path}/batch={number}")
        if rejected_path:
            L.rejected(batch).write.mode("overwrite").parquet(f"{rejected_path}/batch={number}")
        events.write.mode("overwrite").parquet(f"{events_path}/batch={number}")
    return start(arrivals, apply, checkpoint)
