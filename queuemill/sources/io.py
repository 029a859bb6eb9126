"""Reading and writing: the ticket export, the append-only logs, results, predictions and bundles."""

from __future__ import annotations

from functools import reduce

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from queuemill.operators import decisions as D
from queuemill.operators.lifecycle import EVENT_SCHEMA

# Column names of the ticket export and of the relevance key.
EXPORT_COLUMNS = {
    "Ticket ID": "ticket_id", "Subject": "subject", "Description": "description", "Category": "category",
    "Subcategory": "subcategory", "Department": "department", "Assigned Resolver": "resolver",
    "Assigned Team": "team", "Status": "status", "Resolution Notes": "resolution", "Created": "created",
    "Resolved": "resolved", "Reassigned": "reassigned"}
TRUTH_COLUMNS = ("Ticket ID", "latent_problem_id", "had_context", "true_category")

_S, _B, _D = T.StringType(), T.BooleanType(), T.DoubleType()
DECISION_SCHEMA = T.StructType([T.StructField(n, t) for n, t in (
    ("decision_id", T.LongType()), ("at", _S), ("arm", _S), ("db_ref", _S), ("actor", _S), ("subject", _S), ("description", _S),
    ("suggested_category", _S), ("chosen_category", _S), ("suggested_team", _S), ("chosen_team", _S), ("resolution_used", _S),
    ("resolved_with", _S), ("referred_to", _S), ("closed_as_duplicate_of", _S), ("abstained", _B), ("rejected", _B), ("enriched", _B),
    ("text_before", _S), ("text_after", _S), ("confidence_before", _D), ("confidence_after", _D), ("confidence_category", _D),
    ("confidence_team", _D), ("category_overridden", _B), ("team_overridden", _B))])
EXAMPLE_SCHEMA = T.StructType([T.StructField(n, t) for n, t in (
    ("at", _S), ("arm", _S), ("subject", _S), ("description", _S), ("category", _S), ("assigned_team", _S), ("provenance", _S),
    ("rejected_only", _B), ("confidence_before", _D), ("confidence_after", _D), ("text", _S))])
CSV = {"header": "true", "multiLine": "true", "escape": '"', "quote": '"',
       "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}


def is_missing(error: Exception) -> bool:
    return "PATH_NOT_FOUND" in str(error)


def scan_corpus_csv(spark: SparkSession, path: str, columns=tuple(EXPORT_COLUMNS)) -> DataFrame:
    """Every column as text, absent values as ''. Quoted line breaks keep a file in one task, so an
    export of any size belongs in many files."""
    schema = T.StructType([T.StructField(c, _S) for c in columns])
    return spark.read.schema(schema).options(**CSV).csv(path).na.fill("")


def write_corpus_csv(tickets: DataFrame, path: str) -> None:
    tickets.write.options(**CSV).csv(path)


def scan_json_log(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """JSON Lines; blank and half-written lines are skipped."""
    with_bad = T.StructType([*schema.fields, T.StructField("_corrupt_record", _S)])
    rows = spark.read.schema(with_bad).option("mode", "PERMISSIVE").json(path)
    return rows.where(F.col("_corrupt_record").isNull()).drop("_corrupt_record")


def scan_decision_log(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    rows = scan_json_log(spark, path, DECISION_SCHEMA)
    return D.last_n(rows, limit) if limit else rows


def append_decision_log(entries: DataFrame, path: str) -> None:
    D.validated(entries).write.mode("append").json(path)


def scan_feedback(spark: SparkSession, path: str) -> DataFrame:
    try:
        return scan_json_log(spark, path, EXAMPLE_SCHEMA)
    except Exception as error:
        if not is_missing(error):
            raise
        return spark.createDataFrame([], EXAMPLE_SCHEMA)


def append_feedback(examples: DataFrame, path: str) -> None:
    """Adds the examples the store does not hold yet."""
    fresh = D.promote_new(examples, scan_feedback(examples.sparkSession, path))
    fresh.write.mode("append").json(path)


def write_result_table(df: DataFrame, path: str, kind: str = "csv") -> None:
    writer = df.write.mode("overwrite")
    writer.option("header", "true").csv(path) if kind == "csv" else writer.parquet(path)


def publish_predictions(predictions: DataFrame, path: str) -> None:
    """ticket_id, fold, class, score ... by model: downstream jobs read only the model they need.

    Publishing replaces the models it brings and leaves the others."""
    (predictions.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("model").parquet(path))


def read_predictions(spark: SparkSession, path: str, job: str, model: str | None = None) -> DataFrame:
    """An upstream table; a missing one names the job to run instead of passing as a result."""
    try:
        rows = spark.read.parquet(path)
    except Exception as error:
        if is_missing(error):
            raise FileNotFoundError(f"no predictions at {path}: run the '{job}' job first") from error
        raise
    return rows.where(F.col("model") == model) if model else rows


def export_findings_json(tables: dict[str, DataFrame]) -> DataFrame:
    """Report-sized tables as one JSON document: {name: [records], ...}."""
    parts = []
    for name, df in tables.items():
        record = F.struct(*[F.col(c) for c in df.columns])
        records = F.to_json(F.sort_array(F.collect_list(record)), {"ignoreNullFields": "false"})
        parts.append(df.agg(F.concat(F.lit(f'"{name}":'), records).alias("part")))
    stacked = reduce(lambda a, b: a.unionByName(b), parts)
    body = F.concat_ws(",", F.sort_array(F.collect_list("part")))
    return stacked.agg(F.concat(F.lit("{"), body, F.lit("}")).alias("document"))


def save_model_bundle(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model_bundle(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def append_events(events: DataFrame, path: str, buckets: int = 64) -> None:
    """The event table, kept in hash buckets of the ticket so that one ticket reads one folder."""
    bucket = F.pmod(F.xxhash64("ticket_id"), F.lit(buckets)).cast("int")
    names = [F.col(f.name) if f.name in events.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in EVENT_SCHEMA.fields]
    # Dealt by bucket first, so that a batch adds one file to a bucket and not one for each task.
    dealt = events.select(*names, bucket.alias("bucket")).repartition(buckets, "bucket")
    dealt.write.mode("append").partitionBy("bucket").parquet(path)


def create_event_table(spark: SparkSession, name: str, path: str, buckets: int = 64) -> None:
    """An event table stored by hash buckets of the ticket, sorted inside them: what groups, windows or joins by ticket over it needs
    no exchange. Another session registers the same folder under a name of its own."""
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in EVENT_SCHEMA.fields)
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet "
              f"CLUSTERED BY (ticket_id) SORTED BY (ticket_id, event_id) INTO {int(buckets)} BUCKETS LOCATION '{path}'")


def append_event_table(events: DataFrame, name: str) -> None:
    """One more file in every bucket; dealt by bucket first, so that a batch adds one file to a bucket and not one for each task."""
    spark = events.sparkSession
    spec = {r.col_name: r.data_type for r in spark.sql(f"DESCRIBE FORMATTED {name}").collect()}
    buckets = int(spec["Num Buckets"])
    names = [F.col(f.name) if f.name in events.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in EVENT_SCHEMA.fields]
    (events.select(*names).repartition(buckets, "ticket_id").write.mode("append").format("parquet")
     .bucketBy(buckets, "ticket_id").sortBy("ticket_id", "event_id").saveAsTable(name))


def compact_event_table(spark: SparkSession, name: str, to_name: str, to_path: str, buckets: int = 64) -> None:
    """The same events with one file in every bucket, each repeated event once."""
    create_event_table(spark, to_name, to_path, buckets)
    append_event_table(spark.table(name).dropDuplicates(["ticket_id", "event_id"]), to_name)


def read_events(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(T.StructType([*EVENT_SCHEMA.fields, T.StructField("bucket", T.IntegerType())])).parquet(path).drop("bucket")

