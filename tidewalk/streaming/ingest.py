"""Event ingestion as Structured Streaming: validate, weigh, store, sessionise, count."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewalk.config import CONFIG
from tidewalk.functions.scalar import interaction_weight
from tidewalk.sources.shared import is_folder, new_path
from tidewalk.sources.tables import as_interactions

LATE = "1 hour"
MAX_DWELL_MS = 4 * 3600 * 1000


def events_stream(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """A stream over the event files of a folder (or one file), typed as the batch reader would.

    files_per_trigger: files of a batch; by default all that are there, so that files in no order of time make no row late.
    """
    schema = spark.read.parquet(path).schema
    stream = spark.readStream.schema(schema)
    if files_per_trigger:
        stream = stream.option("maxFilesPerTrigger", files_per_trigger)
    if is_folder(spark, path):
        return stream.parquet(path)
    folder, _, name = path.rpartition("/")
    return stream.option("pathGlobFilter", name).parquet(folder)


def incoming(events: DataFrame) -> DataFrame:
    """Interactions with an event time that watermarks accept."""
    return as_interactions(events).withColumn("created_at", F.col("created_at").cast("timestamp"))


def validated(rows: DataFrame, catalog: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of known items and types, and the rest with a reason. rows may have dwell_ms."""
    known = catalog.select("project_id", F.lit(True).alias("known"))
    joined = rows.join(known, "project_id", "left")
    dwell = F.col("dwell_ms").between(0, MAX_DWELL_MS) if "dwell_ms" in rows.columns else F.lit(True)
    reason = F.when(interaction_weight(F.col("type")).isNull(), "unknown_type").when(F.col("known").isNull(), "unknown_project").when(~F.coalesce(dwell, F.lit(True)), "dwell_out_of_range")
    judged = joined.withColumn("reason", reason).drop("known")
    return judged.filter("reason is null").drop("reason"), judged.filter("reason is not null")


def session_counts(rows: DataFrame, timeout_minutes: int = CONFIG.session_timeout_minutes) -> DataFrame:
    """Events per user and session; a session stays open for later events until the watermark passes it."""
    session = F.session_window("created_at", f"{timeout_minutes} minutes")
    counts = rows.withWatermark("created_at", LATE).groupBy("user_id", session.alias("session")).agg(F.count("*").alias("n_events"))
    return counts.select("user_id", F.col("session.start").alias("started_at"), F.col("session.end").alias("expires_at"), "n_events")


def running_popularity(rows: DataFrame) -> DataFrame:
    """Evidence of each item so far."""
    positive = rows.filter(F.col("type").isin(*CONFIG.positive))
    return positive.groupBy("project_id").agg(F.sum("weight").alias("evidence"), F.count("*").alias("n_events"))


def deduped_impressions(rows: DataFrame) -> DataFrame:
    """One impression of each item and user within the watermark."""
    return rows.filter("type = 'IMPRESSION'").withWatermark("created_at", LATE).dropDuplicatesWithinWatermark(["user_id", "project_id"])


def drain(stream: DataFrame, name: str, mode: str = "complete") -> DataFrame:
    """Run a stream over all that is there now, and read what its last (complete) or all (append) batches wrote."""
    spark = stream.sparkSession
    path = new_path(spark, name)
    if mode == "append":
        run = stream.writeStream.format("parquet").option("path", path).outputMode("append")
    else:
        run = stream.writeStream.foreachBatch(lambda df, epoch: df.write.mode("overwrite").parquet(path)).outputMode(mode)
    run.option("checkpointLocation", f"{path}-state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


#: An event time after all others, by which the last windows of a drained stream close.
END = "2900-01-01 00:00:00"


def drain_sessions(rows: DataFrame, name: str) -> DataFrame:
    """The sessions of all that the stream ``rows`` has now, written once each as the watermark passes them.

    What is still open at the end is closed by a row of the time END, which comes from a stream of its own in a second run of the
    same query; that row's own session stays open. State holds open sessions alone.
    """
    spark = rows.sparkSession
    ends, path = new_path(spark, f"{name}-end"), new_path(spark, name)
    nothing = [F.lit(None).cast(f.dataType).alias(f.name) for f in rows.schema]
    last = spark.range(1).select(*[F.lit(END).cast("timestamp").alias("created_at") if f.name == "created_at" else c for f, c in zip(rows.schema, nothing)])
    last.filter("false").write.parquet(ends)
    stream = session_counts(rows.unionByName(spark.readStream.schema(rows.schema).parquet(ends)))
    for closing in (False, True):
        if closing:
            last.write.mode("append").parquet(ends)
        run = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", f"{path}-state").outputMode("append")
        run.trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)
