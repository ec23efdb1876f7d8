"""Landing files to bronze to staged tables, incrementally; a rerun adds nothing."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from servista.functions.clean import RAW_SCHEMA, stage, valid
from servista.sources.landing import with_metadata


def landing_stream(spark: SparkSession, folder: str, files_per_batch: int | None = None) -> DataFrame:
    """New landing files below folder, with the fixed schema of strings and metadata columns."""
    reader = spark.readStream.schema(RAW_SCHEMA).option("recursiveFileLookup", "true")
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return with_metadata(reader.json(folder))


def append(stream: DataFrame, table: str, checkpoint: str, continuous: str | None = None, name: str | None = None) -> StreamingQuery:
    """Append a stream to a Parquet folder, exactly once by checkpoint and file log.

    By default everything available is processed and the query ends; continuous is a processing-time interval.
    """
    writer = stream.writeStream.format("parquet").outputMode("append").option("path", table).option("checkpointLocation", checkpoint)
    if name:
        writer = writer.queryName(name)
    return (writer.trigger(processingTime=continuous) if continuous else writer.trigger(availableNow=True)).start()


def append_batches(stream: DataFrame, table: str, checkpoint: str) -> StreamingQuery:
    """The same by foreachBatch: each batch is a folder of its own, written anew when it is repeated, and a row of the
    table's batch log (see batch_history)."""

    def write(batch: DataFrame, number: int) -> None:
        seen = Observation()
        batch.observe(seen, F.count("*").alias("rows")).write.mode("overwrite").parquet(f"{table}/batch={number}")
        done = batch.sparkSession.range(1).select(F.lit(number).cast("long").alias("number"), F.lit(seen.get["rows"]).cast("long").alias("rows"), F.current_timestamp().alias("written_at"))
        done.coalesce(1).write.mode("overwrite").parquet(f"{table}_batches/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def batch_history(spark: SparkSession, table: str) -> DataFrame:
    """Number, rows and time of each batch that append_batches wrote, the latest first."""
    return spark.read.parquet(f"{table}_batches").select("number", "rows", "written_at").orderBy(F.desc("number"))


def staged_stream(spark: SparkSession, bronze: str) -> DataFrame:
    """Valid, standardised rows of the bronze table as they arrive."""
    return valid(stage(spark.readStream.schema(spark.read.parquet(bronze).schema).parquet(bronze)))


def run_bronze(spark: SparkSession, landing: str, root: str) -> tuple[str, str]:
    """Bring bronze and staged tables under root up to date; their paths."""
    bronze, staged = f"{root}/bronze", f"{root}/staged"
    append(landing_stream(spark, landing), bronze, f"{root}/checkpoints/bronze").awaitTermination()
    append(staged_stream(spark, bronze), staged, f"{root}/checkpoints/staged").awaitTermination()
    return bronze, staged


def ingestion_counts(bronze: DataFrame, hours: int = 10) -> DataFrame:
    """Rows by hour of ingestion, the latest hours first."""
    return bronze.groupBy(F.date_trunc("hour", "_ingestion_timestamp").alias("hour")).agg(F.count("*").alias("n")).orderBy(F.desc("hour")).limit(hours)
