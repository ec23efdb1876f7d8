"""Landing files: JSON records, written by the tasks that fetched them, as streams and reads take them."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from servista.functions.clean import RAW_SCHEMA
from servista.sources import rest


def write_landing(rows: DataFrame, folder: str, kind: str = "incremental", run: str | None = None) -> str:
    """Write records below folder/kind, in a folder for the run: a run that is repeated replaces its own files. The run's folder."""
    path = f"{folder.rstrip('/')}/{kind}/run={run or datetime.now().strftime('%Y%m%d_%H%M%S')}"
    rows.write.mode("overwrite").option("ignoreNullFields", "false").json(path)
    return path


def initial_load(spark: SparkSession, config: rest.ApiConfig, folder: str, years: int = 2, now: datetime | None = None, run: str | None = None, schema: str = RAW_SCHEMA) -> str:
    """Land all records created in the last years, a file for each window of time; nothing bounds their number.

    A load that died and is begun again under the same run (by default the day) lands nothing twice.
    """
    now = now or datetime.now()
    first = f"{now - timedelta(days=365 * years):%Y-%m-%d}T00:00:00"
    return write_landing(rest.records(spark, config, f"{config.moment} >= '{first}'", schema), folder, "initial", run or f"{now:%Y%m%d}")


def incremental_load(spark: SparkSession, config: rest.ApiConfig, folder: str, checkpoint: str, start: str, columns: tuple[str, ...] = rest.CHANGES, schema: str = RAW_SCHEMA) -> StreamingQuery:
    """Land what changed since the last run, once: Spark's checkpoint holds the time up to which records have come, which never moves back."""

    def land(batch: DataFrame, number: int) -> None:
        write_landing(batch, folder, "incremental", f"batch{number:06d}")

    return rest.changes(spark, config, start, columns, schema).writeStream.foreachBatch(land).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def with_metadata(df: DataFrame) -> DataFrame:
    return df.withColumn("_ingestion_timestamp", F.current_timestamp()).withColumn("_source_file", F.col("_metadata.file_path"))


def read_landing(spark: SparkSession, folder: str) -> DataFrame:
    """All landing files below folder, every field a string (nested ones as JSON text), with metadata."""
    return with_metadata(spark.read.schema(RAW_SCHEMA).option("recursiveFileLookup", "true").json(folder))


def preview(spark: SparkSession, folder: str) -> DataFrame:
    """The files with an inferred schema."""
    return spark.read.option("recursiveFileLookup", "true").json(folder)
