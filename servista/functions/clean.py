"""Standardisation of raw string fields. Bad values become null and never fail a job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# The bounding box of valid coordinates, accepted states and the type of information calls.
LATITUDE, LONGITUDE = (41.6, 42.1), (-87.95, -87.5)
STATUSES = ("OPEN", "COMPLETED", "CANCELED")
INFO_CALL = "311 INFORMATION ONLY CALL"

# The fields of a landed record, in their order.
RAW_FIELDS = [
    "sr_number",
    "sr_type",
    "sr_short_code",
    "owner_department",
    "status",
    "origin",
    "created_date",
    "last_modified_date",
    "closed_date",
    "street_address",
    "city",
    "state",
    "zip_code",
    "ward",
    "police_district",
    "community_area",
    "latitude",
    "longitude",
    "location",
    "duplicate",
    "legacy_record",
    "legacy_sr_number",
]
RAW_SCHEMA = ", ".join(f"{name} string" for name in RAW_FIELDS)
METADATA = ("_ingestion_timestamp", "_source_file", "_sequence_timestamp")


def timestamp(column: str | Column) -> Column:
    return F.try_to_timestamp(F.col(column) if isinstance(column, str) else column)


def trimmed(column: str, upper: bool = False) -> Column:
    text = F.trim(F.col(column))
    return F.upper(text) if upper else text


def boxed(column: str) -> Column:
    """The coordinate as a double; null unless latitude and longitude both lie in the box (bounds included)."""
    lat, lon = F.col("latitude").try_cast("double"), F.col("longitude").try_cast("double")
    return F.when(lat.between(*LATITUDE) & lon.between(*LONGITUDE), F.col(column).try_cast("double"))


def is_info_call(column: str = "sr_type") -> Column:
    return F.coalesce(F.trim(F.col(column)) == INFO_CALL, F.lit(False))


def stage(raw: DataFrame) -> DataFrame:
    """Raw rows with metadata columns as typed, standardised rows; the order of changes is _sequence_timestamp."""
    created, closed, modified = (timestamp(c) for c in ("created_date", "closed_date", "last_modified_date"))
    return raw.select(
        "sr_number",
        F.coalesce(modified, closed, created, F.col("_ingestion_timestamp")).alias("_sequence_timestamp"),
        created.alias("created_date"),
        closed.alias("closed_date"),
        modified.alias("last_modified_date"),
        trimmed("sr_type").alias("sr_type"),
        trimmed("sr_short_code").alias("sr_short_code"),
        trimmed("owner_department").alias("owner_department"),
        trimmed("status", upper=True).alias("status"),
        F.col("ward").try_cast("int").alias("ward"),
        trimmed("community_area").alias("community_area"),
        trimmed("street_address").alias("street_address"),
        trimmed("zip_code").alias("zip_code"),
        boxed("latitude").alias("latitude"),
        boxed("longitude").alias("longitude"),
        trimmed("origin", upper=True).alias("origin"),
        F.col("duplicate").try_cast("boolean").alias("is_duplicate"),
        F.col("legacy_record").try_cast("boolean").alias("is_legacy"),
        is_info_call().alias("is_info_call"),
        "_ingestion_timestamp",
        "_source_file",
    )


def valid(staged: DataFrame, statuses: tuple[str, ...] = STATUSES) -> DataFrame:
    """Rows that meet the constraints: key, creation time and type present, a known status.

    The status is checked as standardised; checked against capitalised names, as one might read the source, none would pass.
    """
    return staged.filter(F.col("sr_number").isNotNull() & F.col("created_date").isNotNull() & F.col("sr_type").isNotNull() & F.col("status").isNotNull() & F.col("status").isin(*statuses))


def strict(staged: DataFrame) -> DataFrame:
    """The stricter clean set used by quality checks: also with a ward."""
    return staged.filter(" AND ".join(f"{c} IS NOT NULL" for c in ("sr_number", "created_date", "sr_type", "status", "ward")))


def service_only(df: DataFrame) -> DataFrame:
    """Without information calls; compares the untrimmed type, and rows without a type go too."""
    return df.filter(F.col("sr_type") != INFO_CALL)
