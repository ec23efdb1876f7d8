"""Databases of the layers, and folders for files."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

#: Layer -> what it holds.
LAYERS = {"raw": "Landing files", "bronze": "Raw and staged records", "silver": "Change history and current records", "gold": "Aggregates", "ml": "Features and forecasts"}


def create_layers(spark: SparkSession, prefix: str = "", reset: bool = False) -> list[str]:
    """Create the layers' databases (after dropping them, with reset) and return their names."""
    made = []
    for layer, comment in LAYERS.items():
        name = f"{prefix}{layer}"
        if reset:
            spark.sql(f"DROP DATABASE IF EXISTS `{name}` CASCADE")
        spark.sql(f"CREATE DATABASE IF NOT EXISTS `{name}` COMMENT {_text(comment)}")
        made.append(name)
    return made


def describe_layers(spark: SparkSession, names: list[str]) -> DataFrame:
    rows = [(n, spark.catalog.getDatabase(n).description, len(spark.catalog.listTables(n))) for n in names if spark.catalog.databaseExists(n)]
    return spark.createDataFrame(rows, "name string, comment string, tables int")


def _text(value: str) -> str:
    """A string literal of SQL."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def set_comment(spark: SparkSession, name: str, comment: str) -> None:
    spark.sql(f"COMMENT ON DATABASE `{name}` IS {_text(comment)}")


def use(spark: SparkSession, name: str) -> None:
    spark.catalog.setCurrentDatabase(name)


def tables(spark: SparkSession, name: str) -> DataFrame:
    """Name, kind and comment of each table of a database."""
    rows = [(t.name, t.tableType, t.description) for t in spark.catalog.listTables(name)]
    return spark.createDataFrame(rows, "name string, kind string, comment string")


def table(spark: SparkSession, name: str, stream: bool = False) -> DataFrame:
    """A table by its name, with or without a database; as a stream of its new rows if asked for."""
    return spark.readStream.table(name) if stream else spark.table(name)


def drop_layers(spark: SparkSession, prefix: str = "") -> None:
    for layer in LAYERS:
        spark.sql(f"DROP DATABASE IF EXISTS `{prefix}{layer}` CASCADE")


class Volume:
    """A named folder with sub-folders, on any file system that Spark knows."""

    def __init__(self, spark: SparkSession, root: str, name: str):
        self.spark, self.path = spark, f"{root.rstrip('/')}/{name}"

    def _at(self, folder: str = ""):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{folder}" if folder else self.path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def exists(self) -> bool:
        fs, p = self._at()
        return bool(fs.exists(p))

    def create(self, *folders: str) -> Volume:
        for f in ("", *folders):
            fs, p = self._at(f)
            fs.mkdirs(p)
        return self

    def list(self, folder: str = "") -> list[str]:
        fs, p = self._at(folder)
        return sorted(x.getPath().getName() for x in fs.listStatus(p))

    def drop(self) -> None:
        fs, p = self._at()
        fs.delete(p, True)

    def smoke_test(self) -> bool:
        """Write, read and delete a file."""
        fs, p = self._at(f".probe-{uuid.uuid4().hex}")
        out = fs.create(p)
        out.write(bytearray(b"ok"))
        out.close()
        got = fs.open(p)
        good = [got.read(), got.read(), got.read()] == [*b"ok", -1]
        got.close()
        fs.delete(p, False)
        return good and not fs.exists(p)
