"""Aggregates that a stream keeps, one small table per day, in which no row is ever too late.

A trigger reads the tables of the days its rows fall into, merges its own partial aggregates with them and writes the
days anew under its number. So a trigger opens one table per day it touches, whatever came before, and late rows change
a day that has been given out already just like any other. Days that no row falls into are not touched.

Folders are ``of_day=<days since 1970>/batch=<trigger>``. A repeated trigger reads what earlier triggers left and overwrites
its own; of older tables of a day only those that no trigger can need again are removed.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stockline.sources import files

DAY, FOLDER, BATCH = "day", "of_day", "batch"


def day_of(ts: Column) -> Column:
    return F.unix_date(F.to_date(ts))


@dataclass(frozen=True)
class DayTable:
    """Rows of ``schema`` (DDL, with ``day``) under ``path``."""

    path: str
    schema: str

    def _numbers(self, spark: SparkSession, folder: str, name: str) -> list[int]:
        return sorted(int(n.split("=")[1]) for n in files.names(spark, folder) if n.startswith(f"{name}="))

    def _read(self, spark: SparkSession, newest: dict[int, int]) -> DataFrame:
        paths = [f"{self.path}/{FOLDER}={day}/{BATCH}={batch}" for day, batch in newest.items()]
        return spark.read.schema(self.schema).parquet(*paths) if paths else spark.createDataFrame([], self.schema)

    def read(self, spark: SparkSession, days: list[int], before: int) -> DataFrame:
        """The rows of some days as the triggers before ``before`` left them."""
        newest = {}
        for day in days:
            earlier = [b for b in self._numbers(spark, f"{self.path}/{FOLDER}={day}", BATCH) if b < before]
            if earlier:
                newest[day] = earlier[-1]
        return self._read(spark, newest)

    def tidy(self, spark: SparkSession, days: list[int], batch: int) -> None:
        """Remove the tables of some days that neither this trigger nor a later one can need."""
        for day in days:
            for old in [b for b in self._numbers(spark, f"{self.path}/{FOLDER}={day}", BATCH) if b < batch][:-1]:
                files.remove(spark, f"{self.path}/{FOLDER}={day}/{BATCH}={old}")

    def write(self, rows: DataFrame, batch: int) -> None:
        """The whole tables of the days that ``rows`` (with ``day``) hold."""
        (rows.withColumns({FOLDER: F.col(DAY), BATCH: F.lit(batch)}).repartition(DAY).write.mode("overwrite")
         .option("partitionOverwriteMode", "dynamic").partitionBy(FOLDER, BATCH).parquet(self.path))

    def latest(self, spark: SparkSession) -> DataFrame:
        """All days as they are now."""
        return self._read(spark, {day: self._numbers(spark, f"{self.path}/{FOLDER}={day}", BATCH)[-1]
                                  for day in self._numbers(spark, self.path, FOLDER)})
