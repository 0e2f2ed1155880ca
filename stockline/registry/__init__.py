"""All registered queries: name -> (Spark query, SQL or None)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import TimestampType

from stockline.session import configure, provide_shared_folder

MODULES = ["bulk", "orders", "items", "service", "flows"]


def _wall_clock(query):
    """Timestamps leave as plain UTC wall-clock values, whatever the caller's time zone is."""
    def run(spark, sf_dir) -> DataFrame:
        configure(spark)
        provide_shared_folder(spark)
        frame = query(spark, sf_dir)
        return frame.select(*[
            F.col(f"`{f.name}`").cast("timestamp_ntz").alias(f.name)
            if isinstance(f.dataType, TimestampType) else F.col(f"`{f.name}`")
            for f in frame.schema.fields])
    return run


def registered() -> dict:
    from importlib import import_module

    found = {}
    for module in MODULES:
        for name, (function, sql) in import_module(f"stockline.registry.{module}").QUERIES.items():
            if name in found:
                raise ValueError(f"query {name} is registered twice")
            found[name] = (_wall_clock(function), sql)
    return found
