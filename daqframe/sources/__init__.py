"""Spark data sources and sinks for log files."""

from pyspark.sql import SparkSession

from daqframe.sources.daq import DaqSource, read, read_binary

__all__ = ["DaqSource", "read", "read_binary", "register"]


def register(spark: SparkSession) -> None:
    """Makes ``daq`` a format of spark.read, df.write and spark.readStream, and lets filters of this session reach its reader."""
    spark.dataSource.register(DaqSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
