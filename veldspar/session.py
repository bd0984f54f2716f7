"""Session defaults: UTC, adaptive execution, Arrow transfer."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.showConsoleProgress": "false",
}


def session(master: str | None = None, app: str = "veldspar", **conf: str) -> SparkSession:
    """A session with the defaults above; ``conf`` uses ``__`` for dots (``spark__ui__enabled="false"``)."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in (DEFAULTS | {k.replace("__", "."): v for k, v in conf.items()}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def spread(table: DataFrame) -> DataFrame:
    """A scan of fewer partitions than there are cores, dealt out to all of them, as for a small file of one row group; a larger scan as it is."""
    cores = table.sparkSession.sparkContext.defaultParallelism
    few = table._jdf.queryExecution().toRdd().getNumPartitions() < cores
    return table.repartition(cores) if few else table
