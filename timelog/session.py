"""A SparkSession with the settings that results depend on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def builder(app: str = "timelog") -> SparkSession.Builder:
    return (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    )


def local(cores: int = 8, partitions: int | None = None) -> SparkSession:
    spark = (
        builder()
        .master(f"local[{cores}]")
        .config("spark.sql.shuffle.partitions", str(partitions or cores))
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark
