"""What runs as a stream."""

from pyspark.sql import SparkSession


def keyed_state(spark: SparkSession) -> None:
    """Keep the state of streams in RocksDB, which processors with their own state need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
