"""Session settings the library is tuned for."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # A parent node may have a third of all nodes as children: split such join
    # keys even where that costs another exchange.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # Shuffled content grows about ten-fold when it is cut into tokens, and it
    # is compressed while adaptive execution measures it: aim at less.
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16MB",
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64KB",
    # The JVM does not compile methods above 8000 bytes of byte code. Beyond
    # that, generated code that Spark can split is several times as fast.
    "spark.sql.codegen.hugeMethodLimit": "8000",
    # Lets a prefix of the path start the walk of a directory tree below it.
    "spark.sql.python.filterPushdown.enabled": "true",
}
# Text grows some hundredfold when every token of it has its neighbours and brackets beside it.
TEXT_PER_PARTITION = 1 << 20
# Beyond so many partitions, they grow up to the size that a sort spills little of.
SMALL_PARTITIONS = 10_000
MOST_PER_PARTITION = 64 << 20


def configure(spark: SparkSession, source_bytes: int | None = None) -> SparkSession:
    """Applies the settings. With the size of the source text, also raises the
    number of shuffle partitions to one per MB, so that the memory for the tokens
    of one partition does not grow with the corpus; above 10,000, to one per 64 MB."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    if source_bytes:
        wanted = max(min(source_bytes // TEXT_PER_PARTITION, SMALL_PARTITIONS), source_bytes // MOST_PER_PARTITION) + 1
        if wanted > int(spark.conf.get("spark.sql.shuffle.partitions")):
            spark.conf.set("spark.sql.shuffle.partitions", str(wanted))
    return spark
