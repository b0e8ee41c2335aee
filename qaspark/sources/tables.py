"""Reading document tables."""

from __future__ import annotations

from pyspark.sql import DataFrame


def spread(scan: DataFrame) -> DataFrame:
    """Rows of a plain file scan over at least as many partitions as there are cores.

    Text work per row is heavy, and a file with one row group is read by one task. The shuffle happens
    only when the scan has fewer splits than the session has cores, that is for inputs of at most
    ``cores * maxPartitionBytes``; a large table is never shuffled here.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan


