"""A local session for tests and benchmarks; on a cluster the session comes from outside."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int = 8, shuffle_partitions: int = 8, memory: str = "6g", app: str = "sediment") -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


#: Bytes of files up to which a table may be dealt out anew; moving so much costs less than leaving cores idle.
SMALL = 256 << 20


def spread(table: DataFrame, most: int = SMALL) -> DataFrame:
    """A table of ``most`` bytes at most, in fewer files than there are cores, is dealt out to all of them; any other stays as it is read.

    A small file is often one row group, which one task would read and work
    on alone. The bound is on the table and not on its number of files, so a
    large table in few large files is never moved: its splits are enough.
    """
    spark = table.sparkSession
    cores, files = spark.sparkContext.defaultParallelism, table.inputFiles()
    if not 0 < len(files) < cores:
        return table
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    paths = [jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(f)) for f in files]
    size = sum(p.getFileSystem(conf).getFileStatus(p).getLen() for p in paths)
    return table.repartition(cores) if size <= most else table
