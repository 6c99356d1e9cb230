"""Tables of a folder of Parquet files."""

from pyspark.sql import DataFrame, SparkSession

#: Bytes up to which a table's rows may be moved to spread them over all cores.
SMALL = 256 << 20


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    """The table ``folder/table.parquet``.

    A small table of fewer files than cores may have one row group a file, which
    no split divides, so its rows are spread over all cores. Larger tables are
    left to the scan's own splits and never moved.
    """
    df, cores = spark.read.parquet(f"{folder}/{table}.parquet"), spark.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size <= SMALL and len(df.inputFiles()) < cores else df
