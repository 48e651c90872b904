"""Tables written to the folder that driver and executors share, and read again."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Bytes of a file that one task reads (Spark's default).
SCAN_BYTES = 128 << 20


def shared_dir(spark: SparkSession) -> str:
    """What ``spark.checkpoint.dir`` names; where it is unset on one machine, as in tests, a local folder is set. A cluster has to name one."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        where = "file://" + tempfile.mkdtemp(prefix="checkpoints-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where


class Cuts:
    """Cuts lineage: a lost executor costs a read and no recomputation."""

    def __init__(self, spark: SparkSession):
        self.spark, self.root = spark, f"{shared_dir(spark)}/orbweave-{uuid.uuid4().hex}"
        self.count = 0

    def cut(self, df: DataFrame) -> DataFrame:
        self.count += 1
        path = f"{self.root}/{self.count}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._cut_path = path
        return out

    def drop(self, df: DataFrame | None) -> None:
        """Deletes the files behind a table that nothing reads any more."""
        path = getattr(df, "_cut_path", None)
        if path:
            self._delete(path)

    def close(self) -> None:
        """Deletes all tables that were cut here; what is still to be read has to be cut elsewhere before."""
        self._delete(self.root)

    def _delete(self, path: str) -> None:
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def sweep(spark: SparkSession) -> None:
    """Has Spark delete the files of shuffles that nothing refers to any more, which it does when the driver's JVM collects garbage."""
    gc.collect()  # Python's references to plans
    spark.sparkContext._jvm.System.gc()


def plan_bytes(df: DataFrame) -> int:
    """What the optimizer takes for the size of a table; nothing is run for it."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def spread(df: DataFrame) -> DataFrame:
    """A table too small to be read in as many tasks as there are cores, dealt to all of them; work per row that is worth a shuffle follows."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if plan_bytes(df) < cores * SCAN_BYTES else df


def fresh(name: str, *taken: DataFrame) -> str:
    """A column name like ``name`` that none of the tables has, whatever the case."""
    used = {c.lower() for df in taken for c in df.columns}
    while name.lower() in used:
        name += "_"
    return name
