"""Tables that cut lineage, kept in the folder that the cluster shares (spark.checkpoint.dir)."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def folder(spark: SparkSession) -> str:
    """The shared folder; where the session names none (local tests), a temporary one is set."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not shared:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("a cluster must name a shared folder in spark.checkpoint.dir")
        shared = "file://" + tempfile.mkdtemp(prefix="ledgerloom-")
        spark.sparkContext.setCheckpointDir(shared)
        shared = spark.sparkContext.getCheckpointDir()
    return shared


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session may be gone by then
        pass


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows of df, computed once and written; what reads them survives lost executors."""
    spark = df.sparkSession
    path = f"{folder(spark)}/ledgerloom/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_remove, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def drop(df: DataFrame) -> None:
    """Deletes a table made by stored() that nothing reads any more."""
    for path in {f.rpartition("/")[0] for f in df.inputFiles()}:
        if "/ledgerloom/" in path:
            _remove(df.sparkSession, path)


def hash_sample(rows: DataFrame, key: str, n: int, size: int) -> DataFrame:
    """The rows (of n) with about the `size` smallest hashes of a key, at most size.

    A bound on the hash leaves half as many again before they are ordered, so that no task gets a share of every partition."""
    h = F.pmod(F.xxhash64(key), F.lit(1 << 30))
    bound = (1 << 30) if n <= size else int((1 << 30) * min(1.0, 1.5 * size / n))
    return rows.where(h < bound).orderBy(h, key).limit(size)
