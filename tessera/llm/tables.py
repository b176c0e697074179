"""Tables between the steps of an operator, in the folder that the cluster shares."""

from __future__ import annotations

import re
import tempfile
import uuid
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Keys that a join may broadcast; 16 bytes each and the hash table around them come to some 40 MB.
BROADCAST_KEYS = 500_000


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where none is set, a folder of this machine if Spark runs in one process, as in tests, and an error on a cluster."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return folder or _own_folder()


@lru_cache(maxsize=1)
def _own_folder() -> str:
    return tempfile.mkdtemp(prefix="tessera-")


class Tables:
    """Writes tables and reads them again, so that what follows neither computes them anew nor needs the executors that did."""

    def __init__(self, spark: SparkSession):
        self.spark, self.folder = spark, f"{shared_folder(spark)}/tables-{uuid.uuid4().hex}"
        self.count = 0

    def keep(self, df: DataFrame) -> DataFrame:
        self.count += 1
        path = f"{self.folder}/{self.count}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *tables: DataFrame) -> None:
        """Deletes tables that nothing will read any more."""
        for t in tables:
            for f in {f.rsplit("/", 1)[0] for f in t.inputFiles()}:
                path = self.spark._jvm.org.apache.hadoop.fs.Path(f)
                path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def small_enough(keys: DataFrame, most: int = BROADCAST_KEYS) -> DataFrame:
    """The keys, marked for a broadcast if there are few of them; otherwise the join shuffles."""
    return F.broadcast(keys) if keys.limit(most + 1).count() <= most else keys


def largest(df: DataFrame, count: str, most: int) -> DataFrame:
    """Rows with the largest counts, ``most`` at most: all above a count that a histogram of 16 steps for each doubling gives, so that no task sorts them."""
    step = F.floor(F.log2(count) * 16)
    chosen, total = None, 0
    for r in sorted(df.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("n")).collect(), key=lambda r: -r["step"]):
        total += r["n"]
        if total > most:
            break
        chosen = r["step"]
    return df.where(step >= chosen) if chosen is not None else df.limit(0)
