"""Tables written to the folder that the cluster shares, to cut lineage in loops."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_made: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where that is unset, as in tests, a folder of our own, which only a local master can share."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tallyspark-")
        _made.append((spark, found))
        spark.sparkContext.setCheckpointDir(found)
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def written(df: DataFrame) -> DataFrame:
    """The table, computed once and read back; it outlives executors and goes when the driver ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tables/{uuid.uuid4().hex}"
    _made.append((spark, path))
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def written_counting(df: DataFrame, condition: str) -> tuple[DataFrame, int]:
    """written(), and for how many of its rows the condition holds, from the same job."""
    seen = Observation()
    table = written(df.observe(seen, F.count_if(F.expr(condition)).alias("n")))
    return table, seen.get["n"]


@atexit.register
def _remove() -> None:
    while _made:
        spark, path = _made.pop()
        try:
            sc = spark.sparkContext
            p = sc._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # the session has ended
            if path.startswith("file:"):
                shutil.rmtree("/" + path[5:].lstrip("/"), ignore_errors=True)
