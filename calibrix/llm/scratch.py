"""Tables that one run of an operator writes and reads again.

They stand as Parquet in the shared folder that ``spark.checkpoint.dir`` names,
so every executor reads them and a lost one costs no recomputation of what is
above them. A table that a later one replaces is deleted.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from calibrix.session import ensure_checkpoint_dir


class Scratch:
    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/scratch-{uuid.uuid4().hex}"
        self.paths: dict[int, str] = {}
        self.count = 0

    def put(self, df: DataFrame) -> DataFrame:
        """``df``, written once."""
        self.count += 1
        path = f"{self.folder}/{self.count}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = path
        out._scratch = self  # the frame keeps its id while it lives
        return out

    def drop(self, *frames: DataFrame) -> None:
        """Delete tables that nothing reads any more."""
        for frame in frames:
            path = self.paths.pop(id(frame), None)
            if path is not None:
                p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
                p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)
