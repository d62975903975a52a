"""Tables that an iterative job writes to the shared folder, reads again and deletes."""

from __future__ import annotations

import tempfile
import uuid
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession


@lru_cache(maxsize=1)
def _own_folder() -> str:
    return "file://" + tempfile.mkdtemp(prefix="spark-")


class Store:
    """Tables of one solution in the shared folder. Only a session on one machine, as in tests, may name none."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths, self.tables = spark, {}, {}
        root = spark.conf.get("spark.checkpoint.dir", None)
        if not root and not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir names no shared folder")
        self.root = (root or _own_folder()).rstrip("/")

    def place(self) -> str:
        """A path of its own in the shared folder."""
        return f"{self.root}/{uuid.uuid4().hex}"

    def keep(self, df: DataFrame, name: str | None = None) -> DataFrame:
        """``df`` written and read again. The table that had this ``name`` before is deleted, as nothing reads it any more."""
        path = self.place()
        df.write.parquet(path)
        if name:
            self.drop(name)
            self.paths[name] = path
        return self.spark.read.schema(df.schema).parquet(path)

    def keep_dealt(self, df: DataFrame, key: str, parts: int, name: str) -> DataFrame:
        """As ``keep``, as a table in ``parts`` buckets by ``key``: what joins or groups by it afterwards isn't shuffled. ``df`` that is dealt so
        already is written where it is."""
        table = f"dealt_{uuid.uuid4().hex}"
        path = f"{self.root}/{table}"
        df.write.format("parquet").bucketBy(parts, key).option("path", path).saveAsTable(table)
        self.drop(name)
        self.paths[name], self.tables[path] = path, table
        return self.spark.table(table)

    def drop(self, *names: str) -> None:
        for path in filter(None, (self.paths.pop(n, None) for n in names)):
            if path in self.tables:
                self.spark.sql(f"DROP TABLE IF EXISTS {self.tables.pop(path)}")
            place = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(place, True)
