"""Versioned tables of a long computation, committed step by step.

A step writes its tables under its own number, then one marker file, which a file system makes or refuses as a whole.  What has no marker has not
happened: a run that is cut anywhere goes on from the last marker, and a step that is done again overwrites what was left behind.  Tables are
either kept whole in each version (``now``) or grow by each version's rows (``all``).
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


class RunState:
    def __init__(self, spark: SparkSession, folder: str, schemas: dict[str, str]):
        self.spark, self.folder, self.schemas = spark, folder.rstrip("/"), schemas
        self.version = max(self._committed(), default=-1)

    def _at(self, path: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), at

    def _committed(self) -> list[int]:
        files, at = self._at(f"{self.folder}/committed")
        return [int(f.getPath().getName()) for f in files.listStatus(at)] if files.exists(at) else []

    def commit(self, **tables: DataFrame) -> None:
        """Writes the next version; it counts from the moment at which its marker is there."""
        n = self.version + 1

        def write(name: str) -> None:
            rows = tables[name]
            schema = StructType.fromDDL(self.schemas[name])
            rows.select(*[rows[f.name].cast(f.dataType).alias(f.name) for f in schema.fields]).write.mode("overwrite").parquet(f"{self.folder}/{n}/{name}")

        with ThreadPoolExecutor(len(tables)) as pool:
            list(pool.map(write, tables))  # raises what a table's writing raised
        files, marker = self._at(f"{self.folder}/committed/{n}")
        files.create(marker, False).close()  # fails if another run has made this version
        self.version = n

    def _read(self, name: str, versions: list[int]) -> DataFrame:
        paths = [f"{self.folder}/{n}/{name}" for n in versions if (x := self._at(f"{self.folder}/{n}/{name}"))[0].exists(x[1])]
        schema = StructType.fromDDL(self.schemas[name])
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def now(self, name: str) -> DataFrame:
        """A table as the last version has it."""
        return self._read(name, [self.version])

    def all(self, name: str) -> DataFrame:
        """The rows that all versions have added."""
        return self._read(name, list(range(self.version + 1)))
