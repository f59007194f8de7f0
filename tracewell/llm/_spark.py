"""Session helpers that the operators of this package share."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DataType


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir.  Where none is set, a temporary one in local mode (tests); on a cluster, an error:
    executors would not see a folder of the driver's."""
    context = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or getattr(context, "_tracewell_shared", None)
    if not path:
        current = context._jsc.sc().getCheckpointDir()
        if current.isDefined():
            path = current.get()
        elif context.master.startswith("local") and "cluster" not in context.master:
            path = tempfile.mkdtemp(prefix="tracewell-")
        else:
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context._tracewell_shared = path  # the setting itself can't be changed in a running session
    return path


def remove(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


class Scratch:
    """Tables written to the shared folder.  They cut the lineage, outlive lost executors, and are deleted as soon as they
    have been used, and so are the shuffle files that made them."""

    _CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

    def __init__(self, spark: SparkSession, name: str, compression: str | None = None):
        self.compression = compression  # of its tables; by default the session's
        self.spark, self.folder, self.made = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}", 0
        self.paths: dict[int, str] = {}

    def keep(self, df: DataFrame, *done: DataFrame) -> DataFrame:
        """The same rows, read from a table; the tables of done are deleted."""
        path = f"{self.folder}/{self.made}"
        self.made += 1
        before = self.spark.conf.get(self._CLEAN)
        self.spark.conf.set(self._CLEAN, "true")
        try:
            df.write.parquet(path, compression=self.compression)
        finally:
            self.spark.conf.set(self._CLEAN, before)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = path
        out._scratch = self  # keeps id(out) from being used anew while the table is
        self.drop(*done)
        return out

    def drop(self, *tables: DataFrame) -> None:
        for x in tables:
            path = self.paths.pop(id(x), None)
            if path:
                remove(self.spark, path)

    def keep_only(self, table: DataFrame) -> None:
        """Deletes all other tables."""
        for key in [k for k in self.paths if k != id(table)]:
            remove(self.spark, self.paths.pop(key))


def _frame(batch: pa.RecordBatch) -> pd.DataFrame:
    """Integers with nulls stay integers: as doubles, those over 2**53 would change."""
    whole = {pa.int64(): pd.Int64Dtype(), pa.int32(): pd.Int32Dtype()}
    return pd.DataFrame({n: c.to_pandas(types_mapper=whole.get) if c.null_count and c.type in whole else c.to_pandas() for n, c in zip(batch.schema.names, batch.columns, strict=True)})


def map_frames(df: DataFrame, run: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], schema: str) -> DataFrame:
    """mapInPandas with exact integers, nulls or not."""
    target = to_arrow_schema(DataType.fromDDL(schema))

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for out in run(_frame(b) for b in batches):
            if len(out):
                yield pa.RecordBatch.from_pandas(out, schema=target, preserve_index=False)

    return df.mapInArrow(convert, schema)


def tokenizer_file(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def batch_rows(spark: SparkSession, rows: int) -> None:
    """Smaller Arrow batches: texts are long, and a Python worker's memory is bounded by one batch."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def crc_mod(column: str, n: int):
    """crc32 of the value as text, modulo n; a null id is taken as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")), F.lit(n))


def ship(spark: SparkSession) -> None:
    """Gives executors this package's code, once per session's context, where they can't import it themselves."""
    context = spark.sparkContext
    if getattr(context, "_tracewell_shipped", False):
        return
    folder = tempfile.mkdtemp(prefix="tracewell-code-")
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    with zipfile.ZipFile(path := f"{folder}/tracewell_code.zip", "w") as z:
        for at, _, names in os.walk(f"{root}/tracewell"):
            for name in names:
                if name.endswith(".py"):
                    z.write(f"{at}/{name}", os.path.relpath(f"{at}/{name}", root))
    context.addPyFile(path)  # served by the driver
    context._tracewell_shipped = True


def filter_rows(docs: DataFrame, keep: Callable[[list], Sequence[bool]]) -> DataFrame:
    """The rows of docs whose text passes, all columns as they are; keep takes the texts of some rows.  No shuffle."""

    def run(batches: Iterator) -> Iterator:
        for batch in batches:
            at = batch.schema.get_field_index("text")
            for a in range(0, batch.num_rows, 100):
                part = batch.slice(a, 100)
                yield part.filter(pa.array([bool(x) for x in keep(part.column(at).to_pylist())], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
