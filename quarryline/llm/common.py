"""Helpers shared by the corpus operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters of text that a Python worker turns into objects at a time.
CHUNK_CHARS = 2_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(col: str | Column) -> Column:
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the two columns that text operators read, a null text as the empty one."""
    return df.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(df[text_col]).alias("text"))


def bucket_of(col: str = "doc_id", n: int = 4) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary")) % n


def slices(batches: Iterable[pa.RecordBatch], text: int = 1, most: int = CHUNK_CHARS) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with about ``most`` bytes of text each."""
    for batch in batches:
        col = batch.column(text)
        size = max(1, batch.num_rows and col.nbytes // batch.num_rows)
        step = max(1, most // size)
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)


def chunks(batches: Iterable[pa.RecordBatch], text: int = 1, most: int = CHUNK_CHARS) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Slices of the batches with about ``most`` bytes of text each, and their texts."""
    for part in slices(batches, text, most):
        yield part, part.column(text).to_pylist()


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir; a temporary one only on a local master that names none."""
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        if context.getCheckpointDir() is None:
            context.setCheckpointDir(found)
        return found
    if (own := context.getCheckpointDir()) is not None:
        return own
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoints-"))
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """df from a reliable checkpoint: computed once, and kept when executors are lost."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{checkpoint_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def remove_path(spark: SparkSession, path: str) -> None:
    """Deletes a folder of shared_path, in whatever store it is."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


class Memo:
    """A bounded table of computed values; when it is full, what was not used lately goes."""

    def __init__(self, limit: int = 300_000):
        self.limit, self.new, self.old = limit, {}, {}

    def clear(self) -> None:
        self.new, self.old = {}, {}

    def take(self, keys: Iterable, compute) -> dict:
        """A dict with at least these keys; compute maps a list of keys to their values."""
        new = self.new
        missing = set(keys).difference(new)
        if missing:
            old = self.old
            lost = []
            for k in missing:
                if (v := old.get(k)) is None:
                    lost.append(k)
                else:
                    new[k] = v
            if lost:
                new.update(zip(lost, compute(lost), strict=True))
        if len(new) > self.limit:
            self.old, self.new = new, {}
        return new


def in_order(df: DataFrame, *order: str) -> DataFrame:
    """df dealt by ranges of the columns and sorted in each partition, from a reliable checkpoint.

    ``_part`` numbers the partitions and ``_id`` the rows, both rising with the order;
    ids of a partition have no gap. Rows alike in all columns may stand in several
    partitions, so that no value is too common for one.
    """
    spread = df.withColumn("_salt", F.monotonically_increasing_id())
    sorted_ = spread.repartitionByRange(*order, "_salt").sortWithinPartitions(*order, "_salt").drop("_salt")
    return cut(sorted_.select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_id")))


def crc32_sql(bytes_list: str) -> str:
    """DuckDB SQL for the unsigned crc32 of a list of bytes, eight table entries by rule."""

    def entry(x: int) -> int:
        for _ in range(8):
            x = (x >> 1) ^ (0xEDB88320 if x & 1 else 0)
        return x

    step = "c >> 8"
    for k in range(8):
        step = f"xor({step}, ((xor(c, b) >> {k}) & 1) * {entry(1 << k)})"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {bytes_list}), lambda c, b: {step}), 4294967295::BIGINT)"
