"""Contiguous shards of nearly equal bytes, by global prefix sums.

Rows are put in one total order (checksum of the text, size, id), so equal texts
stand side by side. Each range partition sums its sizes; the prefix sums of these
totals (a row for each partition) turn the running sums within a partition into
global ones. The line of all bytes is cut at equal targets, and a row goes to the
target that holds its middle: a shard is off its target by less than the largest
row. Slots count the rows of a shard in the same order.

Only DataFrame functions. Rows that move are a checksum, a size and an id; texts are read
once. Equal texts are cut apart only where a target falls among them: a group
of copies larger than a shard cannot stay whole where sizes are to be equal. Rows alike in
all three columns may stand in several partitions, so no group is too large for a task.

A null text has no bytes (size 16, checksum 0, as the empty one). A null id stands first among
rows alike otherwise. Repeated rows each have a slot. An empty table gives an
empty result; other columns are not read. Where there are fewer rows than
shards, or one row is larger than a target, some shards stay empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarryline.llm.common import crc32_sql, cut, in_order, table, text_or_empty

SHARDS = 40
#: Bytes that a row takes besides its text.
ROW_BYTES = 16


def sizes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size and text_crc32 of each row."""
    text = text_or_empty(df[text_col])
    return df.select(F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(text) + F.lit(ROW_BYTES)).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))


def prefix_sums(placed: DataFrame, size: str = "size") -> DataFrame:
    """A result of in_order with ``before`` (of all sizes before the row), ``total`` and ``at`` (rows before it)."""
    totals = placed.groupBy("_part").agg(F.sum(size).alias("bytes"), F.count("*").alias("rows"), F.min("_id").alias("first"))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # A row for each partition: the window and the broadcast are bounded by their number.
    offsets = totals.select("_part", "first", F.coalesce(F.sum("bytes").over(earlier), F.lit(0)).alias("bytes_before"), F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("rows_before"), F.sum("bytes").over(Window.partitionBy()).alias("total"))
    here = Window.partitionBy("_part").orderBy("_id").rowsBetween(Window.unboundedPreceding, -1)
    running = placed.withColumn("before", F.coalesce(F.sum(size).over(here), F.lit(0)))
    known = running.join(F.broadcast(offsets), "_part")
    return known.withColumns({"before": F.col("before") + F.col("bytes_before"), "at": F.col("_id") - F.col("first") + F.col("rows_before")}).drop("bytes_before", "rows_before", "first", "_part", "_id")


def shard(df: DataFrame, n: int = SHARDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, shard (0 to n - 1) and slot (from 0, without a gap) of each row."""
    placed = in_order(cut(sizes(df, id_col, text_col)), "text_crc32", "size", "doc_id")
    middle = F.expr(f"(({n} * (2 * before + size)) div (2 * total))")
    dealt = cut(prefix_sums(placed).withColumn("shard", middle.cast("int")))
    starts = dealt.groupBy("shard").agg(F.min("at").alias("start"))  # n rows
    return dealt.join(F.broadcast(starts), "shard").select("doc_id", "size", "text_crc32", "shard", (F.col("at") - F.col("start")).alias("slot"))


def op12_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 40 shards of nearly equal bytes."""
    placed = shard(table(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


_BYTES = "list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: ('0x' || x)::BIGINT)"
OP12_SQL = f"""
WITH sized AS (SELECT doc_id, (coalesce(strlen(text), 0) + {ROW_BYTES})::BIGINT AS size, {crc32_sql(_BYTES)} AS text_crc32 FROM documents),
summed AS (SELECT *, sum(size) OVER (ORDER BY text_crc32, size, doc_id NULLS FIRST ROWS UNBOUNDED PRECEDING) - size AS before, sum(size) OVER () AS total FROM sized),
dealt AS (SELECT *, (({SHARDS} * (2 * before + size)) // (2 * total))::INTEGER AS shard FROM summed)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY text_crc32, size, doc_id NULLS FIRST) - 1 AS slot, NULL::INTEGER AS grown_shard FROM dealt
"""
