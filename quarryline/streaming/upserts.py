"""Incremental crawls as a stream: each new batch of rows is merged into a table by key.

The table is a folder:

    data/batch=/bucket=     rows, dealt to buckets by a hash of their key, as the batch that last changed the bucket wrote them
    manifest/batch=         for each bucket the batch that holds it and its least version; the schema
    commits/batch=          markers, written last: what is not committed is not read

A batch reads and rewrites only the buckets of its keys. Pruning old versions rewrites only
buckets that hold some. A batch that runs again after a failure starts from the state
before it and writes the same one. What neither the newest state nor the one before it needs is
deleted, so readers of the last state can finish.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from quarryline.sources.shared import names, remove, write_marker
from quarryline.sources.sinks import prune, upsert

_PLACE = "bucket int, batch long, least long, schema string"


@dataclass(frozen=True)
class State:
    """A committed batch: the place of each bucket that has rows, and the schema."""

    batch: int
    places: dict[int, tuple[int, int | None]]  # bucket: (the batch that wrote it, its least version)
    schema: StructType


@dataclass(frozen=True)
class KeyedTable:
    """A folder with one row for each key, in buckets. More buckets make a batch rewrite less; all of a bucket is rewritten by few tasks."""

    spark: SparkSession = field(repr=False)
    path: str
    key: str = "id"
    version: str = "crawl_version"
    buckets: int = 64

    def state(self, before: int | None = None) -> State | None:
        """The newest committed state, or the newest before a batch."""
        done = [n for x in names(self.spark, f"{self.path}/commits") if (n := int(x.partition("=")[2])) < (before if before is not None else n + 1)]
        if not done:
            return None
        rows = self.spark.read.schema(_PLACE).parquet(self._at("manifest", max(done))).collect()  # a row for each bucket
        return State(max(done), {r.bucket: (r.batch, r.least) for r in rows if r.bucket >= 0}, StructType.fromJson(json.loads(rows[0].schema)))

    def read(self, state: State | None = None, buckets: list[int] | None = None) -> DataFrame | None:
        """The rows of the newest (or a given) state, or of some of its buckets; None if nothing was ever committed."""
        if (state := state or self.state()) is None:
            return None
        paths = [self._at("data", batch) + f"/bucket={b}" for b, (batch, _) in sorted(state.places.items()) if buckets is None or b in buckets]
        return self.spark.read.schema(state.schema).parquet(*paths) if paths else self.spark.createDataFrame([], state.schema)

    def merge(self, rows: DataFrame, n: int) -> None:
        """Puts the rows of batch n in, in place of those with the same key."""
        state = self.state(before=n)
        held = rows.persist()
        try:
            touched = [r[0] for r in held.select(self._bucket().alias("b")).distinct().collect()]  # at most as many as there are buckets
            old = held.limit(0) if state is None else self.read(state, touched)
            self._write(upsert(old, held, self.key, self.version), n, state, touched)
        finally:
            held.unpersist()

    def prune(self, least: int, n: int) -> None:
        """As batch n, takes out rows of versions below least; only buckets that have some are rewritten."""
        if (state := self.state(before=n)) is None:
            return
        stale = [b for b, (_, low) in state.places.items() if low is None or low < least]
        self._write(prune(self.read(state, stale), least, self.version), n, state, stale)

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def _at(self, name: str, batch: int) -> str:
        return f"{self.path}/{name}/batch={batch:012d}"

    def _write(self, rows: DataFrame, n: int, state: State | None, touched: list[int]) -> None:
        where = self._at("data", n)
        rows.withColumn("bucket", self._bucket()).hint("rebalance", "bucket").sortWithinPartitions("bucket").write.mode("overwrite").partitionBy("bucket").parquet(where)
        written = self.spark.read.schema(f"`{self.version}` long, bucket int").parquet(where) if names(self.spark, where) else None
        lows = written.groupBy("bucket").agg(F.min(self.version).alias("low")).collect() if written is not None else []
        places = {b: p for b, p in (state.places if state else {}).items() if b not in touched} | {r.bucket: (n, r.low) for r in lows}
        schema = rows.schema if state is None else StructType([*state.schema.fields, *(f for f in rows.schema.fields if f.name not in state.schema.fieldNames())])
        text = schema.json()
        manifest = [(b, batch, low, text) for b, (batch, low) in places.items()] or [(-1, n, None, text)]
        self.spark.createDataFrame(manifest, _PLACE).coalesce(1).write.mode("overwrite").parquet(self._at("manifest", n))
        write_marker(self.spark, self._at("commits", n))
        self._expire(n, places, state)

    def _expire(self, n: int, places: dict, before: State | None) -> None:
        """Deletes what neither state n nor the one before it names. Later batches stay: they are being run again."""
        kept = {(b, batch) for b, (batch, _) in [*places.items(), *(before.places.items() if before else ())]}
        states = {n} | ({before.batch} if before else set())
        for x in names(self.spark, f"{self.path}/data"):
            if (batch := int(x.partition("=")[2])) > n:
                continue
            for b in names(self.spark, f"{self.path}/data/{x}"):
                if b.startswith("bucket=") and (int(b.partition("=")[2]), batch) not in kept:
                    remove(self.spark, f"{self.path}/data/{x}/{b}")
            if batch not in {k for _, k in kept}:
                remove(self.spark, f"{self.path}/data/{x}")
        for x in names(self.spark, f"{self.path}/commits"):
            if (batch := int(x.partition("=")[2])) < n and batch not in states:
                remove(self.spark, self._at("commits", batch))
                remove(self.spark, self._at("manifest", batch))


def watch(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of the Parquet files that arrive in a folder."""
    return spark.readStream.schema(schema).parquet(path)


def merge_batches(stream: DataFrame, table: str, checkpoint: str, key: str = "id", version: str = "crawl_version", buckets: int = 64) -> StreamingQuery:
    """Merges each batch of the stream into the table in a folder."""

    def merge(batch: DataFrame, n: int) -> None:
        KeyedTable(batch.sparkSession, table, key, version, buckets).merge(batch, n)

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, table: str) -> DataFrame | None:
    """The newest state of a table; None if there is none."""
    return KeyedTable(spark, table).read()
