"""Sinks: upserts, pruning, exports, schema evolution."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarryline.operators.quality import evolved


def upsert(current: DataFrame, new: DataFrame, key: str = "id", version: str = "crawl_version") -> DataFrame:
    """current with the rows of new in place of those with the same key; of several new rows of a key the latest, and of equally late ones the first as JSON."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(version), F.to_json(F.struct(*new.columns))))
    latest = new.withColumn("_rank", rank).where("_rank = 1").drop("_rank")
    return current.join(latest.select(key), key, "left_anti").unionByName(latest, allowMissingColumns=True)


def prune(df: DataFrame, version: int, column: str = "crawl_version") -> DataFrame:
    """Rows of this crawl version or a later one."""
    return df.where(F.col(column) >= version)


def migrated(df: DataFrame, wanted: DataFrame) -> DataFrame:
    """df with the columns of wanted that it lacks, null."""
    schema = evolved(df.schema, wanted.schema)
    return df.select(*(F.col(f.name) if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields))


def flat(df: DataFrame, separator: str = "|") -> DataFrame:
    """df with arrays joined and other nested columns as JSON, as CSV needs it."""
    kinds = dict(df.dtypes)
    of = lambda c: F.array_join(F.col(c).cast("array<string>"), separator) if kinds[c].startswith("array<") and "struct" not in kinds[c] else F.to_json(c) if kinds[c].startswith(("struct", "map", "array")) else F.col(c)
    return df.select(*(of(c).alias(c) for c in df.columns))


def export_csv(df: DataFrame, path: str, most: int | None = None, quote_all: bool = False) -> None:
    rows = flat(df) if most is None else flat(df.limit(most))
    rows.write.mode("overwrite").option("header", True).option("quoteAll", quote_all).option("escape", '"').csv(path)


def export_json(df: DataFrame, path: str, most: int | None = None) -> None:
    """One JSON document a line, in as many files as there are partitions."""
    (df if most is None else df.limit(most)).write.mode("overwrite").json(path)


def stream_json(df: DataFrame) -> Iterator[str]:
    """A JSON array, row by row; one partition at a time is held."""
    first = True
    for row in df.select(F.to_json(F.struct("*")).alias("j")).toLocalIterator():
        yield ("[" if first else ",") + row["j"]
        first = False
    yield "[]" if first else "]"


def stream_csv(df: DataFrame, separator: str = "|") -> Iterator[str]:
    """CSV lines, the header first, row by row; one partition at a time is held."""
    header = df.sparkSession.sql("SELECT 1").select(F.to_csv(F.struct(*(F.lit(c).alias(c) for c in df.columns))).alias("j")).head()["j"]
    yield header + "\n"
    for row in flat(df, separator).select(F.to_csv(F.struct("*"), {"escape": '"'}).alias("j")).toLocalIterator():
        yield row["j"] + "\n"


#: What an export needs of either page.
EXPORTED = ("title", "fragment_count", "life_events", "categories")


def similarity_export(pairs: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    """Page pairs (a_url, b_url, scores) with either page's title and fragment count, and the events and categories that both have, joined by ``|``.

    Without pages, pairs carry the columns ``EXPORTED`` of both sides (``page_pairs(carried=EXPORTED)``), so that no pair is shuffled.
    """
    if pages is not None:
        of = lambda k: pages.select(*(F.col(c).alias(f"{k}_{c}") for c in ("url", *EXPORTED)))
        pairs = pairs.join(of("a"), "a_url", "left").join(of("b"), "b_url", "left")
    count = lambda k: F.coalesce(f"{k}_fragment_count", F.lit(0)).alias(f"{k}_fragments")
    shared = lambda c: F.coalesce(F.array_join(F.array_intersect(f"a_{c}", f"b_{c}"), "|"), F.lit(""))
    scores = [c for c in ("score", "tag_sim", "emb_sim", "link_sim") if c in pairs.columns]
    return pairs.select("a_url", "b_url", "a_title", "b_title", count("a"), count("b"), *scores, shared("life_events").alias("overlap_life_events"), shared("categories").alias("overlap_categories"))


def link_graph_json(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Nodes and edges as JSON lines with their kind, in one folder."""
    n = nodes.select(F.lit("node").alias("kind"), F.to_json(F.struct("*")).alias("value"))
    e = edges.select(F.lit("edge").alias("kind"), F.to_json(F.struct("*")).alias("value"))
    n.union(e).write.mode("overwrite").partitionBy("kind").text(path)


def write_versions(df: DataFrame, path: str, column: str = "crawl_version") -> None:
    """Parquet by crawl version, so that pruning drops whole folders."""
    df.write.mode("overwrite").partitionBy(column).option("compression", "zstd").parquet(path)
