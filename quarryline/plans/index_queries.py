"""Queries over a persistent index, built in the shared folder, each beside its SQL oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.operators.index import Index
from quarryline.plans.catalog import ORACLE_SQL, query, table
from quarryline.plans.engine_queries import fragments
from quarryline.sources.shared import shared_path


def built(rows: DataFrame, key: str, *columns: str) -> Index:
    index = Index(rows.sparkSession, shared_path(rows.sparkSession, "index"), key, columns, dict(rows.dtypes)[key].replace("bigint", "long"))
    index.add(rows)
    return index


@query(ORACLE_SQL["doc_search"])
def indexed_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hits of doc_search, from the index."""
    return built(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "text").matches("station ther")


@query(ORACLE_SQL["entity_hits"])
def indexed_entity_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best hits of an entity's name, by score bounds."""
    rows = fragments(spark, sf_dir)
    best = built(rows.select("id", "title", "content_text"), "id", "title", "content_text").top("tion", 10, typos=1, prefix=False)
    kind = F.when(F.contains(F.lower("title"), F.lit("tion")), "exact").otherwise("partial")
    return rows.join(F.broadcast(best), "id").select("id", "text_match", kind.alias("match_type"))  # ten rows


_UPDATED = ORACLE_SQL["doc_search"].replace("FROM documents", "FROM documents WHERE doc_id % 10 <> 9")


@query(_UPDATED)
def indexed_search_after_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hits after a first load with other texts, a batch of new and changed rows, one of removed rows, and a compaction."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    third = F.col("doc_id") % 3
    index = built(docs.where(third != 0).withColumn("text", F.when(third == 1, F.concat(F.lit("station ther "), F.substring("text", 1, 50))).otherwise(F.col("text"))), "doc_id", "text")
    index.add(docs.where(third != 2))
    index.compact()
    index.drop(docs.where("doc_id % 10 = 9"))
    return index.matches("station ther")


@query("""
WITH d AS (SELECT doc_id, %%ALLTOKS(text) AS t FROM documents), n AS (SELECT doc_id, len(list_filter(generate_series(1, len(t) - 1), lambda i: t[i] = 'and' AND t[i + 1] = 'the')) AS places FROM d)
SELECT doc_id, places FROM n WHERE places > 0
""")
def indexed_phrase(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a phrase, and how often they have it, from positions."""
    return built(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "text").phrase("and the")
