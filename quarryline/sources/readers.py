"""Sources: pages, sitemaps, robots rules, JSON and JSONL files, link frontiers."""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from functools import reduce
from urllib.robotparser import RobotFileParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.functions import text as T
from quarryline.functions import urls as U
from quarryline.operators.search import top_per_group

GRAPH_DDL = (
    "id string, event_name string, event_type string, prerequisites array<string>, next_states array<string>, concurrent_disallowed array<string>, frequent_concurrents array<string>, "
    "typical_age_range array<int>, typical_duration_days int, position_x double, position_y double, position_z double, cluster string, eligibility_status string, evidence_types array<string>"
)
SAMPLE_DDL = "input array<struct<role:string,content:string>>, ideal string, ideal_entities array<string>, facets struct<provider:string,life_event:string,category:string,state:string>, eval_type string"
SITEMAP_DDL = "url array<struct<loc:string>>, sitemap array<struct<loc:string>>"
# Links that a crawl does not follow.
EXCLUDED = (r"(?i)\.(pdf|doc|docx|xls|xlsx|ppt|pptx)$", r"/search\?", "/login", "/logout", "#")


def pages(spark: SparkSession, path: str, columns: Sequence[str] = ("url", "html"), most: int | None = None) -> DataFrame:
    """Crawled pages, only the columns asked for."""
    df = spark.read.parquet(path).select(*columns)
    return df if most is None else df.limit(most)


def spread(df: DataFrame) -> DataFrame:
    """Scanned rows, dealt to all cores where the files have fewer parts (row groups) than there are cores; a scan of many parts stays as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def union_of(frames: Sequence[DataFrame]) -> DataFrame:
    """Several crawls as one; columns that one of them lacks are null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def life_graph(spark: SparkSession, path: str) -> DataFrame:
    """The life-event graph from a JSON file of events."""
    return spark.read.schema(GRAPH_DDL).option("multiLine", True).json(path)


def fixtures(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema else reader).json(path)


def import_jsonl(spark: SparkSession, path: str, schema: str, key: str = "id") -> tuple[DataFrame, DataFrame]:
    """The rows of a JSONL file that fit a schema and have a key, and the rejects (line, reason): a broken line costs no other.

    Empty lines are neither. Fields that the schema lacks are left out, missing ones are null.
    """
    lines = spark.read.text(path).select(F.col("value").alias("line")).where(F.trim("line") != "")
    read = lines.withColumn("row", F.from_json("line", f"{schema}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))
    broken, keyless = F.col("row").isNull() | F.col("row._bad").isNotNull(), F.col(f"row.{key}").isNull()
    good = read.where(~broken & ~keyless).select("row.*").drop("_bad")
    return good, read.where(broken | keyless).select("line", F.when(broken, "not a row of the schema").otherwise(f"no {key}").alias("reason"))


def samples(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation samples of a JSONL file; ideal, a string or an array of strings, becomes an array."""
    rows = spark.read.schema(SAMPLE_DDL).json(path)
    many = F.from_json("ideal", "array<string>")
    return rows.withColumn("ideal", F.when(F.startswith("ideal", F.lit("[")), many).otherwise(F.array("ideal")))


def taxonomy_rows(spark: SparkSession, path: str) -> DataFrame:
    """dimension, label, keyword, label_ord and keyword_ord of a taxonomy file {dimension: {label: [keywords]}}."""
    text = "\n".join(r["value"] for r in spark.read.text(path, wholetext=True).collect())  # one small file
    rows = [(d, label, k, i, j) for d, labels in json.loads(text).items() for i, (label, ks) in enumerate(labels.items()) for j, k in enumerate(ks)]
    return spark.createDataFrame(rows, "dimension string, label string, keyword string, label_ord int, keyword_ord int")


def sitemap_urls(documents: DataFrame, site: str, max_depth: int = 3, most_children: int = 51) -> DataFrame:
    """The distinct page urls of a site's sitemaps; documents has url and xml of what can be fetched.

    An index is followed to the sitemaps it names, itself or by its folder,
    level by level.
    """
    read = documents.select("url", F.from_xml("xml", SITEMAP_DDL, {"rowTag": "urlset"}).alias("x"))
    at = documents.sparkSession.createDataFrame([(f"{site.rstrip('/')}/{p}",) for p in ("sitemap.xml", "sitemap_index.xml", "sitemap-index.xml")], "url string")
    found = []
    for _ in range(max_depth + 1):
        here = read.join(at, "url", "left_semi")
        found.append(here.select(F.explode("x.url.loc").alias("url")))
        child = here.select(F.explode(F.slice("x.sitemap.loc", 1, most_children)).alias("loc"))
        at = child.select(F.explode(F.array("loc", F.concat(F.regexp_replace("loc", "/$", ""), F.lit("/sitemap.xml")))).alias("url")).distinct()
    return reduce(DataFrame.union, found).where("url is not null").distinct()


def allowed(links: DataFrame, robots: DataFrame, agent: str = "*") -> DataFrame:
    """Links (url) that the robots text of their host (host, robots) allows; a host without one allows all."""

    def run(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        known: dict[str, RobotFileParser] = {}
        for urls, texts in parts:
            out = []
            for url, text in zip(urls, texts, strict=True):
                if text is None:
                    out.append(True)
                    continue
                if text not in known:
                    if len(known) >= 1000:  # hosts come in any order; parsing again is cheap
                        known.clear()
                    known[text] = RobotFileParser()
                    known[text].parse(text.splitlines())
                out.append(known[text].can_fetch(agent, url))
            yield pd.Series(out, dtype=bool)

    run.__annotations__ = {"parts": Iterator[tuple[pd.Series, pd.Series]], "return": Iterator[pd.Series]}
    may = F.pandas_udf(run, "boolean")
    joined = links.withColumn("_host", U.host(F.col("url"))).join(robots.select(F.col("host").alias("_host"), "robots"), "_host", "left")
    return joined.where(may("url", "robots")).select(*links.columns)


def frontier(pages: DataFrame, most: int, link_text: Column | None = None) -> DataFrame:
    """The links of each page (url, html) that a crawl follows: same origin, none of the excluded, the most relevant first; of equally relevant ones at one place (in pages of one url) the smaller."""
    anchors = F.regexp_extract_all("html", F.lit(r'(?is)<a\s[^>]*href\s*=\s*"[^"]+"[^>]*>.*?</a>'), 0)
    each = pages.select("url", F.posexplode(anchors).alias("pos", "a"))
    link = U.resolve(F.regexp_extract("a", r'(?i)href\s*=\s*"([^"]+)"', 1), F.col("url"))
    rows = each.withColumns({"link": link, "score": T.link_relevance(link_text if link_text is not None else F.regexp_replace("a", "<[^>]*>", " "))})
    same = (U.scheme(F.col("link")) == U.scheme(F.col("url"))) & (U.authority(F.col("link")) == U.authority(F.col("url")))
    kept = rows.where(same & ~reduce(lambda a, b: a | b, (F.col("link").rlike(p) for p in EXCLUDED)))
    first = kept.groupBy("url", "link").agg(F.min("pos").alias("pos"), F.max("score").alias("score"))
    return top_per_group(first, ["url"], [F.desc("score"), F.asc("pos"), F.asc("link")], most)


def statistics(df: DataFrame) -> dict:
    """Row count and fields."""
    return {"num_documents": df.count(), "fields": [(f.name, f.dataType.simpleString()) for f in df.schema.fields]}
