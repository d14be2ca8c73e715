"""Roll-up of fragments into pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarryline.functions import text as T
from quarryline.functions import urls as U
from quarryline.functions.hashing import embeddings
from quarryline.functions.sets import or_empty, union_sets

TEXT_PIECE, TEXT_TOTAL = 4000, 40_000
SET_COLUMNS = ("categories", "states", "life_events", "stages", "stage_variants")


def modal_title(fragments: DataFrame) -> DataFrame:
    """page_url and its most frequent title (hierarchy_lvl0, else title), the first of equally frequent ones."""
    named = fragments.withColumn("t", F.coalesce(F.nullif(F.col("hierarchy_lvl0"), F.lit("")), "title")).where("t is not null and t <> ''")
    counts = named.groupBy("page_url", "t").agg(F.count("*").alias("n"), F.min("pos").alias("first"))
    best = counts.groupBy("page_url").agg(F.min(F.struct((-F.col("n")).alias("n"), "first", "t")).alias("best"))
    return best.select("page_url", F.col("best.t").alias("title"))


def page_text(fragments: DataFrame) -> DataFrame:
    """page_url and the first characters of its fragments, piece by piece while the text so far is short."""
    pieces = fragments.withColumn("piece", F.substring(F.coalesce("content_text", F.lit("")), 1, TEXT_PIECE)).where("piece <> ''")
    before = Window.partitionBy("page_url").orderBy("pos", "id").rowsBetween(Window.unboundedPreceding, -1)
    taken = pieces.withColumn("before", F.coalesce(F.sum(F.length("piece") + 1).over(before), F.lit(0))).where(F.col("before") < TEXT_TOTAL)
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "id", "piece"))), lambda x: x["piece"]), "\n")
    return taken.groupBy("page_url").agg(joined.alias("content_text"))


def page_links(fragments: DataFrame, links: int = 500, tokens: int | None = 1000) -> DataFrame:
    """page_url, out_links and out_link_tokens, in order of first occurrence."""
    each = fragments.select("page_url", "pos", F.posexplode(U.out_links(F.col("content_html"), F.col("page_url"), 1_000_000)).alias("at", "link"))
    first = each.groupBy("page_url", "link").agg(F.min(F.struct("pos", "at")).alias("place"))
    every = first.groupBy("page_url").agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "link"))), lambda x: x["link"]).alias("every"))
    return every.select("page_url", F.slice("every", 1, links).alias("out_links"), U.link_tokens(F.col("every"), tokens).alias("out_link_tokens"))


def roll_up(fragments: DataFrame) -> DataFrame:
    """A row for each page of the fragments (id, url, page_url or null, pos, title, content_text, ... as from html.fragments and tagging)."""
    rows = fragments.withColumn("page_url", F.coalesce("page_url", U.base_url(F.col("url"))))
    sets = [union_sets(c).alias(c) for c in SET_COLUMNS if c in rows.columns]
    singles = [F.sort_array(F.collect_set(c)).alias(c) for c in ("provider", "governance") if c in rows.columns]
    base = rows.groupBy("page_url").agg(
        F.max("crawl_version").alias("crawl_version"), F.max("last_seen_at").alias("last_seen_at"), F.sort_array(F.collect_set("id")).alias("fragment_ids"), F.count("*").alias("fragment_count"),
        union_sets("search_keywords").alias("keywords"), *sets, *singles,
    )
    whole = base.join(modal_title(rows), "page_url", "left").join(page_text(rows), "page_url", "left").join(page_links(rows), "page_url", "left")
    whole = whole.withColumns({"out_links": or_empty(F.col("out_links")), "out_link_tokens": or_empty(F.col("out_link_tokens")), "host": U.host(F.col("page_url")), "url": F.col("page_url"), "id": F.col("page_url")})
    vectors = embeddings(whole.withColumn("toks", T.tokens(F.concat_ws(" ", "title", "content_text"), False)), "page_url", "toks")
    zero = F.transform(F.sequence(F.lit(0), F.lit(255)), lambda x: F.lit(0.0))
    return whole.join(vectors, "page_url", "left").withColumn("embedding", F.coalesce("embedding", zero))


def graph_facts(pages: DataFrame, graph: DataFrame) -> DataFrame:
    """pages with eligibility_statuses, typical_age_range and typical_duration_days of their events; graph is the bounded event table."""
    nodes = graph.select("event_name", "eligibility_status", F.get("typical_age_range", F.lit(0)).alias("lo"), F.get("typical_age_range", F.lit(1)).alias("hi"), "typical_duration_days")
    facts = pages.select("url", F.explode("life_events").alias("event_name")).join(nodes, "event_name").groupBy("url").agg(
        F.sort_array(F.collect_set("eligibility_status")).alias("eligibility_statuses"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.max("typical_duration_days").alias("typical_duration_days")
    )
    age = F.when(F.col("lo").isNotNull() & F.col("hi").isNotNull(), F.array("lo", "hi"))
    joined = pages.join(facts.select("url", "eligibility_statuses", age.alias("typical_age_range"), "typical_duration_days"), "url", "left")
    return joined.withColumn("eligibility_statuses", or_empty(F.col("eligibility_statuses")))


def latest_versions(rows: DataFrame, key: str = "id") -> DataFrame:
    """The newest row of each key."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("crawl_version"), F.desc("last_seen_at")))
    return rows.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def node_title(title: Column, url: Column) -> Column:
    return F.coalesce(F.nullif(title, F.lit("")), url)




def distinct_hosts(df: DataFrame, url_col: str = "url") -> DataFrame:
    """The hosts of urls, each once."""
    return df.select(U.host(F.col(url_col)).alias("host")).distinct()
