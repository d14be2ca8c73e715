"""Queries that give whole answers, nested parts joined as text, each beside its SQL oracle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.functions import sets as Z
from quarryline.operators import answers as W
from quarryline.operators.search import Request
from quarryline.plans.catalog import query
from quarryline.plans.engine_queries import _FR, fragments


def _counts(c: str) -> Column:
    return F.array_join(F.transform(c, lambda x: F.concat(x["field"], F.lit("="), x["value"], F.lit(":"), x["count"].cast("string"))), ";")


def _ids(c: str, name: str = "id") -> Column:
    return F.array_join(F.transform(c, lambda x: x[name]), ",")


_FACETS_SQL = """f AS (SELECT 'categories' AS field, lang AS value, count(*) AS n FROM h GROUP BY lang UNION ALL SELECT 'life_events', event, count(*) FROM h GROUP BY event UNION ALL SELECT 'provider', source, count(*) FROM h GROUP BY source UNION ALL SELECT 'states', state, count(*) FROM h GROUP BY state),
fr2 AS (SELECT *, row_number() OVER (PARTITION BY field ORDER BY n DESC, value) AS r FROM f)"""


@query(f"""
WITH {_FR}, toks AS (SELECT DISTINCT id, unnest(%%ALLTOKS(title)) AS token, 1.0 AS w FROM fr UNION ALL SELECT DISTINCT id, unnest(%%ALLTOKS(content_text)), 0.5 FROM fr),
q AS (SELECT id, 0 AS term, w * CASE WHEN token = 'station' THEN 1.0 WHEN levenshtein(token, 'station') <= 2 THEN 0.5 END AS q FROM toks
  UNION ALL SELECT id, 1, w * CASE WHEN token = 'ther' THEN 1.0 WHEN starts_with(token, 'ther') THEN 0.75 WHEN levenshtein(token, 'ther') <= 1 THEN 0.5 END FROM toks),
best AS (SELECT id, term, max(q) AS s FROM q WHERE q IS NOT NULL GROUP BY ALL), m AS (SELECT id, sum(s) AS score FROM best GROUP BY id HAVING count(*) = 2),
h AS (SELECT fr.*, score, row_number() OVER (ORDER BY score DESC, popularity_sort DESC, fr.id) AS r FROM fr JOIN m USING (id) WHERE state = 'NSW'), {_FACETS_SQL}
SELECT (SELECT string_agg(id, ',' ORDER BY r) FROM h WHERE r BETWEEN 8 AND 14) AS ids, (SELECT count(*) FROM h) AS found, 2 AS page, ((SELECT count(*) FROM h) + 6)::INTEGER // 7 AS total_pages,
  (SELECT string_agg(field || '=' || value || ':' || n, ';' ORDER BY field, r) FROM fr2 WHERE r <= 10) AS facets
""")
def search_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second page of hits in a state, with facets and total, from one scan."""
    found = W.search_answer(fragments(spark, sf_dir), Request("station ther", 2, 7), facets={"state": "NSW"}, order="popularity_sort:desc")
    return found.select(_ids("results").alias("ids"), "found", "page", "total_pages", _counts("facet_counts").alias("facets"))


@query(f"""
WITH {_FR}, h AS (SELECT *, row_number() OVER (ORDER BY popularity_sort, id) AS r FROM fr WHERE lang = 'en' AND event = 'e1')
SELECT (SELECT string_agg(id || ' ' || title, ',' ORDER BY r) FROM h WHERE r BETWEEN 51 AND 100) AS hits, (SELECT count(*) FROM h) AS found, 2 AS page, ((SELECT count(*) FROM h) + 49)::INTEGER // 50 AS total_pages
""")
def content_by_facets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second page of what two facets have."""
    found = W.content_by_facets(fragments(spark, sf_dir), {"category": "en", "life_event": "e1"}, page=2)
    return found.select(F.array_join(F.transform("results", lambda x: F.concat_ws(" ", x["id"], x["title"])), ",").alias("hits"), "found", "page", "total_pages")


@query(f"""
WITH {_FR}, sib AS (SELECT *, row_number() OVER (PARTITION BY page_url ORDER BY popularity_sort, id) AS r FROM fr), sl AS (SELECT page_url, list(id ORDER BY r) AS ids FROM sib WHERE r <= 20 GROUP BY 1),
ev AS (SELECT DISTINCT event, page_url FROM fr), oth AS (SELECT ev.event, ev.page_url, fr.id, fr.page_url AS other, fr.lang, fr.title, row_number() OVER (PARTITION BY ev.event, ev.page_url ORDER BY fr.popularity_sort, fr.id) AS r FROM ev JOIN fr ON fr.event = ev.event AND fr.page_url <> ev.page_url),
one AS (SELECT *, row_number() OVER (PARTITION BY event, page_url, other ORDER BY r) AS k FROM oth WHERE r <= 10), top AS (SELECT *, row_number() OVER (PARTITION BY event, page_url ORDER BY r) AS n FROM one WHERE k = 1),
rel AS (SELECT event, page_url, list(other || ' ' || title ORDER BY n) AS pages, list(lang ORDER BY n) AS langs FROM top WHERE n <= 5 GROUP BY 1, 2)
SELECT fr.id, fr.page_url, lang AS hierarchy, array_to_string(list_filter(ids, lambda x: x <> fr.id), ',') AS siblings, coalesce(array_to_string(pages, ','), '') AS related,
  coalesce(array_to_string(list_transform(langs, lambda x: fr.event || CASE WHEN x = fr.lang THEN '+' || x ELSE '' END), ','), '') AS shared
FROM fr JOIN sl USING (page_url) LEFT JOIN rel ON rel.event = fr.event AND rel.page_url = fr.page_url
""")
def fragment_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The context of every fragment."""
    found = W.fragment_contexts(fragments(spark, sf_dir))
    shared = F.transform("related_pages", lambda x: F.array_join(F.concat(x["shared_facets"]["life_events"], x["shared_facets"]["categories"]), "+"))
    related = F.transform("related_pages", lambda x: F.concat_ws(" ", x["url"], x["title"]))
    return found.select("id", "page_url", F.array_join("hierarchy", ",").alias("hierarchy"), _ids("siblings").alias("siblings"), F.array_join(related, ",").alias("related"), F.array_join(shared, ",").alias("shared"))


@query(f"""
WITH {_FR}, p AS (SELECT DISTINCT page_url AS url FROM fr WHERE event = 'e1'), m AS (SELECT * FROM fr WHERE page_url IN (SELECT url FROM p)),
f AS (SELECT *, row_number() OVER (ORDER BY popularity_sort, id) AS r FROM m WHERE popularity_sort > 40 OR (popularity_sort = 40 AND id > '5')),
l AS (SELECT DISTINCT source, lang FROM fr WHERE lang <> 'xx'), rel AS (SELECT event, 10 AS w FROM (SELECT 'e1' AS event) UNION ALL SELECT 'e0', 3 UNION ALL SELECT 'e2', 2)
SELECT (SELECT string_agg(id, ',' ORDER BY r) FROM f WHERE r <= 20) AS fragments, (SELECT string_agg(url, ',' ORDER BY url) FROM (SELECT url FROM p ORDER BY url LIMIT 100)) AS pages,
  (SELECT string_agg(event || ':' || w, ',' ORDER BY w DESC, event) FROM rel) AS relationships, (SELECT count(*) FROM m) AS found, (SELECT count(*) FROM p) AS page_found, (SELECT popularity_sort || '/' || id FROM f WHERE r = 20 AND (SELECT count(*) FROM f) > 20) AS next_after
""")
def life_event_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fragments of an event's pages after a key, with the event's relations; the graph's events are those of the documents, each after the one before."""
    rows = fragments(spark, sf_dir)
    pages = rows.groupBy(F.col("page_url").alias("url")).agg(Z.union_sets("life_events").alias("life_events"))
    events = rows.select(F.explode("life_events").alias("id")).distinct()
    number = F.substring("id", 2, 9).cast("int")
    near = lambda step: F.array(F.concat(F.lit("e"), (number + step).cast("string")))
    graph = events.select("id", F.col("id").alias("event_name"), near(-1).alias("prerequisites"), near(1).alias("next_states"), F.array().cast("array<string>").alias("frequent_concurrents"))
    found = W.life_event_fragments(rows, pages, graph, "e1", after=(40, "5"))
    weights = F.transform("relationships", lambda x: F.concat_ws(":", x["event_name"], x["weight"].cast("string")))
    return found.select(_ids("fragments").alias("fragments"), F.array_join("pages", ",").alias("pages"), F.array_join(weights, ",").alias("relationships"), "found", "page_found", F.concat(F.col("next_after.popularity_sort").cast("string"), F.lit("/"), F.col("next_after.id")).alias("next_after"))
