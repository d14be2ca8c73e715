"""Whole answers of one request: hits with facets and totals, a fragment's context, a life event's fragments."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarryline.functions import text as T
from quarryline.functions.sets import compact, or_empty
from quarryline.operators import graph as G
from quarryline.operators.index import EXACT, PREFIX, TYPO, allowed_typos
from quarryline.operators.search import Request, facet_filter, top_per_group, words_of

FACETS = ("life_events", "categories", "provider", "states")
VIEW = ("id", "url", "title", "life_events", "categories", "states", "provider")
#: Rows of a task stand below this in monotonically_increasing_id.
_WITHIN = (1 << 33) - 1


def row_score(tokens: Sequence[Column], query: str, typos: int = 2, prefix: bool = True) -> Column:
    """text_match of a row by its columns' tokens (weightier ones first), null if a word matches none: ``search.matches`` without a join."""
    wanted, n = words_of(query), len(tokens)

    def quality(x: Column, t: str, last: bool) -> Column:
        found = F.when(x == t, EXACT)
        if prefix and last:
            found = found.when(F.startswith(x, F.lit(t)), PREFIX)
        if most := allowed_typos(t, typos):  # lengths first: few tokens need a distance
            found = found.when((F.abs(F.length(x) - len(t)) <= most) & (F.levenshtein(x, F.lit(t), most) >= 0), TYPO)
        return found

    def best(i: int, t: str) -> Column:
        each = [F.array_max(F.transform(c, lambda x: quality(x, t, i == len(wanted) - 1))) * (float(n - k) / n) for k, c in enumerate(tokens)]
        return F.greatest(*each) if n > 1 else each[0]

    return reduce(lambda a, b: a + b, (best(i, t) for i, t in enumerate(wanted)), F.lit(0.0)) if wanted else F.lit(1.0)


def search_answer(
    df: DataFrame, request: Request, columns: Sequence[str] = ("title", "content_text"), facets: Mapping[str, Any] | None = None, order: str = "", facet_by: Sequence[str] = FACETS,
    most_values: int = 10, view: Sequence[str] = VIEW, key: str = "id", required: bool = False,
) -> DataFrame:
    """One row: results (a page of hits, best first), found, page, total_pages and facet_counts (the most frequent values of each field).

    Hits, counts and total leave one scan. Each task sorts its own hits and keeps as many as
    the pages asked for hold; those, and all facet values counted beforehand, are the only
    rows that are shuffled. order is a text such as ``popularity_sort:asc``; hits of equal score and order come by
    key. A key stands once. Null and missing facet values are not counted; without hits the row has empty arrays.
    """
    kinds, upto = dict(df.dtypes), request.page * request.per_page
    scoped = df.where(facet_filter(facets or {}, required))
    by = [(name, direction == "desc") for name, _, direction in (p.rpartition(":") for p in order.split(",") if p)]
    own = [F.col(c).alias(f"_o{i}") for i, (c, _) in enumerate(by)]
    found = scoped.withColumns({f"_t{i}": T.token_set(F.col(c), False) for i, c in enumerate(columns)}) if words_of(request.query) else scoped
    score = row_score([F.col(f"_t{i}") for i in range(len(columns))], request.query, request.typos)
    narrow = found.select(F.col(key).alias("_key"), score.alias("_score"), *own, F.struct(*view).alias("_doc"), *(F.col(c).alias(f"_f{i}") for i, c in enumerate(facet_by))).where("_score is not null")
    ranks = [F.desc("_score"), *(F.desc(f"_o{i}") if down else F.asc(f"_o{i}") for i, (_, down) in enumerate(by)), F.asc("_key")]
    placed = narrow.sortWithinPartitions(*ranks).withColumn("_i", F.monotonically_increasing_id().bitwiseAND(F.lit(_WITHIN)))
    entry = lambda field, value, hit=None: F.struct(F.lit(field).alias("field"), value.alias("value"), (F.lit(None).cast("long") if hit is None else hit).alias("hit"))
    values = lambda i, c: or_empty(F.col(f"_f{i}").cast("array<string>")) if kinds[c].startswith("array") else F.array(F.col(f"_f{i}").cast("string"))
    none = F.lit(None).cast("string")
    entries = [F.array(entry("total", none)), F.array(F.when(F.col("_i") < upto, entry("hit", none, F.monotonically_increasing_id())))]
    counted = lambda i, c: F.transform(F.array_compact(values(i, c)), lambda v: entry(f"={c}", v))
    entries += [counted(i, c) for i, c in enumerate(facet_by)]
    kept = lambda c: F.first(F.when(F.col("e.hit").isNotNull(), F.col(c))).alias(c)
    carried = ["_score", *(f"_o{i}" for i in range(len(by))), "_key", "_doc"]
    each = placed.select(*carried, F.explode(F.array_compact(F.flatten(F.array(*entries)))).alias("e"))
    counts = each.groupBy("e.field", "e.value", "e.hit").agg(F.count("*").alias("count"), *map(kept, carried))
    rank = F.row_number().over(Window.partitionBy("field").orderBy(*ranks[:-1], F.desc("count"), F.asc("value"), F.asc("_key")))
    best = counts.withColumn("rank", rank).where(F.col("rank") <= max(upto, most_values))
    first = upto - request.per_page
    hit = F.when((F.col("field") == "hit") & (F.col("rank") > first) & (F.col("rank") <= upto), F.struct("rank", "_score", "_doc"))
    value = F.when(F.startswith("field", F.lit("=")) & (F.col("rank") <= most_values), F.struct(F.substring("field", 2, 100).alias("field"), "rank", "value", "count"))
    whole = best.agg(F.collect_list(hit).alias("h"), F.collect_list(value).alias("v"), F.coalesce(F.sum(F.when(F.col("field") == "total", F.col("count"))), F.lit(0)).alias("found"))
    ordered = F.array_sort("h", lambda a, b: a["rank"] - b["rank"])  # documents may hold what has no order
    return whole.select(
        F.transform(ordered, lambda x: x["_doc"].withField("text_match", x["_score"])).alias("results"), "found", F.lit(request.page).alias("page"), F.ceil(F.col("found") / request.per_page).cast("int").alias("total_pages"),
        F.transform(F.sort_array("v"), lambda x: F.struct(x["field"].alias("field"), x["value"].alias("value"), x["count"].alias("count"))).alias("facet_counts"),
    )


def content_by_facets(df: DataFrame, facets: Mapping[str, Any], page: int = 1, per_page: int = 50, order: str = "popularity_sort:asc", view: Sequence[str] = VIEW) -> DataFrame:
    """The answer without text: at least one facet is required."""
    return search_answer(df, Request("*", page, per_page), (), facets, order, (), 0, view, required=True).drop("facet_counts")


def fragment_contexts(df: DataFrame, siblings: int = 20, related: int = 5, hits: int = 10) -> DataFrame:
    """For every fragment: id, page_url, hierarchy, page_facets, siblings and related_pages.

    Siblings are the other ones among the first fragments (by popularity_sort, id) of its page. Related
    pages are those of the first fragments on other pages that have its first life event, a page once. Both come
    from lists of bounded length for each page and each event, joined back by page and event: a page and an event hold any
    number of fragments, of which only the first of each task are shuffled. Without a page or an event the lists are empty.

    For an event the list holds, of each page, its first fragments: enough pages that those of one's own can go.
    """
    by = [F.asc("popularity_sort"), F.asc("id")]
    place = lambda c: F.struct("popularity_sort", "id", *c)
    first = top_per_group(df.where(F.col("page_url").isNotNull()), ["page_url"], by, siblings)
    on_page = first.groupBy("page_url").agg(F.sort_array(F.collect_list(place(["title"]))).alias("_siblings"))
    # The first `hits` rows on pages other than p are among the first `hits` rows of each of the first hits + 1 pages.
    events = df.where(F.col("page_url").isNotNull()).select("page_url", "popularity_sort", "id", "title", or_empty(F.col("life_events")).alias("life_events"), or_empty(F.col("categories")).alias("categories"), F.explode(F.array_distinct("life_events")).alias("_event"))
    mine = top_per_group(events, ["_event", "page_url"], by, hits)
    heads = mine.groupBy("_event", "page_url").agg(F.sort_array(F.collect_list(place(["page_url", "title", "life_events", "categories"]))).alias("rows"))
    pages = top_per_group(heads.withColumn("_head", F.get("rows", F.lit(0))), ["_event"], [F.asc(F.col("_head")["popularity_sort"]), F.asc(F.col("_head")["id"])], hits + 1)
    of_event = pages.groupBy("_event").agg(F.sort_array(F.flatten(F.collect_list("rows"))).alias("_related"))
    rows = df.withColumn("_event", F.get("life_events", F.lit(0))).join(on_page, "page_url", "left")
    rows = rows.join(of_event, "_event", "left")
    others = F.slice(F.filter(F.col("_related"), lambda x: ~x["page_url"].eqNullSafe(F.col("page_url"))), 1, hits)
    once = F.filter(others, lambda x, i: F.array_position(F.transform(others, lambda y: y["page_url"]), x["page_url"]) == i + 1)
    shared = lambda x, c: F.array_intersect(x[c], or_empty(F.col(c)))
    view = F.transform(F.slice(once, 1, related), lambda x: F.struct(x["page_url"].alias("url"), x["title"].alias("title"), F.struct(shared(x, "life_events").alias("life_events"), shared(x, "categories").alias("categories")).alias("shared_facets"), F.lit(0.5).alias("similarity_score")))
    beside = F.transform(F.filter("_siblings", lambda x: x["id"] != F.col("id")), lambda x: F.struct(x["id"].alias("id"), x["title"].alias("title")))
    levels = [F.when(F.col(c) != "", F.col(c)) for c in ("hierarchy_lvl0", "hierarchy_lvl1", "hierarchy_lvl2") if c in df.columns]
    empty = lambda c: F.coalesce(c, F.array())
    return rows.select(
        "id", F.coalesce("page_url", "url").alias("page_url"), compact(*levels).alias("hierarchy"), F.struct(*(or_empty(F.col(c)).alias(c) for c in ("life_events", "categories", "states"))).alias("page_facets"),
        empty(beside).alias("siblings"), empty(view).alias("related_pages"),
    )


def life_event_fragments(fragments: DataFrame, pages: DataFrame, graph: DataFrame, event: str, per_page: int = 20, after: tuple[Any, Any] | None = None, pages_listed: int = 100) -> DataFrame:
    """One row: the next fragments (by popularity_sort, id) of the pages with an event, the first of these pages, the event's relations by weight, found and page_found.

    after is the (popularity_sort, id) of the last fragment shown: the next page is found by that
    key, not by an offset, so it costs no more than the first. ``next_after`` is null where no fragment follows.
    """
    wanted = pages.where(F.array_contains("life_events", event))
    mine = fragments.join(wanted.select(F.col("url").alias("page_url")), "page_url", "left_semi")
    key = F.struct("popularity_sort", "id")
    later = F.lit(True) if after is None else (F.col("popularity_sort") > after[0]) | ((F.col("popularity_sort") == after[0]) & (F.col("id") > after[1]))
    shown = mine.where(later).select(key.alias("at"), "title", "page_url").orderBy("at").limit(per_page + 1)  # one more tells whether any follows
    hits = F.sort_array(F.collect_list(F.struct("at", "title", "page_url")))
    listed = wanted.select("url").orderBy("url").limit(pages_listed).agg(F.sort_array(F.collect_list("url")).alias("pages"))
    related = G.relation_weights(graph, event)  # bounded by the arrays of one event
    weights = related.agg(F.sort_array(F.collect_list(F.struct((-F.col("weight")).alias("w"), "event_name"))).alias("r"))
    one = shown.agg(hits.alias("h")).crossJoin(mine.agg(F.count("*").alias("found"))).crossJoin(wanted.agg(F.count("*").alias("page_found"))).crossJoin(listed).crossJoin(weights)  # a row each
    kept = F.slice("h", 1, per_page)
    return one.select(
        F.transform(kept, lambda x: F.struct(x["at"]["id"].alias("id"), x["at"]["popularity_sort"].alias("popularity_sort"), x["title"].alias("title"), x["page_url"].alias("page_url"))).alias("fragments"),
        "pages", F.transform("r", lambda x: F.struct(x["event_name"].alias("event_name"), (-x["w"]).alias("weight"))).alias("relationships"), "found", "page_found",
        F.when(F.size("h") > per_page, F.element_at(kept, -1)["at"]).alias("next_after"),
    )
