"""Filters, full-text search, facets, grouping and paging over fragment tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarryline.functions import text as T
from quarryline.functions.sets import first_or

#: Array columns that a facet is a member of; other columns are compared whole.
MEMBER_COLUMNS = {"category": "categories", "state": "states", "life_event": "life_events"}


def all_of(predicates: Sequence[Column]) -> Column:
    """Their conjunction; true without any."""
    return reduce(lambda a, b: a & b, predicates, F.lit(True))


def member(column: str, value: str | Sequence[str]) -> Column:
    """Whether an array column has the value, or any of several."""
    return F.array_contains(column, value) if isinstance(value, str) else F.arrays_overlap(F.col(column), F.array(*map(F.lit, value)))


def facet_filter(facets: Mapping[str, Any], required: bool = False) -> Column:
    """The conjunction of the facets that are given. The state National stands for no filter."""
    given = {k: v for k, v in facets.items() if v not in (None, "", []) and not (k == "state" and v == "National")}
    if required and not any(v not in (None, "", []) for v in facets.values()):
        raise ValueError("at least one facet is required")
    return all_of([member(MEMBER_COLUMNS[k], v) if k in MEMBER_COLUMNS else F.col(k) == v if isinstance(v, str) else F.col(k).isin(*v) for k, v in given.items()])


def in_range(low: str, high: str, value: Any) -> Column:
    """low <= value <= high; rows with a null bound are out."""
    return (F.col(low) <= value) & (F.col(high) >= value)


def any_in_range(column: str, low: Any, high: Any) -> Column:
    """Whether an array has an element >= low and one <= high."""
    return F.exists(column, lambda x: x >= low) & F.exists(column, lambda x: x <= high)


def site_of(host: Column, site_a: str, site_b: str) -> Column:
    """A or B by the host's end, A first; else null."""
    return F.when(F.endswith(host, F.lit(site_a)), "A").when(F.endswith(host, F.lit(site_b)), "B")


@dataclass(frozen=True)
class Request:
    """A validated search request."""

    query: str = "*"
    page: int = 1
    per_page: int = 20
    typos: int = 2

    def __post_init__(self) -> None:
        if not self.query:
            raise ValueError("a query is required")
        if not 1 <= self.per_page <= 250 or self.page < 1:
            raise ValueError("per_page is 1 to 250 and page 1 or more")
        if not 0 <= self.typos <= 2:
            raise ValueError("typos is 0, 1 or 2")


def words_of(query: str) -> list[str]:
    """The query's words, lower-case; none for ``*``."""
    return [] if query == "*" else "".join(c if c.isascii() and c.isalnum() else " " for c in query.lower()).split()


def matches(df: DataFrame, key: str, query: str, columns: Sequence[str], typos: int = 2, prefix: bool = True) -> DataFrame:
    """key and text_match of the rows in which each query token matches a token of the columns.

    A token matches if it is equal, starts with the query token (for the
    last one, with prefix) or is within the number of typos: one for tokens of four
    letters or more, two from seven. text_match adds 1, 0.75 or 0.5 for these,
    times the weight of the column (earlier ones weigh more). The vocabulary is
    matched first, so the distance is computed once for each distinct token.
    """
    wanted = words_of(query)
    if not wanted:
        return df.select(key, F.lit(1.0).alias("text_match"))
    n = len(columns)
    terms = reduce(DataFrame.union, (df.select(key, F.explode(T.token_set(F.col(c), False)).alias("token"), F.lit(float(n - i) / n).alias("weight")) for i, c in enumerate(columns)))
    vocabulary = terms.select("token").distinct()

    def quality(t: str, last: bool) -> Column:
        allowed = min(typos, 0 if len(t) < 4 else 1 if len(t) < 7 else 2)
        found = F.when(F.col("token") == t, 1.0)
        if prefix and last:
            found = found.when(F.startswith("token", F.lit(t)), 0.75)
        return found.when(F.levenshtein("token", F.lit(t), allowed) >= 0, 0.5) if allowed else found

    scored = reduce(DataFrame.union, (vocabulary.select("token", F.lit(i).alias("term"), quality(t, i == len(wanted) - 1).alias("q")).where("q is not null") for i, t in enumerate(wanted)))
    best = terms.join(scored, "token").groupBy(key, "term").agg(F.max(F.col("q") * F.col("weight")).alias("s"))
    return best.groupBy(key).agg(F.sum("s").alias("text_match"), F.count("*").alias("n")).where(F.col("n") == len(wanted)).select(key, "text_match")


def search(df: DataFrame, request: Request, columns: Sequence[str], facets: Mapping[str, Any] | None = None, key: str = "id", order: Sequence[Column] = ()) -> DataFrame:
    """The matching rows with text_match, best first, then by order and key; one page of them."""
    found = df.where(facet_filter(facets or {}))
    hits = found.join(matches(found, key, request.query, columns, request.typos), key)
    return page_of(hits, [F.desc("text_match"), *order, F.asc(key)], request.page, request.per_page)


def page_of(df: DataFrame, order: Sequence[Column], page: int, per_page: int) -> DataFrame:
    return df.orderBy(*order).offset((page - 1) * per_page).limit(per_page)


def total_pages(found: int, per_page: int) -> int:
    return -(-found // per_page)


def sort_columns(spec: str) -> list[Column]:
    """Columns of a text such as ``popularity_sort:asc,title:desc``."""
    parts = [p.rpartition(":") for p in spec.split(",")]
    return [F.desc(name) if direction == "desc" else F.asc(name) for name, _, direction in parts]


def facet_counts(df: DataFrame, columns: Sequence[str], most: int = 100) -> DataFrame:
    """field, value and count of the most frequent values of several columns, scalar or array, from one scan."""
    kinds = dict(df.dtypes)

    def of(c: str) -> Column:
        values = F.col(c).cast("array<string>") if kinds[c].startswith("array") else F.array(F.col(c).cast("string"))
        return F.transform(values, lambda v: F.struct(F.lit(c).alias("field"), v.alias("value")))

    each = [of(c) for c in columns]
    rows = df.select(F.explode(F.flatten(F.array_compact(F.array(*each)))).alias("f")).select("f.field", "f.value").where("value is not null")
    counts = rows.groupBy("field", "value").agg(F.count("*").alias("count"))
    return top_per_group(counts, ["field"], [F.desc("count"), F.asc("value")], most)


def top_per_group(df: DataFrame, group: Sequence[str], order: Sequence[Column], most: int) -> DataFrame:
    """The first rows of each group; the limit is taken in each task before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    return df.withColumn("_rank", rank).where(F.col("_rank") <= most).drop("_rank")


def by_hierarchy(df: DataFrame, most: int = 10, site: str | None = None) -> DataFrame:
    """Up to ten fragments of each hierarchy_lvl0, the most popular first."""
    scoped = df if site is None else df.where(F.array_contains("site_hierarchy", site))
    return top_per_group(scoped, ["hierarchy_lvl0"], [F.asc("popularity_sort"), F.asc("id")], most)


NEXT_DIMENSION = ("category", "life_event", "provider", "state")


def filter_combinations(df: DataFrame, chosen: Mapping[str, str], most: int = 8, words: Sequence[str] = ()) -> DataFrame:
    """value and count of the next dimension that is not chosen yet, among the rows that the choice leaves.

    Only the most frequent values of the whole table are offered, and with
    words only values that have one of them. One aggregation takes the place of
    a count for each value.
    """
    dimension = next((d for d in NEXT_DIMENSION if not chosen.get(d)), None)
    if dimension is None:
        return df.sparkSession.createDataFrame([], "dimension string, value string, count long")
    column = MEMBER_COLUMNS.get(dimension, dimension)
    offered = facet_counts(df, [column], 100 if words else most).select("value")
    if words:
        offered = offered.where(reduce(lambda a, b: a | b, (F.contains(F.lower("value"), F.lit(w.lower())) for w in words)))
    counts = facet_counts(df.where(facet_filter(chosen)), [column], 1_000_000).select("value", "count")
    return counts.join(offered, "value", "left_semi").orderBy(F.desc("count"), "value").limit(most).select(F.lit(dimension).alias("dimension"), "value", "count")


def search_view(df: DataFrame, html: bool = False) -> DataFrame:
    """The columns of a search result, with defaults."""
    return df.select(
        "id", "title", "url", first_or(F.col("categories"), "General").alias("category"), first_or(F.col("life_events"), "General").alias("life_event"),
        F.coalesce("provider", F.lit("Unknown")).alias("provider"), first_or(F.col("states"), "National").alias("state"), F.coalesce("hierarchy_lvl0", "title").alias("hierarchy"),
        F.substring("content_text", 1, 200).alias("snippet"), *(["content_html"] if html else []),
    )


def batch(df: DataFrame, ids: Sequence[str], key: str = "id") -> DataFrame:
    """The rows of the ids asked for, in their order, repeated ids repeated; misses are left out."""
    asked = df.sparkSession.createDataFrame(list(enumerate(ids)), f"pos int, {key} string")
    return asked.join(df, key).orderBy("pos")


def point(df: DataFrame, id_: str, key: str = "id") -> DataFrame:
    return df.where(F.col(key) == id_)


def by_life_event(fragments: DataFrame, pages: DataFrame, event: str) -> DataFrame:
    """Fragments of the pages that have a life event."""
    wanted = pages.where(F.array_contains("life_events", event)).select(F.col("url").alias("page_url"))
    return fragments.join(wanted, "page_url", "left_semi")


def with_life_events(fragments: DataFrame, pages: DataFrame) -> DataFrame:
    """Fragments with their page's life events, empty without a page."""
    events = pages.select(F.col("url").alias("page_url"), F.col("life_events").alias("_events"))
    return fragments.join(events, "page_url", "left").withColumn("life_events", F.coalesce("_events", F.array().cast("array<string>"))).drop("_events")


def context_siblings(df: DataFrame, id_: str, most: int = 20) -> DataFrame:
    """The first other fragments of the same page; the limit counts the fragment itself."""
    page = df.where(F.col("id") == id_).select("page_url")
    return df.join(page, "page_url", "left_semi").orderBy("popularity_sort", "id").limit(most).where(F.col("id") != id_)


def related_pages(df: DataFrame, id_: str, most: int = 5, hits: int = 10) -> DataFrame:
    """Fragments of other pages that share the first life event, one for each page, with the facets shared."""
    this = df.where(F.col("id") == id_).select(F.get("life_events", F.lit(0)).alias("event"), F.col("page_url").alias("own"), F.col("life_events").alias("own_events"), F.col("categories").alias("own_categories"))
    found = df.join(this, F.array_contains(F.col("life_events"), F.col("event")) & (F.col("page_url") != F.col("own"))).orderBy("popularity_sort", "id").limit(hits)
    one = top_per_group(found, ["page_url"], [F.asc("popularity_sort"), F.asc("id")], 1)
    shared = F.array_union(F.array_intersect("life_events", "own_events"), F.array_intersect("categories", "own_categories"))
    return one.orderBy("popularity_sort", "id").limit(most).select("page_url", "title", shared.alias("shared_facets"), F.lit(0.5).alias("score"))
