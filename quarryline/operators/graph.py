"""The life-event graph and the link graph.

The event graph is a bounded table (a row for each event with arrays of ids),
so Spark may broadcast it by its size; the link graph is joined by key.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarryline.operators import profile as Q
from quarryline.sources.shared import cut, stored

EDGES = {"prerequisites": 0.8, "next_states": 0.6, "frequent_concurrents": 0.4}
RELATION_WEIGHT = {"prerequisites": 3, "next_states": 2, "frequent_concurrents": 1}


def resolved(graph: DataFrame, column: str) -> DataFrame:
    """event_name and the names (in order) of the ids in a column; ids that no event has are left out."""
    each = graph.select("event_name", F.posexplode(column).alias("pos", "target"))
    named = each.join(graph.select(F.col("id").alias("target"), F.col("event_name").alias("name")), "target")
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("pos", "name"))), lambda x: x["name"])
    return named.groupBy("event_name").agg(ordered.alias(column))


def neighbourhood(graph: DataFrame, events: DataFrame) -> DataFrame:
    """The known events of events(event_name) with the names of their neighbours."""
    out = events.select("event_name").distinct().join(graph.select("event_name", "id"), "event_name")
    for column in (*EDGES, "concurrent_disallowed"):
        out = out.join(resolved(graph, column), "event_name", "left").withColumn(column, F.coalesce(column, F.array().cast("array<string>")))
    return out


def prerequisite_chain(graph: DataFrame, start: str, max_depth: int = 3) -> DataFrame:
    """id, event_name and depth of all prerequisites of an event, depth first, each at its first visit.

    Every path without a repeated event is followed up to max_depth; of the
    paths to an event the first in depth-first order counts.
    """
    edges = graph.select(F.col("id").alias("src"), F.posexplode("prerequisites").alias("pos", "dst"))
    known = graph.select("id")
    level = graph.where(F.col("event_name") == start).select(F.col("id").alias("at"), F.array("id").alias("seen"), F.array().cast("array<int>").alias("place"))
    found = []
    for depth in range(max_depth):
        step = level.join(edges, F.col("at") == F.col("src")).where(~F.array_contains("seen", F.col("dst"))).join(known, F.col("dst") == F.col("id"), "left_semi")
        level = step.select(F.col("dst").alias("at"), F.concat("seen", F.array("dst")).alias("seen"), F.concat("place", F.array("pos")).alias("place"))
        found.append(level.select(F.col("at").alias("id"), F.lit(depth + 1).alias("depth"), "place"))
    first = reduce(DataFrame.union, found).groupBy("id").agg(F.min(F.struct("place", "depth")).alias("f"))
    return first.join(graph.select("id", "event_name"), "id").select("id", "event_name", F.col("f.depth").alias("depth"), F.col("f.place").alias("place")).orderBy("place")


def relation_weights(graph: DataFrame, event: str) -> DataFrame:
    """event_name and weight: 10 for the event itself, 3, 2 and 1 for its relations, summed."""
    own = graph.where(F.col("event_name") == event)
    related = [own.select(F.explode(c).alias("id"), F.lit(w).alias("weight")) for c, w in RELATION_WEIGHT.items()]
    named = reduce(DataFrame.union, related).join(graph.select("id", "event_name"), "id").select("event_name", "weight")
    target = graph.sparkSession.createDataFrame([(event, 10)], "event_name string, weight int")
    return named.unionByName(target).groupBy("event_name").agg(F.sum("weight").alias("weight"))


def related_fragments(fragments: DataFrame, pages: DataFrame, graph: DataFrame, event: str) -> DataFrame:
    """Fragments of pages that have the event or a related one, with the page's score, the most popular first."""
    weights = relation_weights(graph, event)
    scores = pages.select(F.col("url").alias("page_url"), F.explode(F.array_distinct("life_events")).alias("event_name")).join(weights, "event_name").groupBy("page_url").agg(F.sum("weight").alias("relationship_score"))
    return fragments.join(scores, "page_url").orderBy("popularity_sort", "id")


def life_edges(graph: DataFrame, page_counts: DataFrame, focus: str | None = None) -> DataFrame:
    """source, target, kind and strength between the events that are kept: those with pages, the focus and what it names."""
    own = graph.where(F.col("event_name") == focus)
    near = reduce(DataFrame.union, [own.select(F.explode(c).alias("id")) for c in EDGES])
    counted = page_counts.where("n > 0").join(graph.select("event_name", "id"), "event_name").select("id")
    kept = counted.union(own.select("id")).union(near).distinct()
    edges = reduce(DataFrame.union, [graph.select(F.col("id").alias("source"), F.explode(c).alias("target"), F.lit(c).alias("kind"), F.lit(w).alias("strength")) for c, w in EDGES.items()])
    return edges.join(kept.withColumnRenamed("id", "source"), "source", "left_semi").join(kept.withColumnRenamed("id", "target"), "target", "left_semi").select("source", "target", "kind", "strength")


def link_edges(pages: DataFrame, site: Column | None = None, mode: str = "all", most: int = 1000) -> DataFrame:
    """source and target of links between pages of the table; self links stay.

    With site (A, B or null by page), only cross-site edges: both (A to B or B to A),
    a or b (just one end on that site).
    """
    nodes = pages.select("url", (site if site is not None else F.lit(None).cast("string")).alias("site"), "out_links")
    out = nodes.select(F.col("url").alias("source"), F.col("site").alias("from"), F.explode(F.slice(F.array_distinct("out_links"), 1, most)).alias("target"))
    edges = out.join(nodes.select(F.col("url").alias("target"), F.col("site").alias("to")), "target")
    is_ = lambda c, s: F.coalesce(F.col(c) == s, F.lit(False))
    if mode == "both":
        edges = edges.where((is_("from", "A") & is_("to", "B")) | (is_("from", "B") & is_("to", "A")))
    elif mode in ("a", "b"):
        edges = edges.where(is_("from", mode.upper()) != is_("to", mode.upper()))
    return edges.select("source", "target")


def edge_nodes(pages: DataFrame, edges: DataFrame, most: int | None = None) -> DataFrame:
    """The pages at either end of an edge; the limit does not prune edges."""
    ends = edges.select(F.col("source").alias("url")).union(edges.select(F.col("target").alias("url"))).distinct()
    kept = pages.join(ends, "url", "left_semi")
    return kept if most is None else kept.orderBy("url").limit(most)


def edges_between(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    ends = nodes.select("url")
    return edges.join(ends.withColumnRenamed("url", "source"), "source", "left_semi").join(ends.withColumnRenamed("url", "target"), "target", "left_semi")


def clusters(graph: DataFrame) -> DataFrame:
    """cluster, mean position and count."""
    means = [F.avg(f"position_{k}").alias(k) for k in "xyz"]
    return graph.groupBy(F.coalesce("cluster", F.lit("Other")).alias("cluster")).agg(*means, F.count("*").alias("n"))


def focus_point(graph: DataFrame, events: list[str]) -> DataFrame:
    """The mean position of events, raised by 10; (0, 10, 0) without any."""
    here = graph.where(F.col("event_name").isin(*events)) if events else graph.where(F.lit(False))
    mean = lambda k: F.coalesce(F.avg(f"position_{k}"), F.lit(0.0))
    return here.agg(mean("x").alias("x"), (mean("y") + 10).alias("y"), mean("z").alias("z"))


def event_card(graph: DataFrame, column: str) -> DataFrame:
    """event_name and its neighbours by name, by id where an event is unknown."""
    each = graph.select("event_name", F.posexplode(column).alias("pos", "target"))
    named = each.join(graph.select(F.col("id").alias("target"), F.col("event_name").alias("name")), "target", "left")
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("pos", F.coalesce("name", "target").alias("name")))), lambda x: x["name"])
    return named.groupBy("event_name").agg(ordered.alias("names"))


def dangling(graph: DataFrame, column: str) -> DataFrame:
    """source and target of ids in a column that no event has."""
    each = graph.select(F.col("id").alias("source"), F.explode(column).alias("target"))
    return each.join(graph.select(F.col("id").alias("target")), "target", "left_anti")


def lanes(rules: dict[str, Column]) -> Column:
    """The names of the lanes whose rule holds."""
    return F.array_compact(F.array(*(F.when(c, F.lit(name)) for name, c in rules.items())))


# The lanes of a timeline: whole clusters, a pattern in name or status, and an event type.
LANE_RULES = {
    "education": (("Education",), None, None),
    "employment": (("Working", "Unemployment", "Business"), None, None),
    "housing": (("Housing",), None, None),
    "disability": (("Managing health", "Caring"), "disab|mental|injur", None),
    "emergencies": (("Natural disaster", "Human-made disaster", "Domestic violence", "Crime and Justice"), None, "crisis"),
    "family": (("Relationships", "Forming family", "Family dissolution"), None, None),
    "cultural": (("Coming to Australia", "Identity change"), None, None),
    "older": (("Growing older", "End of life"), None, None),
}


def event_lanes(name: Column, status: Column, cluster: Column, kind: Column) -> Column:
    """The lanes of an event by its name, eligibility status, cluster and type, in their order."""

    def holds(clusters: tuple[str, ...], pattern: str | None, of_kind: str | None) -> Column:
        parts = [cluster.isin(*clusters)]
        parts += [F.lower(c).rlike(pattern) for c in (name, status)] if pattern else []
        parts += [kind == of_kind] if of_kind else []
        return reduce(lambda a, b: a | b, (F.coalesce(c, F.lit(False)) for c in parts))

    return lanes({key: holds(*rule) for key, rule in LANE_RULES.items()})


def edges_of(graph: DataFrame, column: str) -> DataFrame:
    """src, pos and dst of the ids in a column that the graph has."""
    each = graph.select(F.col("id").alias("src"), F.posexplode(column).alias("pos", "dst"))
    return each.join(graph.select(F.col("id").alias("dst")), "dst", "left_semi").select("src", "pos", "dst")


def reachable(edges: DataFrame, starts: DataFrame, max_depth: int | None = None) -> DataFrame:
    """start, id and depth (the least number of steps) of all that edges(src, dst) lead to from starts(start); a start itself has depth 0.

    By rounds: a round takes one step from what the last one found and drops what was
    found before, so cycles end and no path is listed. Rounds are as many as the longest
    of the shortest paths; each is a checkpoint. Rows of a round: the edges that leave its nodes.
    """
    steps = edges.select("src", "dst").distinct()
    new = cut(starts.select("start", F.col("start").alias("id"), F.lit(0).alias("depth")).distinct())
    found, depth = new, 0
    while (max_depth is None or depth < max_depth) and not new.isEmpty():
        depth += 1
        ahead = new.join(steps, F.col("id") == F.col("src")).select("start", F.col("dst").alias("id")).distinct()
        new = cut(ahead.join(found.select("start", "id"), ["start", "id"], "left_anti").withColumn("depth", F.lit(depth)))
        found = cut(found.unionByName(new)) if depth % 8 == 0 else found.unionByName(new)
    return found


def placed_events(graph: DataFrame) -> DataFrame:
    """id, event_name, cluster and position of every event; one without a position is placed by its ages and cluster."""
    by_rule = Q.position_columns()
    own = {f"position_{k}": F.coalesce(F.col(f"position_{k}") if f"position_{k}" in graph.columns else F.lit(None).cast("double"), by_rule[k]) for k in "xyz"}
    return graph.withColumns(own).select("id", "event_name", "cluster", *own)


def _focused(placed: DataFrame, profiles: DataFrame) -> DataFrame:
    """Of each profile its life stage, completeness and focus point."""
    axes = [f"position_{k}" for k in "xyz"]
    here = profiles.select(F.col("id").alias("p_id"), F.explode(F.array_distinct("current_life_events")).alias("event_name")).join(placed.select("event_name", *axes), "event_name")
    focus = here.groupBy("p_id").agg(F.struct(F.avg("position_x").alias("x"), (F.avg("position_y") + 10).alias("y"), F.avg("position_z").alias("z")).alias("focus_point"))
    people = profiles.select(F.col("id").alias("p_id"), Q.life_stage(F.col("age")).alias("life_stage"), Q.completeness(profiles).alias("completeness"))
    middle = F.struct(F.lit(0.0).alias("x"), F.lit(10.0).alias("y"), F.lit(0.0).alias("z"))
    return people.join(focus, "p_id", "left").withColumn("focus_point", F.coalesce("focus_point", middle))


def journey_focus(graph: DataFrame, profiles: DataFrame) -> DataFrame:
    """As ``journey_view``, with the numbers of placed events and of clusters in place of the lists, which ``placed_events`` and ``clusters`` give once for all profiles."""
    placed = stored(placed_events(graph), "placed-events")
    counts = placed.agg(F.count("*").alias("events"), F.countDistinct(F.coalesce("cluster", F.lit("Other"))).alias("clusters"))
    return _focused(placed, profiles).crossJoin(counts)  # one row


def journey_view(graph: DataFrame, profiles: DataFrame) -> DataFrame:
    """Of each profile (id, age, current_life_events, ...) its life stage, completeness and focus point, beside all placed events and clusters of the graph: each row has them, so both must be small.

    The focus is the mean of the profile's current events, raised by 10; (0, 10, 0) without any that the graph has.
    """
    placed = placed_events(graph)
    events = placed.agg(F.sort_array(F.collect_list(F.struct("id", "event_name", *(f"position_{k}" for k in "xyz")))).alias("events"))
    groups = clusters(placed).agg(F.sort_array(F.collect_list(F.struct("cluster", "x", "y", "z", "n"))).alias("clusters"))
    return _focused(placed, profiles).crossJoin(events).crossJoin(groups)  # a row each


def intervals(df: DataFrame, lane: str, start: str, end: str, least: float = 6.0) -> DataFrame:
    """Rows laid out by lane: ages within 0 to 100, spans of a least length, and the row's index by (start, end)."""


    clamp = lambda c: F.least(F.greatest(F.col(c), F.lit(0)), F.lit(100)).cast("double")
    placed = df.withColumns({"x0": clamp(start), "x1": F.greatest(clamp(end), clamp(start) + least)})
    return placed.withColumn("row", F.row_number().over(Window.partitionBy(lane).orderBy("x0", "x1", *[c for c in ("id",) if c in df.columns])) - 1)


def page_event_counts(pages: DataFrame) -> DataFrame:
    """event_name and the number of pages that have it."""
    return pages.select(F.explode("life_events").alias("event_name")).groupBy("event_name").agg(F.count("*").alias("n"))


# The services of events, by patterns in name or status, and by cluster.
# (services, pattern, whether it is also sought in the status, words that a cluster contains, whole clusters)
EVENT_SERVICES = (
    (("Medicare", "NDIS", "State Health"), "disab|mental|injur|diagnos|medical|health", True, ("health",), ()),
    (("State Housing", "Local Council", "Shelter/Services"), "rent|home|homeless|moving", False, ("housing",), ()),
    (("Dept. of Education", "University/TAFE", "TEQSA/ASQA"), "school|tertiary|university|tafe|apprent", True, ("education",), ()),
    (("Services Australia", "ATO", "Workforce Australia"), "work|job|unemploy|career", False, (), ("working", "unemployment", "business")),
    (("Family Court", "Services Australia"), "parent|baby|child|separat|foster|adopt", False, (), ("relationships", "family dissolution", "forming family", "caring")),
    (("Police", "Courts", "Legal Aid"), "court|charge|arrest|sentence|prison|crime", False, ("crime",), ()),
    (("Emergency Services", "Disaster Recovery"), "flood|fire|storm|drought|pandemic", False, ("disaster",), ()),
    (("Home Affairs", "Settlement Services"), "immi|visa|citizen|refugee|migrat", True, ("coming to australia",), ()),
    (("DVA",), "veteran|dva|service record", True, (), ()),
    (("Financial Counselling", "ASIC/AFCA"), "financial|debt|bank|bankrupt", False, ("finance",), ()),
)


def inferred_services(name: Column, status: Column, cluster: Column) -> Column:
    """The services that an event's name, eligibility status and cluster tell of, each once."""
    low = [F.lower(F.coalesce(c, F.lit(""))) for c in (name, status, cluster)]

    def fits(pattern: str, by_status: bool, parts: tuple[str, ...], whole: tuple[str, ...]) -> Column:
        found = low[0].rlike(pattern) | low[1].rlike(pattern) if by_status else low[0].rlike(pattern)
        return reduce(lambda a, b: a | b, [F.contains(low[2], F.lit(p)) for p in parts] + [low[2] == w for w in whole], found)

    none = F.array().cast("array<string>")
    return F.array_distinct(F.concat(*(F.when(fits(*rule), F.array(*map(F.lit, names))).otherwise(none) for names, *rule in EVENT_SERVICES)))
