"""Eligibility, relevance and life-event matching of user profiles.

Documents and profiles meet in one frame: the profile's columns carry the prefix
``p_`` (``matched``), so that many profiles are matched as well as one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarryline.functions.sets import compact, or_empty
from quarryline.operators.intervals import Range, join_points

# Age limits of life stages, and what a complete profile has.
LIFE_STAGES = ((18, "Youth"), (30, "Young Adult"), (50, "Adult"), (65, "Mature Adult"))
LAST_STAGE = "Senior"
PROFILE_FIELDS = ("age", "income", "citizenship", "residency_state", "employment_status", "housing_status", "current_life_events")
CLUSTER_DEPTH = {"Family": -30, "Work": 0, "Health": 30, "Education": -15, "Housing": 15}
PROFILE_DDL = (
    "id string, age int, income int, assets int, citizenship array<string>, residency_state string, disabilities array<string>, employment_status string, housing_status string, "
    "is_carer boolean, children array<struct<age:int,has_disability:boolean>>, current_life_events array<string>, completed_life_events array<string>"
)


def given(c: Column) -> Column:
    """Not null and not zero: a bound that is 0 is no bound."""
    return c.isNotNull() & (c != 0)


def matched(docs: DataFrame, profiles: DataFrame) -> DataFrame:
    """Documents and profiles whose age and income lie within the document's bounds (null bounds never match); a citizenship that is required must be had."""
    p = profiles.select(*(F.col(c).alias(f"p_{c}") for c in profiles.columns))
    bounds = [Range(F.col(f"min_{k}"), F.col(f"max_{k}"), F.col(f"p_{k}")) for k in ("age", "income")]
    wanted = or_empty(F.col("required_citizenship"))
    citizen = (F.size(wanted) == 0) | F.coalesce(F.arrays_overlap(wanted, or_empty(F.col("p_citizenship"))), F.lit(False))
    return join_points(docs, p, bounds).where(citizen)


def _events() -> tuple[Column, Column]:
    return or_empty(F.col("life_events")), or_empty(F.col("p_current_life_events"))


def _bounds(kind: str) -> tuple[Column, Column]:
    low, high, v = F.col(f"min_{kind}"), F.col(f"max_{kind}"), F.col(f"p_{kind}")
    applies = given(low) | given(high)
    return applies, applies & (~given(low) | (v >= low)) & (~given(high) | (v <= high))


def eligibility_score() -> Column:
    """The share of what applies (age, income, life events) that fits; 0 if nothing applies."""
    n = lambda c: F.when(F.coalesce(c, F.lit(False)), 1.0).otherwise(0.0)
    age, income = _bounds("age"), _bounds("income")
    events, current = _events()
    applies = (F.size(events) > 0) & (F.size(current) > 0)
    share = F.when(applies, F.size(F.filter(events, lambda e: F.array_contains(current, e))) / F.greatest(F.size(events), F.lit(1))).otherwise(0.0)
    return F.coalesce(F.try_divide(n(age[1]) + n(income[1]) + share, n(age[0]) + n(income[0]) + n(applies)), F.lit(0.0))


def event_match() -> Column:
    events, current = _events()
    now = F.size(F.filter(events, lambda e: F.array_contains(current, e)))
    done = or_empty(F.col("p_completed_life_events"))
    ahead = F.size(F.filter(or_empty(F.col("prerequisite_states")), lambda e: F.array_contains(done, e)))
    return F.when((F.size(events) == 0) | (F.size(current) == 0), 0.0).otherwise(F.least(F.lit(1.0), (now + 0.5 * ahead) / F.greatest(F.size(events), F.lit(1))))


def relevance_score() -> Column:
    urgency = F.when(given(F.col("urgency_score")), F.col("urgency_score")).otherwise(50) / 100
    return eligibility_score() * 0.5 + urgency * 0.2 + event_match() * 0.3


def reasons() -> Column:
    """Why a document does not fit, as messages."""
    wanted = or_empty(F.col("required_citizenship"))
    lacks = (F.size(wanted) > 0) & ~F.arrays_overlap(wanted, or_empty(F.col("p_citizenship")))
    return compact(
        F.when(given(F.col("min_age")) & (F.col("p_age") < F.col("min_age")), F.concat(F.lit("Must be at least "), F.col("min_age").cast("string"), F.lit(" years old"))),
        F.when(given(F.col("max_income")) & (F.col("p_income") > F.col("max_income")), F.concat(F.lit("Income must be below $"), F.format_number("max_income", 0))),
        F.when(lacks, F.concat(F.lit("Requires "), F.array_join(wanted, " or "), F.lit(" citizenship"))),
    )


def eligible_services(docs: DataFrame, profiles: DataFrame) -> DataFrame:
    """All documents that fit each profile with their scores; rank counts from the most relevant. The result is not sorted: profiles stay where they are."""
    scored = matched(docs, profiles).withColumns({"eligibility_score": eligibility_score(), "eligibility_reasons": reasons(), "relevance_score": relevance_score()})
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("p_id").orderBy(F.desc("relevance_score"), "id")))


def likelihood(age: Column, completed: Column) -> Column:
    """Of an event (typical_age_range, prerequisites) for a profile, 0 to 1."""
    low, high = F.get("typical_age_range", F.lit(0)), F.get("typical_age_range", F.lit(1))
    distance = F.least(F.abs(age - low), F.abs(age - high))
    by_age = F.when(F.size("typical_age_range") == 2, F.when((age >= low) & (age <= high), 0.3).otherwise(-0.01 * distance)).otherwise(0.0)
    met = F.coalesce(F.forall("prerequisites", lambda p: F.array_contains(completed, p)), F.lit(False))
    return F.least(F.greatest(0.5 + F.coalesce(by_age, F.lit(0.0)) + F.when(met, 0.2).otherwise(0.0), F.lit(0.0)), F.lit(1.0))


def next_events(graph: DataFrame, profiles: DataFrame, most: int = 20) -> DataFrame:
    """Events near a profile's age (one of their ages at least 5 below it or more, one at most 10 above) whose prerequisites are all had or done; rank counts from the likeliest."""
    from quarryline.operators.search import top_per_group

    p = profiles.select(F.col("id").alias("p_id"), F.col("age").alias("p_age"), or_empty(F.col("current_life_events")).alias("p_now"), or_empty(F.col("completed_life_events")).alias("p_done"))
    ages = Range(F.array_min("typical_age_range") - 10, F.array_max("typical_age_range") + 5, F.col("p_age"))
    near = join_points(graph, p, [ages])
    near = top_per_group(near, ["p_id"], [F.asc("id")], most)
    known = F.array_union("p_done", "p_now")
    open_ = near.where(F.forall(or_empty(F.col("prerequisites")), lambda x: F.array_contains(known, x)))
    likely = open_.withColumn("likelihood", likelihood(F.col("p_age"), F.col("p_done")))
    return likely.withColumn("rank", F.row_number().over(Window.partitionBy("p_id").orderBy(F.desc("likelihood"), "id")))


def inferred_events() -> Column:
    """Life events that a profile's data imply."""
    # The events' names and limits of age.
    child = lambda low, high: F.coalesce(F.exists("children", lambda c: (c["age"] >= low) & (c["age"] < high)), F.lit(False))
    age = F.col("age")
    return compact(
        F.when((age < 5) & child(0, 5), "Having a baby"),
        F.when((age >= 5) & (age < 18), "Growing up"),
        F.when(child(5, 18), "Raising Kids"),
        F.when(age >= 65, "Ageing"),
        F.when(F.col("employment_status") == "employed", "Work"),
        F.when(F.col("employment_status") == "student", "Education"),
        F.when(F.col("is_carer"), "Caring for someone"),
        F.when(F.size("disabilities") > 0, "Health and Disability"),
    )


def built(profiles: DataFrame) -> DataFrame:
    """Profiles with the inferred events among the current ones.

    Where they are missing, citizenship is Australian, the state National, and lists are empty.
    """
    lists = [c for c in ("disabilities", "current_life_events", "completed_life_events", "disaster_affected") if c in profiles.columns]
    state = F.coalesce("residency_state", F.lit("National")) if "residency_state" in profiles.columns else F.lit("National")
    own = {"is_carer": F.coalesce("is_carer", F.lit(False)), "citizenship": F.coalesce("citizenship", F.array(F.lit("Australian"))), "residency_state": state}
    filled = profiles.withColumns({c: or_empty(F.col(c)) for c in lists} | own)
    return filled.withColumn("current_life_events", F.array_union("current_life_events", inferred_events()))


def life_stage(age: Column) -> Column:
    column = F.when(age < LIFE_STAGES[0][0], LIFE_STAGES[0][1])
    for limit, name in LIFE_STAGES[1:]:
        column = column.when(age < limit, name)
    return column.otherwise(LAST_STAGE)


def completeness(profiles: DataFrame) -> Column:
    """The share of the profile's fields that are filled; an empty list is not."""
    kinds = dict(profiles.dtypes)
    filled = lambda c: F.col(c).isNotNull() & (F.size(c) > 0) if kinds[c].startswith("array") else F.col(c).isNotNull()
    return sum((F.when(filled(c), 1).otherwise(0) for c in PROFILE_FIELDS), F.lit(0)) / len(PROFILE_FIELDS)


def position_columns(seed: int | None = None) -> dict[str, Column]:
    """x by age and z by cluster of an event; with a seed, spread around that as a display wants it."""
    middle = F.coalesce((F.get("typical_age_range", F.lit(0)) + F.get("typical_age_range", F.lit(1))) / 2, F.lit(30.0))
    depth = F.coalesce(*(F.when(F.col("cluster") == c, float(z)) for c, z in CLUSTER_DEPTH.items()), F.lit(0.0))
    jitter = lambda k: (F.rand(seed + k) - 0.5) * 10 if seed is not None else F.lit(0.0)
    return {"x": (middle - 30) * 2 + jitter(0), "y": F.lit(0.0), "z": depth + jitter(1)}


def positions(graph: DataFrame, seed: int | None = None) -> DataFrame:
    """Each event with its position by ``position_columns``."""
    return graph.select("id", "event_name", *(c.alias(k) for k, c in position_columns(seed).items()))


def journey_statistics(services: DataFrame, events: DataFrame) -> DataFrame:
    """Totals and the number of highly relevant services, in one row."""
    counts = services.agg(F.count("*").alias("total_services"), F.count_if(F.col("relevance_score") > 0.8).alias("high_relevance"))
    return counts.crossJoin(events.agg(F.count("*").alias("total_events")))  # one row each


def profile_facets(profile: dict, facets: dict) -> dict:
    """The search facets with blanks filled from a profile: its state unless National, its first life event."""
    found = dict(facets)
    state, events = profile.get("residency_state"), profile.get("current_life_events") or []
    if state and state != "National":
        found["state"] = found.get("state") or state
    if events:
        found["life_event"] = found.get("life_event") or events[0]
    return found


def filters_of(state: Column, events: Column, chosen_state: Column, chosen_event: Column) -> Column:
    """struct(state, life_event): what was chosen, its blanks filled from the profile of the row, as profile_facets does for one."""
    own = F.when(state != "National", F.nullif(state, F.lit("")))
    return F.struct(F.coalesce(F.nullif(chosen_state, F.lit("")), own).alias("state"), F.coalesce(F.nullif(chosen_event, F.lit("")), F.get(events, F.lit(0))).alias("life_event"))


#: Fixed: what life events say of those who have them.
EVENT_ATTRIBUTES = {
    "Having a baby": {"required_children": True, "children_age_ranges": [{"min": 0, "max": 1}]},
    "Raising Kids": {"required_children": True, "children_age_ranges": [{"min": 0, "max": 18}]},
    "Work": {"required_employment_status": ["employed", "self-employed"]},
    "Unemployment": {"required_employment_status": ["unemployed", "job-seeking"]},
    "Ageing": {"min_age": 65},
    "Disability": {"required_disabilities": ["any"]},
    "Student": {"required_employment_status": ["student"]},
    "Carer": {"required_caring_status": True},
}


def event_attributes(event: Column) -> Column:
    """A struct of the eligibility attributes of a life event, null where it says nothing."""

    def of(name: str, kind: str) -> Column:
        value = F.lit(None).cast(kind)
        for known, attributes in EVENT_ATTRIBUTES.items():
            if name in attributes:
                v = attributes[name]
                made = F.array(*(F.struct(*(F.lit(n).alias(k) for k, n in x.items())) if isinstance(x, dict) else F.lit(x) for x in v)) if isinstance(v, list) else F.lit(v)
                value = F.when(event == known, made.cast(kind)).otherwise(value)
        return value.alias(name)

    kinds = {"min_age": "int", "required_children": "boolean", "children_age_ranges": "array<struct<min: int, max: int>>", "required_employment_status": "array<string>", "required_disabilities": "array<string>", "required_caring_status": "boolean"}
    return F.struct(*(of(k, t) for k, t in kinds.items()))
