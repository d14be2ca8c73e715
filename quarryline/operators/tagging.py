"""Rule-based tags: categories, life events, stages, providers, states, stress weights.

A taxonomy is a parameter: {label: [keywords]} in the order of the labels. It is
bounded by its file and becomes part of the plan.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Mapping, Sequence
from functools import reduce
from itertools import product

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarryline.functions.sets import compact, or_empty

Keywords = Mapping[str, Sequence[str]]

# States, rules by domain, words and weights.
STATES = {
    "NSW": "New South Wales", "VIC": "Victoria", "QLD": "Queensland", "WA": "Western Australia", "SA": "South Australia", "TAS": "Tasmania",
    "ACT": "Australian Capital Territory", "NT": "Northern Territory",
}
FEDERAL_HOSTS = ("australia.gov.au", "my.gov.au", "servicesaustralia.gov.au", "ato.gov.au", "health.gov.au", "education.gov.au")
PROVIDER_HOSTS = {
    "servicesaustralia.gov.au": "Services Australia", "my.gov.au": "Australian Government", "ato.gov.au": "Australian Taxation Office", "health.gov.au": "Department of Health",
}
PROVIDER_WORDS = ("medicare", "centrelink", "child support", "jobseeker", "austudy", "newstart")
STRESS_RULES = (
    (r"death of (a )?spouse|widow|widower", 100),
    (r"divorce|relationship breakdown", 73),
    (r"separation|separated", 65),
    (r"death of (close )?family|death of someone close|bereavement", 63),
    (r"injury|illness|diagnosed|health change|serious injury|disability|mental illness", 53),
    (r"marriage|getting married", 50),
    (r"pregnancy|having a baby|newborn", 40),
    (r"new family member|adopt|adoption", 39),
    (r"job loss|lost my job|dismissal|redundant|unemploy", 47),
    (r"reconcil|back together", 45),
    (r"retire|retirement|pension", 45),
    (r"business readjustment|restructure", 39),
    (r"financial (state|situation) change|income drop|income change|debt", 38),
    (r"change (of|in) (career|line of work)|career change", 36),
    (r"moving house|move house|relocat|change of address|change in residence", 20),
    (r"housing|living conditions|homeless|no fixed address", 25),
    (r"start(ing)? school|end(ing)? school|university|study", 26),
    (r"work hours|shift work|conditions at work", 20),
)


def load_taxonomy(text: str) -> dict:
    """A taxonomy of JSON text, labels in the order of the file."""
    return json.loads(text)


def once(c: Column, f: Callable[[Column], Column]) -> Column:
    """f(c), c computed once: rules that come one after the other would each compute it again."""
    return F.get(F.transform(F.array(c), f), F.lit(0))


def phrases(pattern: str) -> list[str]:
    """The texts that a pattern of letters, spaces, (a|b) and (a)? stands for, without those that contain another one."""
    found = set()
    for each in re.split(r"\|(?![^()]*\))", pattern):
        parts = re.split(r"(\([^()]*\)\??)", each)
        found |= {"".join(x) for x in product(*([*p.rstrip("?").strip("()").split("|"), *([""] if p.endswith("?") else [])] if p.startswith("(") else [p] for p in parts))}
    if not all(re.fullmatch("[a-z ]+", x) for x in found):
        raise ValueError(f"not a pattern of words: {pattern}")
    return sorted(x for x in found if not any(y != x and y in x for y in found))


def hits(content: Column, keywords: Sequence[str]) -> Column:
    """How many of the keywords content has; one listed twice counts twice."""
    return sum((F.when(F.contains(content, F.lit(k)), 1).otherwise(0) for k in keywords), F.lit(0))


def has_any(content: Column, keywords: Sequence[str]) -> Column:
    return reduce(lambda a, b: a | b, (F.contains(content, F.lit(k)) for k in keywords), F.lit(False))


def labels(content: Column, taxonomy: Keywords, at_least: int = 2) -> Column:
    """Labels with at least so many keyword hits."""
    return compact(*(F.when(hits(content, ks) >= at_least, F.lit(label)) for label, ks in taxonomy.items()))


def categories(content: Column, taxonomy: Keywords) -> Column:
    return once(F.lower(content), lambda c: labels(c, taxonomy))


def life_events(content: Column, taxonomy: Keywords) -> Column:
    """Events with two hits, or one by a keyword of more than six characters."""
    fits = lambda c, ks: (hits(c, ks) >= 2) | ((hits(c, ks) == 1) & has_any(c, [k for k in ks if len(k) > 6]))
    return once(F.lower(content), lambda c: compact(*(F.when(fits(c, ks), F.lit(event)) for event, ks in taxonomy.items())))


def event_score(content: Column, keywords: Sequence[str]) -> Column:
    """Whole-word occurrences of the keywords, long ones twice."""
    count = lambda k: F.regexp_count(content, F.lit(r"\b" + re.escape(k.lower()) + r"\b")) * (2 if len(k) > 6 else 1)
    return sum((count(k) for k in keywords), F.lit(0))


def primary_life_event(content: Column, events: Column, taxonomy: Keywords) -> Column:
    """The detected event with the largest score over 0, the first of equal ones; else null."""
    content = F.lower(content)
    scored = compact(
        *(F.when(F.array_contains(events, event) & (event_score(content, ks) > 0), F.struct((-event_score(content, ks)).alias("s"), F.lit(i).alias("i"), F.lit(event).alias("e"))) for i, (event, ks) in enumerate(taxonomy.items()))
    )
    return F.get(F.sort_array(scored), F.lit(0))["e"]


def first_label(content: Column, taxonomy: Keywords, default: str | None = None) -> Column:
    """The first label with a keyword in content."""
    return once(F.lower(content), lambda c: F.coalesce(*(F.when(has_any(c, ks), F.lit(label)) for label, ks in taxonomy.items()), F.lit(default).cast("string")))


def stage(content: Column, primary: Column, stages: Mapping[str, Keywords]) -> Column:
    """The stage of the primary event."""
    return F.coalesce(*(F.when(primary == event, first_label(content, ks)) for event, ks in stages.items()), F.lit(None).cast("string"))


def stage_variant(content: Column, primary: Column, variants: Mapping[str, Keywords]) -> Column:
    return F.coalesce(*(F.when(primary == event, first_label(content, ks, "No")) for event, ks in variants.items()), F.lit(None).cast("string"))


def provider(url: Column, content: Column, taxonomy: Mapping[str, Keywords] | None = None) -> Column:
    """struct(governance, provider): by domain, then the taxonomy ({governance: {provider: patterns}}), then words, then the domain's end."""
    return once(F.lower(content), lambda c: once(F.lower(url), lambda low: _provider(url, low, c, taxonomy)))


def _provider(url: Column, low: Column, content: Column, taxonomy: Mapping[str, Keywords] | None) -> Column:
    of = lambda governance, name: F.struct(F.lit(governance).alias("governance"), (name if isinstance(name, Column) else F.lit(name)).alias("provider"))
    rules = [(F.contains(low, F.lit(h)), of("Federal Government", name)) for h, name in PROVIDER_HOSTS.items()]
    for governance, providers in (taxonomy or {}).items():
        rules += [(has_any(low, patterns) | has_any(content, patterns), of(governance, name)) for name, patterns in providers.items()]
    code = F.regexp_extract(url, r"\.(\w{2,3})\.gov\.au", 1)
    rules += [
        (has_any(content, PROVIDER_WORDS), of("Federal Government", "Services Australia")),
        (F.contains(low, F.lit(".gov.au")) & (code != ""), of("State Government", F.concat(F.upper(code), F.lit(" Government")))),
        (F.contains(low, F.lit(".gov.au")), of("Federal Government", "Australian Government")),
    ]
    return reduce(lambda a, r: a.when(*r), rules[1:], F.when(*rules[0])).otherwise(of("Non-Government", "External Provider"))


def states(url: Column, content: Column) -> Column:
    """State codes by domain and phrase; National for federal sites and where none is found."""
    return once(F.lower(content), lambda c: once(F.lower(url), lambda low: _states(url, low, c)))


def _states(url: Column, low: Column, content: Column) -> Column:
    in_url = {code: F.contains(low, F.lit(f".{code.lower()}.gov.au")) for code in STATES}
    by_url = compact(*(F.when(c, F.lit(code)) for code, c in in_url.items()))
    phrases = lambda code, name: [p.lower() for n in (code, name) for p in (f"{n} residents", f"{n} government", f"in {n}", f"{n} only")]
    by_phrase = compact(*(F.when(has_any(content, phrases(code, name)) & ~in_url[code], F.lit(code)) for code, name in STATES.items()))
    federal = F.contains(url, F.lit(".gov.au")) & (F.size(by_url) == 0) & has_any(url, FEDERAL_HOSTS)
    found = F.concat(by_url, by_phrase)
    return F.when(federal | (F.size(found) == 0), F.array(F.lit("National"))).otherwise(found)


def task_order(html: Column) -> Column:
    """The number after step or stage, else how many list items there are; null without."""
    number = F.regexp_extract(html, r"(?i)(?:step|stage)\s*(\d+)", 1)
    items = F.regexp_count(html, F.lit(r"(?s)<li[^>]*>.*?</li>"))
    return F.when(number != "", number.try_cast("int")).when(items > 0, items)


def stress_weight(text: Column) -> Column:
    """The weight of the first rule that fits; 0 without."""
    rules = [(phrases(p), weight) for p, weight in STRESS_RULES]
    first = lambda low: reduce(lambda a, r: a.when(has_any(low, r[0]), r[1]), rules[1:], F.when(has_any(low, rules[0][0]), rules[0][1])).otherwise(0)
    return once(F.lower(F.coalesce(text, F.lit(""))), first)


def stress_score(events: Column, stage_: Column, variant: Column, title: Column, content: Column) -> Column:
    """The largest weight of events, stage and variant; if that is 0, of title and content."""
    named = F.array_max(F.transform(F.concat(or_empty(events), F.array(stage_, variant)), stress_weight))
    return F.when(F.coalesce(named, F.lit(0)) > 0, named).otherwise(F.greatest(stress_weight(title), stress_weight(content)))


def component_type(form: Column, table: Column, checklist: Column, alert: Column, card: Column, video: Column) -> Column:
    return F.when(form, "form").when(table, "table").when(checklist, "checklist").when(alert, "alert").when(card, "card").when(video, "video").otherwise("content")


def section_type(form: Column, table: Column, checklist: Column, alert: Column, info: Column) -> Column:
    return F.when(form, "form").when(table, "table").when(checklist, "checklist").when(alert, "alert").when(info, "info_box").otherwise("content")
