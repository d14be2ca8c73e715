"""Roll-up of fragments into services."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarryline.functions.sets import compact, or_empty, union_sets
from quarryline.operators.tagging import has_any

# Url patterns, names, words and labels of services.
KEY_PATTERNS = (r"/services/([^/]+)/([^/]+)", r"/payments-and-services/([^/]+)", r"/benefits/([^/]+)", r"/support/([^/]+)", r"/programs/([^/]+)")
NAME_PATTERNS = (
    r"(?im)^([\w\s]+(?:Payment|Pension|Allowance|Benefit|Card|Concession|Supplement|Scheme|Program|Service|Support))",
    r"(?i)\b(Age Pension|JobSeeker|Youth Allowance|Disability Support Pension|Carer Payment|Family Tax Benefit|Child Care Subsidy|Medicare|NDIS)\b",
)
SHORTENED = ("PAYMENT", "PENSION", "BENEFIT", "ALLOWANCE")
RESIDENCY = ("australian resident", "permanent resident", "citizen", "residency")
STATUSES = {
    "unemployed": ("becoming_unemployed", "looking_for_work"), "carer": ("becoming_long_term_carer", "providing_temporary_care"), "parent": ("having_baby", "raising_child", "adopting_child"),
    "senior": ("becoming_older_australian", "retiring_from_workforce"), "student": ("studying_tertiary", "studying_high_school"), "disabled": ("being_diagnosed", "experiencing_mental_illness"),
}
DEPARTMENTS = {"Centrelink": "Services Australia", "ATO": "Australian Taxation Office", "My Health Record": "Department of Health", "Unique Student Identifier": "Department of Education"}
ROLES = (
    ("eligibility", ("eligib",), ("eligib", "who-can-get")),
    ("how_to_apply", ("how to claim", "apply"), ("how-to-claim",)),
    ("payment_rates", ("how much you can get", "payment rate"), ("you-can-get",)),
    ("required_documents", ("proving your", "proof of", "prepare to claim", "supporting information", "medical evidence"), ()),
    ("reviews_appeals", ("review", "appeal"), ()),
    ("manage_service", ("change of circumstance", "update details", "manage your payment", "study changes", "report income"), ()),
    ("overview", ("overview", "about"), ()),
)
FREQUENCIES = (("fortnightly", ("fortnightly",)), ("monthly", ("monthly",)), ("quarterly", ("quarterly",)), ("annually", ("annually", "yearly")), ("one_off", ("one-off", "lump sum")))
DELIVERY = (("online", ("online", "mygov")), ("phone", ("phone", "call")), ("in_person", ("centrelink office", "service centre")), ("mobile_app", ("mobile app",)))
OTHER_NAMES = (r"(?i)also known as ([^.]+)", r"(?i)formerly ([^.]+)", r"(?i)previously called ([^.]+)", r"\(([^)]+)\)")


def service_key(url: Column) -> Column:
    """The groups of the first pattern that fits, joined by -, lower case; else null."""

    def of(pattern: str) -> Column:
        groups = [F.regexp_extract(url, pattern, k + 1) for k in range(pattern.count("("))]
        return F.when(url.rlike(pattern), F.lower(F.concat_ws("-", *groups)))

    return F.coalesce(*map(of, KEY_PATTERNS))


def _stripped(text: Column) -> Column:
    """text without white space of any kind at its ends."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def service_name(title: Column, content: Column) -> Column:
    text = F.concat_ws(" ", title, content)
    return F.coalesce(*(F.nullif(_stripped(F.regexp_extract(text, p, 1)), F.lit("")) for p in NAME_PATTERNS))


def normalized_name(name: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(name), "[^a-z0-9]", "-"), "-+", "-")


def service_id(name: Column) -> Column:
    return F.concat(F.lit("svc_"), normalized_name(name), F.lit("_"), F.substring(F.md5(normalized_name(name)), 1, 8))


def service_code(name: Column) -> Column:
    """Upper-case words: short ones whole, some common ones by their initial, others by three letters."""
    words = F.split(F.regexp_replace(F.upper(name), r"[^A-Z0-9\s]", ""), r"\s+")
    return F.array_join(F.transform(words, lambda w: F.when(F.length(w) <= 4, w).when(w.isin(*SHORTENED), F.substring(w, 1, 1)).otherwise(F.substring(w, 1, 3))), "_")


def fragment_role(title: Column, url: Column) -> Column:
    t, u = F.lower(title), F.lower(url)
    rules = [(has_any(t, titles) | has_any(u, urls), name) for name, titles, urls in ROLES]
    return reduce(lambda a, r: a.when(*r), rules[1:], F.when(*rules[0])).otherwise("general_information")


def is_eligibility(title: Column, url: Column, content: Column) -> Column:
    return F.contains(F.lower(title), F.lit("eligib")) | F.contains(F.lower(url), F.lit("eligib")) | has_any(F.lower(content), ("you can get", "you may be eligible"))


def ages(content: Column) -> Column:
    return F.transform(F.regexp_extract_all(content, F.lit(r"(?i)(?:age|aged?)\s+(\d+)"), 1), lambda a: a.try_cast("int"))


def income_limit(content: Column) -> Column:
    """The last amount of an income phrase with under or less."""
    found = F.filter(F.regexp_extract_all(content, F.lit(r"(?i)income.*?\$[\d,]+"), 0), lambda m: has_any(F.lower(m), ("under", "less")))
    amount = F.replace(F.regexp_extract(F.element_at(F.when(F.size(found) > 0, found), -1), r"\$([\d,]+)", 1), F.lit(","), F.lit(""))
    return amount.try_cast("int")


def service_type(content: Column) -> Column:
    t = F.lower(content)
    return (
        F.when(has_any(t, ("payment", "pension", "allowance")), "payment").when(has_any(t, ("concession", "discount")), "concession").when(has_any(t, ("card",)), "card")
        .when(has_any(t, ("subsidy", "rebate")), "subsidy").otherwise("support")
    )


def delivery_methods(content: Column) -> Column:
    return compact(*(F.when(has_any(F.lower(content), ws), F.lit(name)) for name, ws in DELIVERY))


def payment_frequency(content: Column) -> Column:
    return F.coalesce(*(F.when(has_any(F.lower(content), ws), F.lit(name)) for name, ws in FREQUENCIES))


def payment_amounts(content: Column) -> Column:
    """period to amount, the last of a period; null without any."""
    found = F.regexp_extract_all(content, F.lit(r"\$[\d,]+(?:\.\d{2})?(?:\s+per\s+(?:fortnight|week|month|year))?"), 0)
    period = lambda m: F.coalesce(F.nullif(F.regexp_extract(m, r"per\s+(\w+)", 1), F.lit("")), F.lit("fortnight"))
    pairs = F.transform(found, lambda m: F.struct(period(m).alias("period"), F.regexp_extract(m, r"\$([\d,]+(?:\.\d{2})?)", 1).alias("amount")))
    names = F.array_distinct(F.transform(pairs, lambda p: p["period"]))
    last = lambda n: F.element_at(F.filter(pairs, lambda p: p["period"] == n), -1)["amount"]
    return F.when(F.size(found) > 0, F.map_from_arrays(names, F.transform(names, last)))


def common_names(name: Column, contents: Column) -> Column:
    """The name and the other names that the texts of an array give, of less than 50 characters."""
    found = F.flatten(F.transform(contents, lambda c: F.array(*(F.regexp_extract(c, p, 1) for p in OTHER_NAMES))))
    return F.array_distinct(F.concat(F.array(name), F.transform(F.filter(found, lambda x: (x != "") & (F.length(x) < 50)), _stripped)))


def description(content: Column) -> Column:
    return F.concat(F.trim(F.regexp_replace(F.substring(content, 1, 200), r"\s+", " ")), F.lit("..."))


def department(provider: Column) -> Column:
    return F.coalesce(*(F.when(provider == p, F.lit(d)) for p, d in DEPARTMENTS.items()), provider)


def roll_up(fragments: DataFrame) -> DataFrame:
    """A row for each service of the fragments (id, url, title, content_text, provider, life_events, categories, search_keywords, popularity_score, pos)."""
    rows = fragments.withColumn("key", F.coalesce(service_key(F.col("url")), F.lower(service_name(F.col("title"), F.col("content_text"))))).where("key is not null")
    low = F.lower("title")
    overview = F.struct(F.when(has_any(low, ("overview", "about", "introduction")), 0).otherwise(1).alias("k"), F.when(has_any(low, ("overview", "about", "introduction")), F.col("pos")).otherwise(F.length("url")).alias("p"), "title", "url", "content_text", "provider")
    eligible = is_eligibility(F.col("title"), F.col("url"), F.col("content_text"))
    rows = rows.withColumns({"o": overview, "ages": F.when(eligible, ages(F.col("content_text"))), "limit": F.when(eligible, income_limit(F.col("content_text"))), "res": F.when(eligible, compact(*(F.when(F.contains(F.lower("content_text"), F.lit(k)), F.lit(k)) for k in RESIDENCY)))})
    statuses = compact(*(F.when(F.arrays_overlap(or_empty(F.col("life_events")), F.array(*map(F.lit, es))), F.lit(s)) for s, es in STATUSES.items()))
    rows = rows.withColumn("statuses", F.when(eligible, statuses))
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "content_text"))), lambda x: x["content_text"]), " ")
    grouped = rows.groupBy("key").agg(
        F.min("o").alias("o"), text.alias("text"), F.sort_array(F.collect_list("content_text")).alias("texts"), union_sets("life_events").alias("life_events"), union_sets("categories").alias("categories"),
        union_sets("search_keywords").alias("keywords"), F.sort_array(F.collect_set("id")).alias("fragment_ids"), F.sort_array(F.collect_set("url")).alias("urls"), F.max("popularity_score").alias("popularity_score"),
        F.max(F.array_max("ages")).alias("min_age"), F.max("limit").alias("max_income"), union_sets("res").alias("residency_requirements"), union_sets("statuses").alias("eligibility_statuses"),
    )
    name = F.coalesce(service_name(F.col("o.title"), F.col("o.content_text")), F.col("o.title"))
    named = grouped.withColumn("service_name", name)
    return named.select(
        service_id(F.col("service_name")).alias("id"), "service_name", service_code(F.col("service_name")).alias("service_code"), description(F.col("o.content_text")).alias("description"),
        F.col("o.provider").alias("provider"), department(F.col("o.provider")).alias("department"), "life_events", "categories", "keywords", "fragment_ids", "urls", F.col("o.url").alias("primary_url"),
        "popularity_score", "min_age", "max_income", "residency_requirements", "eligibility_statuses", service_type(F.col("text")).alias("service_type"), delivery_methods(F.col("text")).alias("delivery_method"),
        payment_frequency(F.col("text")).alias("payment_frequency"), payment_amounts(F.col("text")).alias("payment_amount"), common_names(F.col("service_name"), F.col("texts")).alias("common_names"),
    )
