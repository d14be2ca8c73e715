"""Registered queries that read whole texts: structured pages, tags, stress, services, link lists and filters, each beside its SQL oracle.

The tables' words are invented, so a document becomes a story or a structured page
by replacing some of its words, or by setting them in markup. Both engines derive
the same texts.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.functions import urls as U
from quarryline.operators import graph as G
from quarryline.operators import html as P
from quarryline.operators import pages as A
from quarryline.operators import profile as Q
from quarryline.operators import search as S
from quarryline.operators import services as V
from quarryline.operators import similarity as J
from quarryline.operators import tagging as X
from quarryline.plans.catalog import ORACLE_SQL, query, table
from quarryline.plans.engine_queries import _GRAPH, _LIST, _WORDS, _joined, _nth, event_graph
from quarryline.sources import readers as R

#: Words of the tables and what stands for them in stories.
STORY = {
    "erst": "widowed", "erth": "separated", "onan": "diagnosed", "erwh": "pension", "onth": "moving house", "erha": "lost my job", "ering": "medicare", "onin": "in nsw", "onhe": "victoria government",
    "reen": "aged 65", "ernd": "age 17", "antion": "income under $1,250", "erly": "income over $9,000", "onha": "australian resident", "thanea": "Carer Payment", "erou": "$25.50 per week", "ontion": "you can get",
    "enen": "also known as the old one.", "onou": "fortnightly", "oner": "by phone", "oned": "a $310", "eriner": "rebate", "anan": "university",
}
_TOLD = reduce(lambda s, w: f"replace({s}, ' {w[0]} ', ' {w[1]} ')", STORY.items(), "text")
_HOSTS = ("www.health.gov.au", "x.vic.gov.au", "y.gov.au", "other.org", "my.gov.au")
_PATHS = ("services/{}/{}", "payments-and-services/{}", "benefits/{}", "support/{}", "programs/{}", "about/{}")
_EVENT_NAMES = tuple(e for es in V.STATUSES.values() for e in es)
_URL = f"'https://' || {_LIST(_HOSTS)}[doc_id % 5 + 1] || '/' || [" + ", ".join("'" + p.replace("{}/{}", "' || lang || '/' || source || '").replace("{}", "' || source || '") + "'" for p in _PATHS) + "][doc_id % 6 + 1] || '/y'"
_ST = f"""st AS (SELECT doc_id AS pos, doc_id::VARCHAR AS id, {_URL} AS url, %%SENTENCE(text) AS title, {_TOLD} AS t, coalesce(lang, 'xx') AS lang, coalesce(source, 'none') AS source, {_LIST(_EVENT_NAMES)}[doc_id % {len(_EVENT_NAMES)} + 1] AS event, (n_chars % 100)::INTEGER AS popularity
  FROM (SELECT doc_id, coalesce(text, '') AS text, lang AS lang0, coalesce(lang, 'xx') AS lang, coalesce(source, 'none') AS source, n_chars FROM documents))"""


def stories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as fragments of services, with words in place of some of theirs."""
    k, lang, source = F.col("doc_id"), F.coalesce("lang", F.lit("xx")), F.coalesce("source", F.lit("none"))
    text = F.coalesce("text", F.lit(""))
    told = reduce(lambda c, w: F.replace(c, F.lit(f" {w[0]} "), F.lit(f" {w[1]} ")), STORY.items(), text)
    path = F.get(F.array(F.format_string(_PATHS[0].replace("{}", "%s"), lang, source), *(F.format_string(p.replace("{}", "%s"), source) for p in _PATHS[1:])), (k % 6).cast("int"))
    return table(spark, sf_dir, "documents").select(
        k.alias("pos"), k.cast("string").alias("id"), F.concat(F.lit("https://"), _nth(_HOSTS, k), F.lit("/"), path, F.lit("/y")).alias("url"), F.regexp_extract(text, r"^([^.\n]*)", 1).alias("title"), told.alias("content_text"),
        source.alias("provider"), F.array(_nth(_EVENT_NAMES, k)).alias("life_events"), F.array(lang).alias("categories"), F.array(source).alias("search_keywords"), (F.col("n_chars") % 100).cast("int").alias("popularity_score"),
    )


# Tags of texts.


def _stress_sql(text: str) -> str:
    return "(CASE " + " ".join(f"WHEN regexp_matches(lower({text}), '{p}') THEN {w}" for p, w in X.STRESS_RULES) + " ELSE 0 END)"


@query(f"WITH {_ST} SELECT id, {_stress_sql('t')}::INTEGER AS weight, (CASE WHEN pos % 4 = 0 AND {_stress_sql('t')} > 0 THEN {_stress_sql('t')} ELSE greatest({_stress_sql('title')}, {_stress_sql('t')}) END)::INTEGER AS score FROM st")
def stress_of_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = F.when(F.col("pos") % 4 == 0, F.array("content_text")).otherwise(F.array().cast("array<string>"))
    none = F.lit(None).cast("string")
    return stories(spark, sf_dir).select("id", X.stress_weight(F.col("content_text")).alias("weight"), X.stress_score(events, none, none, F.col("title"), F.col("content_text")).alias("score"))


_PROVIDERS = {"Local Government": {"Council": ("src7", "erer"), "Shire": ("src1/",)}}
_ANY = lambda c, ws: "(" + " OR ".join(f"contains({c}, '{w}')" for w in ws) + ")"


def _provider_sql() -> str:
    rules = [(f"contains(lower(url), '{h}')", "'Federal Government'", f"'{n}'") for h, n in X.PROVIDER_HOSTS.items()]
    rules += [(f"({_ANY('lower(url)', ws)} OR {_ANY('lower(t)', ws)})", f"'{g}'", f"'{n}'") for g, of in _PROVIDERS.items() for n, ws in of.items()]
    code = r"regexp_extract(url, '\.(\w{2,3})\.gov\.au', 1)"
    rules += [
        (_ANY("lower(t)", X.PROVIDER_WORDS), "'Federal Government'", "'Services Australia'"),
        (f"contains(lower(url), '.gov.au') AND {code} <> ''", "'State Government'", f"upper({code}) || ' Government'"),
        ("contains(lower(url), '.gov.au')", "'Federal Government'", "'Australian Government'"),
    ]
    case = lambda k, last: "CASE " + " ".join(f"WHEN {r[0]} THEN {r[k]}" for r in rules) + f" ELSE '{last}' END"
    return f"{case(1, 'Non-Government')} AS governance, {case(2, 'External Provider')} AS provider"


def _states_sql() -> str:
    """Codes by url, then codes by phrase; National for federal sites and without any."""
    in_url = {c: f"contains(lower(url), '.{c.lower()}.gov.au')" for c in X.STATES}
    said = {c: _ANY("lower(t)", [p.lower() for n in (c, name) for p in (f"{n} residents", f"{n} government", f"in {n}", f"{n} only")]) for c, name in X.STATES.items()}
    parts = [f"CASE WHEN {b} THEN '{c}' END" for c, b in in_url.items()] + [f"CASE WHEN {said[c]} AND NOT {in_url[c]} THEN '{c}' END" for c in X.STATES]
    federal = f"contains(url, '.gov.au') AND NOT ({' OR '.join(in_url.values())}) AND {_ANY('url', X.FEDERAL_HOSTS)}"
    return f"CASE WHEN {federal} THEN 'National' ELSE coalesce(nullif(concat_ws(',', {', '.join(parts)}), ''), 'National') END AS states"


@query(f"WITH {_ST} SELECT id, {_provider_sql()}, {_states_sql()} FROM st")
def tags_of_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    url, text = F.col("url"), F.col("content_text")
    tagged = stories(spark, sf_dir).select("id", X.provider(url, text, _PROVIDERS).alias("p"), _joined(X.states(url, text)).alias("states"))
    return tagged.select("id", "p.governance", "p.provider", "states")


# Services.

_KEY = "coalesce(" + ", ".join(f"CASE WHEN regexp_matches(url, '{p}') THEN lower(concat_ws('-', " + ", ".join(f"regexp_extract(url, '{p}', {i + 1})" for i in range(p.count("("))) + ")) END" for p in V.KEY_PATTERNS) + ")"
_TRIM = lambda c: rf"regexp_replace({c}, '^\s+|\s+$', '', 'g')"
_NAME = lambda title, text: "coalesce(" + ", ".join(f"nullif({_TRIM(f"regexp_extract({title} || ' ' || {text}, '{p}', 1)")}, '')" for p in V.NAME_PATTERNS) + ")"
_ELIGIBLE = f"(contains(lower(title), 'eligib') OR contains(lower(url), 'eligib') OR {_ANY('lower(t)', ('you can get', 'you may be eligible'))})"
_AGES = r"list_transform(regexp_extract_all(t, '(?i)(?:age|aged?)\s+(\d+)', 1), lambda a: try_cast(a AS INTEGER))"
_LIMIT = r"try_cast(replace(regexp_extract(list_filter(regexp_extract_all(t, '(?i)income.*?\$[\d,]+'), lambda m: contains(lower(m), 'under') OR contains(lower(m), 'less'))[-1], '\$([\d,]+)', 1), ',', '') AS INTEGER)"
_TYPE = lambda t: f"CASE WHEN {_ANY(t, ('payment', 'pension', 'allowance'))} THEN 'payment' WHEN {_ANY(t, ('concession', 'discount'))} THEN 'concession' WHEN {_ANY(t, ('card',))} THEN 'card' WHEN {_ANY(t, ('subsidy', 'rebate'))} THEN 'subsidy' ELSE 'support' END"
_FREQUENCY = lambda t: "CASE " + " ".join(f"WHEN {_ANY(t, ws)} THEN '{n}'" for n, ws in V.FREQUENCIES) + " END"
_DELIVERY = lambda t: "concat_ws(',', " + ", ".join(f"CASE WHEN {_ANY(t, ws)} THEN '{n}' END" for n, ws in V.DELIVERY) + ")"
_DESCRIBED = lambda t: rf"trim(regexp_replace({t}[1:200], '\s+', ' ', 'g'), ' ') || '...'"


@query(f"""
WITH {_ST} SELECT id, {_KEY} AS key, {_NAME('title', 't')} AS name, {_ELIGIBLE} AS eligible, array_to_string({_AGES}, ',') AS ages, {_LIMIT} AS income_limit, {_TYPE('lower(t)')} AS service_type, {_FREQUENCY('lower(t)')} AS frequency,
  {_DELIVERY('lower(t)')} AS delivery, md5({_DESCRIBED('t')}) AS description FROM st
""")
def service_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each text says of a service."""
    url, title, text = F.col("url"), F.col("title"), F.col("content_text")
    return stories(spark, sf_dir).select(
        "id", V.service_key(url).alias("key"), V.service_name(title, text).alias("name"), V.is_eligibility(title, url, text).alias("eligible"), _joined(V.ages(text).cast("array<string>")).alias("ages"), V.income_limit(text).alias("income_limit"),
        V.service_type(text).alias("service_type"), V.payment_frequency(text).alias("frequency"), _joined(V.delivery_methods(text)).alias("delivery"), F.md5(V.description(text)).alias("description"),
    )


_SLUG = lambda c: f"regexp_replace(regexp_replace(lower({c}), '[^a-z0-9]', '-', 'g'), '-+', '-', 'g')"
_STATUS = ", ".join(f"CASE WHEN event IN ({', '.join(f"'{e}'" for e in es)}) THEN '{s}' END" for s, es in V.STATUSES.items())
_RESIDENCY = ", ".join(f"CASE WHEN contains(lower(t), '{w}') THEN '{w}' END" for w in V.RESIDENCY)
_PAID = r"\$[\d,]+(?:\.\d{2})?(?:\s+per\s+(?:fortnight|week|month|year))?"
_OTHERS = "list_concat(" + ", ".join(f"list_transform(texts, lambda c: regexp_extract(c, '{p}', 1))" for p in V.OTHER_NAMES) + ")"


@query(f"""
WITH {_ST}, k AS (SELECT *, coalesce({_KEY}, lower({_NAME('title', 't')})) AS key, {_ELIGIBLE} AS ok, {_AGES} AS ages, {_LIMIT} AS lim, {_ANY('lower(title)', ('overview', 'about', 'introduction'))} AS over FROM st),
r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY CASE WHEN over THEN 0 ELSE 1 END, CASE WHEN over THEN pos ELSE length(url) END, title, url, t, source) AS r FROM k WHERE key IS NOT NULL),
o AS (SELECT key, title, url, t, source, coalesce({_NAME('title', 't')}, title) AS name FROM r WHERE r = 1),
g AS (SELECT key, string_agg(t, ' ' ORDER BY pos) AS whole, list(t ORDER BY t) AS texts, count(DISTINCT id) AS fragments, string_agg(DISTINCT url, ',' ORDER BY url) AS urls, string_agg(DISTINCT event, ',' ORDER BY event) AS life_events, max(popularity) AS popularity_score,
  max(list_max(ages)) FILTER (ok) AS min_age, max(lim) FILTER (ok) AS max_income FROM k WHERE key IS NOT NULL GROUP BY 1),
u AS (SELECT key, string_agg(DISTINCT x, ',' ORDER BY x) AS statuses FROM (SELECT key, unnest([{_STATUS}]) AS x FROM k WHERE ok) WHERE x IS NOT NULL GROUP BY 1),
v AS (SELECT key, string_agg(DISTINCT x, ',' ORDER BY x) AS residency FROM (SELECT key, unnest([{_RESIDENCY}]) AS x FROM k WHERE ok) WHERE x IS NOT NULL GROUP BY 1),
m AS (SELECT key, unnest(regexp_extract_all(whole, '{_PAID}')) AS m, generate_subscripts(regexp_extract_all(whole, '{_PAID}'), 1) AS nth FROM g),
a AS (SELECT key, coalesce(nullif(regexp_extract(m, 'per\\s+(\\w+)', 1), ''), 'fortnight') AS period, arg_max(regexp_extract(m, '\\$([\\d,]+(?:\\.\\d{{2}})?)', 1), nth) AS amount FROM m GROUP BY 1, 2),
p AS (SELECT key, string_agg(period || '=' || amount, ',' ORDER BY period) AS paid FROM a GROUP BY 1)
SELECT 'svc_' || {_SLUG('name')} || '_' || md5({_SLUG('name')})[1:8] AS id, name AS service_name, md5({_DESCRIBED('o.t')}) AS description, o.source AS provider, o.url AS primary_url, fragments, urls, life_events, popularity_score, min_age, max_income,
  coalesce(statuses, '') AS statuses, coalesce(residency, '') AS residency, {_TYPE('lower(whole)')} AS service_type, {_DELIVERY('lower(whole)')} AS delivery, {_FREQUENCY('lower(whole)')} AS payment_frequency, coalesce(paid, '') AS paid,
  array_to_string(list_sort(list_distinct(list_concat([name], list_transform(list_filter({_OTHERS}, lambda x: x <> '' AND length(x) < 50), lambda x: {_TRIM('x')})))), '|') AS names
FROM g JOIN o USING (key) LEFT JOIN u USING (key) LEFT JOIN v USING (key) LEFT JOIN p USING (key)
""")
def services_in_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Services of stories with all that their texts say."""
    paid = F.array_join(F.sort_array(F.transform(F.map_entries("payment_amount"), lambda e: F.concat_ws("=", e["key"], e["value"]))), ",")
    return V.roll_up(stories(spark, sf_dir)).select(
        "id", "service_name", F.md5("description").alias("description"), "provider", "primary_url", F.size("fragment_ids").cast("long").alias("fragments"), _joined("urls").alias("urls"), _joined("life_events").alias("life_events"), "popularity_score",
        "min_age", "max_income", _joined(F.coalesce("eligibility_statuses", F.array().cast("array<string>"))).alias("statuses"), _joined(F.coalesce("residency_requirements", F.array().cast("array<string>"))).alias("residency"), "service_type",
        _joined("delivery_method").alias("delivery"), "payment_frequency", F.coalesce(paid, F.lit("")).alias("paid"), F.array_join(F.sort_array("common_names"), "|").alias("names"),
    )


# Structured pages.

_CRUMBS = (
    '<ul class="breadcrumb"><li>Home</li><li>&gt;</li><li>{}</li></ul>', '<nav aria-label="breadcrumb"><ol><li>Home</li><li>/</li><li>{}</li></ol></nav>', '<div class="my-breadcrumb-x"><ul><li>{}</li></ul></div>', "<p>{}</p>",
)
_BOXES = ('<form class="f"><input name="q"></form>', "<table><tr><td>{}</td></tr></table>", '<ul class="checklist big"><li>{}</li></ul>', '<div class="content alert"><p>{}</p></div>', "<p><i>{}</i></p>")


def structured_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as pages with breadcrumbs, four levels of headings and standalone sections."""
    words = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit("[A-Za-z]+"), 0)
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("source", F.lit("none")).alias("source"), words.alias("w"))
    w = lambda i: F.coalesce(F.get("w", F.lit(i)), F.lit("x"))
    of = lambda forms, c: F.replace(_nth(forms, F.col("doc_id")), F.lit("{}"), c)
    parts = (
        "<html><head><title>", w(0), "</title></head><body>", of(_CRUMBS, F.col("source")), "<main><h1>", w(0), "</h1><p>", F.array_join("w", " "), '</p><h2 id="b">', w(1), "</h2>", of(_BOXES, w(2)), "<h3>", w(3), '</h3><ol class="steps"><li>', w(4),
        "</li></ol><h4>", w(5), '</h4><div class="content card"><p>', w(6), '</p></div><div class="alert" aria-label="Note">', w(7), '</div><div role="alert"><b>', w(8), '</b></div><div class="info-panel">', w(9), "</div></main></body></html>",
    )
    url = F.concat(F.lit("https://www.x.org/"), "source", F.lit("/"), F.col("doc_id").cast("string"))
    return docs.select("doc_id", url.alias("url"), F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts)).alias("html"))


def _structured_sql() -> str:
    """A row for each part: kind of page k, level, heading, text, flags and what follows from them."""
    w = [f"coalesce(w[{i + 1}], 'x')" for i in range(10)]
    kind = "CASE doc_id % 5 WHEN 0 THEN 'form' WHEN 1 THEN 'table' WHEN 2 THEN 'checklist' WHEN 3 THEN 'alert' ELSE 'content' END"
    boxed = f"CASE WHEN doc_id % 5 = 0 THEN '' ELSE {w[2]} END"
    classes = "CASE doc_id % 5 WHEN 0 THEN 'f' WHEN 2 THEN 'checklist,big' WHEN 3 THEN 'content,alert' ELSE '' END"
    n = f"len(list_filter(string_split_regex({w[0]} || array_to_string(w, ' '), '\\s+'), lambda x: x <> ''))"
    rows = (
        # ord, level, heading, text, anchor, kind, form, list, classes, score
        (1, 1, w[0], "array_to_string(w, ' ')", "NULL", "'content'", "false", "false", "''", f"least(100, 100 + CASE WHEN {n} > 50 AND {n} < 500 THEN 10 ELSE 0 END)"),
        (2, 2, w[1], boxed, "'b'", kind, "doc_id % 5 = 0", "doc_id % 5 = 2", classes, "CASE WHEN doc_id % 5 IN (0, 1, 2, 3) THEN 100 ELSE 90 END"),
        (3, 3, w[3], w[4], "NULL", "'checklist'", "false", "true", "'steps'", "90"),
        (4, 4, w[5], w[6], "NULL", "'card'", "false", "false", "'content,card'", "70"),
        (5, "NULL", "'Important Information'", w[2], "NULL", "CASE WHEN doc_id % 5 = 3 THEN 'alert' END", "NULL", "NULL", "NULL", "NULL"),
        (6, "NULL", "'Note'", w[7], "NULL", "'alert'", "NULL", "NULL", "NULL", "NULL"),
        (7, "NULL", "'Important Information'", w[9], "NULL", "'info_box'", "NULL", "NULL", "NULL", "NULL"),
        (8, "NULL", "'Important Information'", w[8], "NULL", "'alert'", "NULL", "NULL", "NULL", "NULL"),
        (9, "NULL", "'Important Information'", w[2], "NULL", "CASE WHEN doc_id % 5 = 2 THEN 'checklist' END", "NULL", "NULL", "NULL", "NULL"),
    )
    each = " UNION ALL ".join(
        f"SELECT doc_id, w, source, crumbs, page, {o} AS ord, {lv}::INTEGER AS level, {h} AS title, {t} AS text, {a}::VARCHAR AS own, {k} AS component_type, ({f})::BOOLEAN AS has_form, ({li})::BOOLEAN AS has_checklist, ({c})::VARCHAR AS classes, ({s})::INTEGER AS popularity_score FROM d"
        for o, lv, h, t, a, k, f, li, c, s in rows
    )
    return f"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+') AS w, coalesce(source, 'none') AS source, 'https://www.x.org/' || coalesce(source, 'none') || '/' || doc_id AS page,
  CASE WHEN doc_id % 4 < 2 THEN ['Home', coalesce(source, 'none')] WHEN doc_id % 4 = 2 THEN [coalesce(source, 'none')] ELSE [] END AS crumbs FROM documents),
r AS ({each}), i AS (SELECT *, md5(page || CASE WHEN level IS NULL THEN '' ELSE title END || text) AS id FROM r WHERE component_type IS NOT NULL)
SELECT id, page || '#' || coalesce(own, id) AS url, CASE WHEN level IS NOT NULL THEN page END AS page_url, CASE WHEN level IS NOT NULL THEN coalesce(own, id) END AS anchor, title, text AS content_text,
  array_to_string(CASE WHEN level IS NULL THEN crumbs ELSE list_append(crumbs, title) END, '>') AS page_hierarchy,
  CASE WHEN level = 1 THEN title WHEN len(crumbs) > 0 THEN crumbs[-1] WHEN level IS NULL THEN title ELSE {w[0]} END AS hierarchy_lvl0, CASE WHEN level > 1 THEN {w[1]} END AS hierarchy_lvl1,
  CASE WHEN level > 2 THEN {w[3]} END AS hierarchy_lvl2, CASE WHEN level > 3 THEN {w[5]} END AS hierarchy_lvl3, component_type, has_form, has_checklist, classes, popularity_score, 100 - coalesce(popularity_score, 0) AS popularity_sort,
  row_number() OVER (PARTITION BY doc_id ORDER BY ord)::INTEGER - 1 AS pos FROM i
"""


@query(_structured_sql())
def structured_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fragments of all levels and all standalone sections of pages that are built from the documents."""
    return P.fragments(structured_pages(spark, sf_dir), 1, 0).select(
        "id", "url", "page_url", "anchor", "title", "content_text", F.array_join("page_hierarchy", ">").alias("page_hierarchy"), *(f"hierarchy_lvl{k}" for k in range(4)), "component_type", "has_form", "has_checklist", _joined("classes").alias("classes"),
        "popularity_score", "popularity_sort", "pos",
    )


# Links and filters.


def _frontier_sql(most: int, text: str) -> str:
    anchors = r"""regexp_extract_all(html, '(?is)<a\s[^>]*href\s*=\s*"[^"]+"[^>]*>.*?</a>')"""
    score = " + ".join(f"contains(t, '{w}')::INTEGER" for w in ("service", "eligibility", "apply", "benefit", "support", "help", "information"))
    skipped = r"regexp_matches(href, '(?i)\.(pdf|doc|docx|xls|xlsx|ppt|pptx)$') OR contains(href, '#') OR contains(href, '/search?') OR contains(href, '/login') OR contains(href, '/logout')"
    return rf"""
WITH l AS (SELECT url, unnest({anchors}) AS a, generate_subscripts({anchors}, 1) AS nth FROM pages),
h AS (SELECT url, nth, lower({text}) AS t, regexp_extract(a, '(?i)href\s*=\s*"([^"]+)"', 1) AS href FROM l),
k AS (SELECT url, nth, regexp_extract(url, '^([A-Za-z]+://[^/?#]*)', 1) || href AS link, {score} AS score FROM h WHERE starts_with(href, '/') AND NOT ({skipped})),
f AS (SELECT url, link, min(nth) AS nth, max(score) AS score FROM k GROUP BY ALL), n AS (SELECT *, row_number() OVER (PARTITION BY url ORDER BY score DESC, nth) AS r FROM f)
SELECT url, link, score FROM n WHERE r <= {most}
"""


ORACLE_SQL["link_frontier"] = _frontier_sql(5, "regexp_replace(a, '<[^>]*>', ' ', 'g')")


@query(_frontier_sql(3, "replace(replace(regexp_replace(a, '<[^>]*>', ' ', 'g'), 'th', ' help '), 'on', 'benefit')"))
def followed_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three most relevant links of each page, with words that make a link relevant in place of some syllables."""
    text = F.replace(F.replace(F.regexp_replace("a", "<[^>]*>", " "), F.lit("th"), F.lit(" help ")), F.lit("on"), F.lit("benefit"))
    return R.frontier(table(spark, sf_dir, "pages"), 3, text).select("url", "link", "score")


@query(r"""
WITH l AS (SELECT %%HOST(url) AS page_url, url, page_id, unnest(regexp_extract_all(html, '(?i)href\s*=\s*"([^"]+)"', 1)) AS href, generate_subscripts(regexp_extract_all(html, '(?i)href\s*=\s*"([^"]+)"', 1), 1) AS nth FROM pages),
f AS (SELECT page_url, regexp_extract(url, '^([A-Za-z]+://[^/?#]*)', 1) || href AS link, min((page_id, nth)) AS place FROM l WHERE starts_with(href, '/') GROUP BY ALL)
SELECT page_url, least(count(*), 500)::INTEGER AS n, md5(array_to_string(list(link ORDER BY place)[1:500], ' ')) AS out_links FROM f GROUP BY 1
""")
def links_of_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 500 links of each host's pages, in order; a host stands for a page and its pages for fragments."""
    rows = table(spark, sf_dir, "pages").select(U.host(F.col("url")).alias("page_url"), "url", F.col("page_id").alias("pos"), F.col("html").alias("content_html"))
    links = rows.withColumn("content_html", F.array_join(F.transform(F.filter(U.hrefs(F.col("content_html")), lambda h: F.startswith(h, F.lit("/"))), lambda h: F.concat(F.lit('<a href="'), U.resolve(h, F.col("url")), F.lit('">'))), ""))
    return A.page_links(links).select("page_url", F.size("out_links").alias("n"), F.md5(F.array_join("out_links", " ")).alias("out_links"))


@query(f"""
WITH {_GRAPH}, d AS (SELECT DISTINCT coalesce(source, 'none') || doc_id % 9 AS url, {_LIST(_WORDS)}[doc_id % 48 % {len(_WORDS)} + 1] || ' ' || doc_id % 48 AS event_name FROM documents)
SELECT url, coalesce(string_agg(DISTINCT status, ',' ORDER BY status), '') AS statuses, min(ages[1])::INTEGER AS youngest, max(ages[2])::INTEGER AS oldest, max(g.k)::BIGINT AS days FROM d LEFT JOIN g USING (event_name) GROUP BY 1
""")
def page_graph_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages (nine for each source) with what the graph says of their events."""
    k = F.col("doc_id") % 48
    pages = table(spark, sf_dir, "documents").groupBy(F.concat(F.coalesce("source", F.lit("none")), (F.col("doc_id") % 9).cast("string")).alias("url")).agg(F.collect_set(F.concat_ws(" ", _nth(_WORDS, k), k.cast("string"))).alias("life_events"))
    graph = event_graph(spark, sf_dir).withColumn("typical_duration_days", F.col("id").cast("long"))
    found = A.graph_facts(pages, graph)
    return found.select("url", _joined("eligibility_statuses").alias("statuses"), F.get("typical_age_range", F.lit(0)).alias("youngest"), F.get("typical_age_range", F.lit(1)).alias("oldest"), F.col("typical_duration_days").alias("days"))


@query("""
WITH p AS (SELECT page_id, %%HOST(url) AS host FROM pages), s AS (SELECT page_id, host, CASE WHEN ends_with(host, '.example.com') THEN 'A' WHEN ends_with(host, '.com') OR ends_with(host, 'example.com') THEN 'B' END AS site FROM p)
SELECT site, count(*) AS pages, count(DISTINCT host) AS hosts FROM s GROUP BY 1
""")
def pages_by_site(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages by the site that their host ends with; the first site goes before the second."""
    rows = table(spark, sf_dir, "pages").select(U.host(F.col("url")).alias("host"))
    return rows.withColumn("site", S.site_of(F.col("host"), ".example.com", ".com")).groupBy("site").agg(F.count("*").alias("pages"), F.countDistinct("host").alias("hosts"))


@query("SELECT doc_id FROM documents WHERE doc_id % 3 IN (0, 2) AND lang IN ('en', 'de') AND source IN ('src1', 'src7', 'src13')")
def facets_any_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Any of several events, categories and providers; the state National is no filter."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.array(F.concat(F.lit("e"), (F.col("doc_id") % 3).cast("string"))).alias("life_events"), F.array("lang").alias("categories"), F.col("source").alias("provider"))
    return docs.where(S.facet_filter({"life_event": ["e0", "e2"], "category": ["en", "de"], "provider": ["src1", "src7", "src13"], "state": "National"}, required=True)).select("doc_id")


@query("""
WITH p AS (SELECT c_custkey AS p_id, c_custkey % 90 AS age, n_name AS own, CASE WHEN c_custkey % 5 = 0 THEN 'CHINA' END AS other FROM customer JOIN nation ON n_nationkey = c_nationkey),
d AS (SELECT n_nationkey AS id, n_nationkey AS min_age, n_nationkey + 40 AS max_age, CASE WHEN n_nationkey % 4 = 0 THEN NULL ELSE n_name END AS wanted FROM nation)
SELECT p_id, id FROM p JOIN d ON age BETWEEN min_age AND max_age AND (wanted IS NULL OR wanted = own OR coalesce(wanted = other, false) OR (wanted = 'JAPAN' AND own = 'INDIA'))
""")
def services_by_citizenship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Services of nations, some for their citizens alone, and the people they fit."""
    k, none = F.col("c_custkey"), F.lit(None).cast("array<string>")
    nation = table(spark, sf_dir, "nation")
    owns = F.array_compact(F.array("n_name", F.when(k % 5 == 0, "CHINA")))
    people = table(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(k.alias("id"), (k % 90).cast("int").alias("age"), F.lit(1).alias("income"), owns.alias("citizenship"))
    wanted = F.when(F.col("n_nationkey") % 4 == 0, none).when(F.col("n_name") == "JAPAN", F.array(F.lit("INDIA"), "n_name")).otherwise(F.array("n_name"))
    docs = nation.select(F.col("n_nationkey").alias("id"), F.col("n_nationkey").cast("int").alias("min_age"), (F.col("n_nationkey") + 40).cast("int").alias("max_age"), F.lit(0).alias("min_income"), F.lit(2).alias("max_income"), wanted.alias("required_citizenship"))
    return Q.matched(docs, people).select("p_id", "id")


@query("""
WITH p AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 2 = 0 THEN 'NSW' WHEN c_custkey % 3 = 0 THEN 'National' END AS state, CASE WHEN c_custkey % 4 > 0 THEN 'e' || (c_custkey % 3) END AS event FROM customer),
f AS (SELECT CASE WHEN doc_id % 2 = 0 THEN 'NSW' ELSE 'VIC' END AS state, 'e' || (doc_id % 3) AS event, count(*) AS n FROM documents GROUP BY ALL)
SELECT id, nullif(state, 'National') AS state, event, (SELECT coalesce(sum(n), 0) FROM f WHERE (nullif(p.state, 'National') IS NULL OR f.state = p.state) AND (p.event IS NULL OR f.event = p.event))::BIGINT AS hits FROM p
""")
def profile_searches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The filters that each profile fills in, and how many documents they leave."""
    k, n = F.col("c_custkey"), F.lit(None).cast("string")
    events = F.when(k % 4 > 0, F.array(F.concat(F.lit("e"), (k % 3).cast("string")), F.lit("other")))
    people = table(spark, sf_dir, "customer").select(k.alias("id"), F.when(k % 2 == 0, "NSW").when(k % 3 == 0, "National").alias("residency_state"), events.alias("current_life_events"))
    asked = people.select("id", Q.filters_of(F.col("residency_state"), F.col("current_life_events"), n, n).alias("f")).select("id", "f.state", "f.life_event")
    docs = table(spark, sf_dir, "documents").select(F.when(F.col("doc_id") % 2 == 0, "NSW").otherwise("VIC").alias("state"), F.concat(F.lit("e"), (F.col("doc_id") % 3).cast("string")).alias("life_event"))
    counts = docs.cube("state", "life_event").agg(F.count("*").alias("hits"))
    found = asked.alias("a").join(counts.alias("c"), F.col("a.state").eqNullSafe(F.col("c.state")) & F.col("a.life_event").eqNullSafe(F.col("c.life_event")), "left")
    return found.select("id", "a.state", F.col("a.life_event").alias("event"), F.coalesce("hits", F.lit(0).cast("long")).alias("hits"))


_COPIES = """
d AS (SELECT doc_id AS id, CASE WHEN doc_id % 2 = 0 THEN 'A' ELSE 'B' END AS site, 'https://' || coalesce(source, 'none') || '/' AS page, md5(text) AS h FROM documents),
n AS (SELECT site, page, count(*) AS n FROM d GROUP BY ALL), g AS (SELECT a.page AS a, b.page AS b, count(*) AS m, count(DISTINCT a.id) AS am, count(DISTINCT b.id) AS bm FROM d a JOIN d b USING (h) WHERE a.site = 'A' AND b.site = 'B' GROUP BY ALL),
o AS (SELECT a AS a_page, b AS b_page, m, am, bm, x.n AS an, y.n AS bn, round((am / x.n::DOUBLE + bm / y.n::DOUBLE) / 2, 3) AS coverage FROM g JOIN n x ON x.site = 'A' AND x.page = a JOIN n y ON y.site = 'B' AND y.page = b)
"""


@query(f"WITH {_COPIES} SELECT a_page, b_page, m AS match_count, coverage, round(least(1.0, 0.6 * coverage + 0.4), 6)::DOUBLE AS link FROM o")
def overlap_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The links between pages that hold the same texts, by coverage and score."""
    docs = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"), F.when(F.col("doc_id") % 2 == 0, "A").otherwise("B").alias("site"), F.concat(F.lit("https://"), F.coalesce("source", F.lit("none")), F.lit("/")).alias("url"), F.md5("text").alias("h")
    )
    side = lambda s: docs.where(F.col("site") == s).select("h", F.col("id").alias(f"{s.lower()}_id"), F.col("url").alias(f"{s.lower()}_url"))
    pairs = side("A").join(side("B"), "h").withColumn("score", F.lit(1.0))
    return J.page_overlap(pairs, docs, 1_000_000).select("a_page", "b_page", "match_count", "coverage", F.round(J.overlap_link(F.col("coverage"), F.col("avg_score")), 6).alias("link"))


@query("SELECT DISTINCT a.vec_id::VARCHAR AS source, b.vec_id::VARCHAR AS target FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id * 2 OR b.vec_id = a.vec_id + 1 WHERE a.label IN (1, 2, 3) AND b.label IN (1, 2, 3)")
def links_between_shown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links whose two pages are shown."""
    k = F.col("vec_id")
    pages = table(spark, sf_dir, "embeddings").select(k.cast("string").alias("url"), F.array((k * 2).cast("string"), (k + 1).cast("string")).alias("out_links"), "label")
    return G.edges_between(G.link_edges(pages), pages.where(F.col("label").isin(1, 2, 3)))
