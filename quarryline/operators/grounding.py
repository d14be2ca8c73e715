"""Claim grounding, entity verification, content ranking and answer scoring."""

from __future__ import annotations

import math
from collections.abc import Mapping
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarryline.functions import text as T
from quarryline.operators import search as S
from quarryline.operators.tagging import has_any

# What a title's words add to its impact.
IMPACT = (
    (("apply", "application"), 15), (("payment", "benefit"), 15), (("deadline", "due", "expires"), 20), (("emergency", "urgent"), 25), (("eligibility", "qualify"), 10),
    (("how to", "guide"), 8), (("support", "help"), 10), (("about", "information", "overview"), 5),
)


def claim_terms(claim: Column) -> Column:
    """Lower-case words of more than three characters, repeated ones repeated."""
    return F.filter(F.split(F.lower(claim), r"\s+"), lambda t: F.length(t) > 3)


#: Documents of a part at most, about: a task counts the claims that share a token with each of them.
PART = 2048


def best_hits(claims: DataFrame, docs: DataFrame, most: int = 10) -> DataFrame:
    """The documents (id, content_text) that share the most tokens with each claim (claim_id, claim), with that number as n; ties to the smaller id.

    Almost every document shares a token with many claims, so the documents are dealt by id to as many parts as their number asks for: what a
    task counts and sorts doesn't grow with the table, and only the best of each part are shuffled.
    That holds while Spark broadcasts the claims' tokens by their size. Larger ones meet by token, and the counts are then shuffled.
    """
    parts = max(docs.sparkSession.sparkContext.defaultParallelism, math.ceil(docs.count() / PART))
    dealt = docs.repartition(parts, "id")
    asked = claims.select("claim_id", F.explode(T.token_set(F.col("claim"))).alias("token"))
    counts = dealt.select("id", F.explode(T.token_set(F.col("content_text"))).alias("token")).join(asked, "token").groupBy("claim_id", "id").agg(F.count("*").alias("n"))
    return S.top_per_group(counts, ["claim_id"], [F.desc("n"), F.asc("id")], most).join(dealt, "id")


def overlap(claims: DataFrame, hits: DataFrame) -> DataFrame:
    """Evidence rows: claims (claim_id, claim) beside hits (claim_id, id, title, content_text, ...), with relevance and excerpt; overlaps of 0.3 or less are out."""
    rows = hits.join(claims.select("claim_id", claim_terms(F.col("claim")).alias("terms")), "claim_id").where(F.size("terms") > 0)
    content = F.lower(F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("content_text", F.lit(""))))
    # Within an array of one, the lower-case text is computed once and not for each term.
    found = F.flatten(F.transform(F.array(content), lambda c: F.filter("terms", lambda t: F.contains(c, t))))
    rows = rows.withColumn("highlights", found).withColumn("relevance", F.size("highlights") / F.size("terms")).where(F.col("relevance") > 0.3)
    sentences = F.filter(F.split("content_text", "[.!?]+"), lambda s: F.exists(F.array(F.lower(s)), lambda low: F.exists("terms", lambda t: F.contains(low, t))))
    excerpt = F.substring(F.trim(F.array_join(F.slice(sentences, 1, 2), ". ")), 1, 300)
    return rows.withColumn("excerpt", F.when(excerpt == "", F.substring("content_text", 1, 300)).otherwise(excerpt)).drop("terms")


def verdicts(claims: DataFrame, evidence: DataFrame, max_evidence: int = 5) -> DataFrame:
    """claim_id, verdict, confidence and the number of evidence rows, for every claim."""
    best = S.top_per_group(evidence, ["claim_id"], [F.desc("relevance"), F.asc("id")], max_evidence)
    found = best.groupBy("claim_id").agg(F.count("*").alias("n"), F.max("relevance").alias("top"))
    rows = claims.select("claim_id").join(found, "claim_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    supported = (F.col("n") >= 2) & (F.col("top") > 0.5)
    verdict = F.when(F.col("n") == 0, "not_found").when(supported, "supported").otherwise("ambiguous")
    confidence = F.when(F.col("n") == 0, 0.0).when(supported, F.least(F.lit(0.95), F.col("top") + 0.1 * F.col("n"))).when(F.col("n") == 1, F.col("top")).otherwise(0.5)
    return rows.select("claim_id", verdict.alias("verdict"), F.round(confidence, 2).alias("confidence"), F.col("n").cast("long").alias("evidence"))


def ground_claim(fragments: DataFrame, claim: str, focus: str | None = None, facets: Mapping[str, Any] | None = None, max_evidence: int = 5) -> tuple[DataFrame, DataFrame]:
    """The verdict on a claim, and its evidence, among the best hits of a search."""
    if not claim:
        raise ValueError("a claim is required")
    spark = fragments.sparkSession
    claims = spark.createDataFrame([(0, claim)], "claim_id int, claim string")
    scoped = fragments.where(S.facet_filter(facets or {}))
    if focus:
        hits = scoped.join(S.matches(scoped, "id", focus, ("title", "content_text")), "id").orderBy(F.desc("text_match"), "id")
    else:  # any term of the claim makes a hit, the more the better
        terms = claim_terms(F.lit(claim))
        shown = scoped.withColumn("text_match", F.size(F.filter(terms, lambda t: F.contains(F.lower(F.concat_ws(" ", F.col("title"), F.col("content_text"))), t))).cast("double"))
        hits = shown.where("text_match > 0").orderBy(F.desc("text_match"), "id")
    hits = hits.limit(max(2 * max_evidence, 10)).withColumn("claim_id", F.lit(0))
    evidence = overlap(claims, hits)
    return verdicts(claims, evidence, max_evidence), S.top_per_group(evidence, ["claim_id"], [F.desc("relevance"), F.asc("id")], max_evidence)


def verify_entity(fragments: DataFrame, name: str, most: int = 10) -> DataFrame:
    """Up to ten hits of an entity's name with match_type: exact if the title has the name, else partial; none if it does not exist."""
    request = S.Request(query=name, per_page=most, typos=1)
    hits = fragments.join(S.matches(fragments, "id", name, ("title", "content_text"), typos=1, prefix=False), "id")
    kind = F.when(F.contains(F.lower("title"), F.lit(name.lower())), "exact").otherwise("partial")
    return S.page_of(hits, [F.desc("text_match"), F.asc("id")], request.page, request.per_page).withColumn("match_type", kind)


def suggested_facets(hits: DataFrame) -> DataFrame:
    """The facets of the best hit."""
    return hits.orderBy(F.desc("text_match"), "id").limit(1).select(
        F.get("life_events", F.lit(0)).alias("life_event"), F.get("categories", F.lit(0)).alias("category"), "provider", F.get("states", F.lit(0)).alias("state")
    )


def ranked_content(df: DataFrame, category: str | None, life_event: str | None, provider: str | None) -> DataFrame:
    """Content by how specific it is to a user, twice, and by its title's impact. Two missing values count as equal."""
    same = lambda c, v, n: F.when(F.col(c).eqNullSafe(F.lit(v)), n).otherwise(0)
    specific = same("category", category, 30) + same("life_event", life_event, 25) + same("provider", provider, 20)
    title = F.lower("title")
    impact = sum((F.when(has_any(title, ws), n).otherwise(0) for ws, n in IMPACT), F.lit(0))
    rows = df.withColumns({"specificity_score": specific, "life_impact_score": impact})
    return rows.withColumn("score", 2 * F.col("specificity_score") + F.col("life_impact_score")).orderBy(F.desc("score"), "id")


def rag_context(hits: DataFrame, most: int = 5) -> DataFrame:
    """The text of the best hits (group, rank, title, content_text, url) of each group, numbered, in one string."""
    top = hits.where(F.col("rank") <= most)
    piece = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "), F.col("title"), F.lit("\n"), F.col("content_text"), F.lit("\nSource: "), F.col("url"))
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("rank", piece.alias("p")))), lambda x: x["p"])
    return top.groupBy("group").agg(F.array_join(ordered, "\n\n").alias("context"))


def conversation_context(turns: DataFrame) -> DataFrame:
    """Each conversation as one text, turns in order; at most as long as a conversation is."""
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("turn", F.concat_ws(": ", "role", "text").alias("p")))), lambda x: x["p"])
    return turns.groupBy("conv_id").agg(F.array_join(ordered, "\n").alias("context"), F.count("*").alias("turns"))


def answer_scores(df: DataFrame) -> DataFrame:
    """correct, complete, partial and entity columns for answers (output, ideal array, ideal_entities array, eval_type)."""
    low = F.lower("output")
    has = lambda x: F.contains(low, F.lower(x))
    some, every = F.exists("ideal", has), F.forall("ideal", has)
    missing = F.filter("ideal", lambda x: ~has(x))
    entities = F.forall(F.coalesce("ideal_entities", F.array().cast("array<string>")), has)
    correct = F.when(F.col("eval_type") == "completeness", every).when(F.col("eval_type") == "entity_verification", some & entities).otherwise(some)
    return df.withColumns({"correct": correct, "partial": some & ~correct, "missing": missing})


def evaluation_metrics(df: DataFrame) -> DataFrame:
    """Per mode: accuracy and partial rate in per cent, mean iterations, and the share that converged."""
    share = lambda c: F.round(100 * F.avg(c.cast("int")), 2)
    return df.groupBy("mode").agg(
        F.count("*").alias("n"), share(F.col("correct")).alias("accuracy"), share(F.col("partial")).alias("partial_rate"), F.avg("iterations").alias("avg_iterations"),
        share(F.col("status") == "ACCEPT").alias("convergence"),
    )


def ranked(df: DataFrame, group: str, *order: Column) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(*order)))


def crawl_report(log: DataFrame) -> DataFrame:
    """Totals and means of a crawl, in one row; log has a row for each page: success, duration, fragments and extraction (seconds)."""
    fragments = F.sum("fragments")
    return log.agg(
        F.count("*").alias("urls_crawled"), fragments.alias("fragments_extracted"), F.count_if(~F.col("success")).alias("errors"), F.round(100 * F.avg((~F.col("success")).cast("int")), 2).alias("error_rate"),
        F.avg("duration").alias("avg_page_load_time"), F.try_divide(F.sum("extraction"), fragments).alias("avg_extraction_time"),
    )


ACCEPT, EXCEEDED = "ACCEPT", "MAX_ITERATIONS_EXCEEDED"


def review_loops(attempts: DataFrame, most: int = 3) -> DataFrame:
    """The outcome of each sample's attempts (sample, number, output, verdict, error): iterations, converged, final_verdict, output and rejections.

    A loop takes attempts in order of number, stops at the first that is accepted or that failed, and after
    ``most``; without acceptance it ends as exceeded. What comes after the end is not looked at. The output is that of the last
    attempt that did not fail. Only the first attempts of a sample are gathered.
    """
    first = S.top_per_group(attempts, ["sample"], [F.asc("number")], most)
    tried = first.groupBy("sample").agg(F.sort_array(F.collect_list(F.struct("number", "output", "verdict", "error"))).alias("tried"))
    start = F.struct(F.lit(0).alias("iterations"), F.lit(False).alias("over"), F.lit(False).alias("converged"), F.lit(None).cast("string").alias("output"), F.lit(0).alias("rejections"))

    def step(s: Column, x: Column) -> Column:
        failed, accepted = x["error"].isNotNull(), x["error"].isNull() & x["verdict"].eqNullSafe(ACCEPT)
        after = F.struct(
            (s["iterations"] + 1).alias("iterations"), (failed | accepted).alias("over"), accepted.alias("converged"), F.when(failed, s["output"]).otherwise(x["output"]).alias("output"),
            (s["rejections"] + F.when(failed | accepted, 0).otherwise(1)).alias("rejections"),
        )
        return F.when(s["over"], s).otherwise(after)

    ended = tried.select("sample", F.aggregate("tried", start, step).alias("s"))
    return ended.select("sample", "s.iterations", "s.converged", F.when(F.col("s.converged"), ACCEPT).otherwise(EXCEEDED).alias("final_verdict"), "s.output", "s.rejections")
