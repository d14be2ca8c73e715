"""Whole answers against the operators that give their parts, and against brute force."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quarryline.operators import answers as W
from quarryline.operators import search as S

DDL = "id string, url string, page_url string, title string, content_text string, life_events array<string>, categories array<string>, states array<string>, provider string, popularity_sort int, hierarchy_lvl0 string, hierarchy_lvl1 string, field string, rank int"
WORDS = ["apply", "applied", "payment", "carer", "housing", "pay", "medicare"]


def rows_of(n, seed=1):
    rng = random.Random(seed)
    some = lambda names: rng.choice([None, [], *[[x] for x in names], names[:2], [names[0], names[0]], [None, names[1]]])
    text = lambda k: rng.choice([None, " ".join(rng.choice(WORDS) for _ in range(k))])
    return [(f"{i:03d}", f"u{i}", rng.choice([None, "p1", "p2", "p3", "p3", "p3"]), text(3), text(6), some(["e1", "e2"]), some(["c1", "c2"]), some(["s1", "s2"]), rng.choice([None, "x", "y"]), rng.choice([1, 2, 2, 3]), "h", rng.choice([None, "", "k"]), "clash", 1) for i in range(n)]


def frame(spark, rows):
    return spark.createDataFrame(rows, DDL).repartition(5)


@pytest.mark.parametrize("query,page,facets", [("apply pay", 1, {}), ("*", 2, {"state": "s1"}), ("appliex", 1, {"provider": "x"}), ("medicare", 40, {}), ("nothing", 1, {})])
def test_one_answer_has_what_its_parts_have(spark, query, page, facets):
    df = frame(spark, rows_of(150)).cache()
    got = W.search_answer(df, S.Request(query, page, 7), facets=facets, order="popularity_sort:desc").collect()
    assert len(got) == 1
    scoped = df.where(S.facet_filter(facets))
    hits = scoped.join(S.matches(scoped, "id", query, ("title", "content_text")), "id").cache()
    want = S.page_of(hits, [F.desc("text_match"), F.desc("popularity_sort"), F.asc("id")], page, 7).collect()
    assert [(r.id, round(r.text_match, 9)) for r in got[0].results] == [(r.id, round(r.text_match, 9)) for r in want]
    n = hits.count()
    assert (got[0].found, got[0].page, got[0].total_pages) == (n, page, -(-n // 7))
    counts = {(r.field, r.value): r["count"] for r in got[0].facet_counts}
    assert counts == {(r.field, r.value): r["count"] for r in S.facet_counts(hits, W.FACETS, 10).collect()}


def test_one_scan(spark, tmp_path):
    frame(spark, rows_of(20)).write.parquet(str(tmp_path / "t"))
    plan = W.search_answer(spark.read.parquet(str(tmp_path / "t")), S.Request("apply"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "Python" not in plan


def test_facets_are_required_where_there_is_no_text(spark):
    with pytest.raises(ValueError):
        W.content_by_facets(frame(spark, rows_of(3)), {"category": None})
    assert W.content_by_facets(frame(spark, []), {"category": "c1"}).collect()[0].found == 0


def test_contexts_equal_brute_force(spark):
    rows = rows_of(80, 5)
    order = sorted(rows, key=lambda r: (r[9], r[0]))
    got = {r.id: r for r in W.fragment_contexts(frame(spark, rows), siblings=6, related=2, hits=4).collect()}
    assert len(got) == len(rows)
    for r in rows:
        near = [x[0] for x in order if r[2] is not None and x[2] == r[2]][:6]
        assert [s.id for s in got[r[0]].siblings] == [x for x in near if x != r[0]]
        event = r[5][0] if r[5] else None
        others = [x for x in order if event is not None and x[2] is not None and x[2] != r[2] and event in (x[5] or [])][:4]
        pages = list(dict.fromkeys(x[2] for x in others))[:2]
        assert [p.url for p in got[r[0]].related_pages] == pages
        for p in got[r[0]].related_pages:
            x = next(y for y in others if y[2] == p.url)
            assert p.title == x[3] and p.similarity_score == 0.5 and set(p.shared_facets.categories) - {None} == set(x[6] or []) & set(r[6] or []) - {None}
        assert list(got[r[0]].hierarchy) == [v for v in (r[10], r[11]) if v]


def test_pages_of_an_event_by_key(spark):
    rows = frame(spark, [r for r in rows_of(60, 7)]).cache()
    pages = rows.where("page_url is not null").groupBy(F.col("page_url").alias("url")).agg(F.array_distinct(F.flatten(F.collect_list("life_events"))).alias("life_events"))
    graph = spark.createDataFrame([("1", "e1", ["2"], [], []), ("2", "e2", [], ["1"], [])], "id string, event_name string, prerequisites array<string>, next_states array<string>, frequent_concurrents array<string>")
    seen, after = [], None
    while True:
        got = W.life_event_fragments(rows, pages, graph, "e1", 9, after).collect()[0]
        seen += [(f.popularity_sort, f.id) for f in got.fragments]
        assert {(x.event_name, x.weight) for x in got.relationships} == {("e1", 10), ("e2", 3)}
        if got.next_after is None:
            break
        after = tuple(got.next_after)
    kept = {r.url for r in pages.collect() if "e1" in r.life_events}
    assert seen == sorted((r.popularity_sort, r.id) for r in rows.collect() if r.page_url in kept) and got.found == len(seen) and got.page_found == len(kept)
    assert Counter(seen).most_common(1)[0][1] == 1
