"""Hand-written rows for each operator."""

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from quarryline.operators import graph, grounding, html, pages, profile, quality, search, services, similarity, tagging

HTML = """<html><head><title>Site</title></head><body><nav class="breadcrumb"><ul><li>Home</li><li>&gt;</li><li>Pay</li></ul></nav><main>
<h1 id="top">Age Pension</h1><p class="lead big">Who can get it. You may be eligible.</p>
<h2>Eligibility</h2><div class="content">You must be aged 67 or over.</div><table><tr><td>x</td></tr></table>
<h3>Income</h3><ol><li>Step 1: apply</li></ol><h4>Empty</h4>
<h2>Forms</h2><form>Name</form><div class="alert">Closing soon</div></main></body></html>"""


@pytest.fixture(scope="module")
def fragments(spark):
    df = spark.createDataFrame([("https://H.org/pay/age?x=1", HTML), ("https://h.org/none", None), (None, "<p>x")], "url string, html string")
    return html.fragments(df, 7, 1000).cache()


def test_fragments(fragments):
    rows = {r["title"]: r for r in fragments.collect()}
    assert set(rows) == {"Age Pension", "Eligibility", "Income", "Forms", "Important Information"}
    top, income, forms, alone = rows["Age Pension"], rows["Income"], rows["Forms"], rows["Important Information"]
    assert top["url"] == "https://H.org/pay/age?x=1#top" and top["page_url"] == "https://h.org/pay/age" and top["classes"] == ["lead", "big"]
    assert (income["hierarchy_lvl0"], income["hierarchy_lvl1"], income["hierarchy_lvl2"], income["hierarchy_lvl3"]) == ("Pay", "Eligibility", "Income", None)
    assert income["component_type"] == "content" and income["has_checklist"] and rows["Eligibility"]["component_type"] == "table" and forms["component_type"] == "form"
    assert top["page_hierarchy"] == ["Home", "Pay", "Age Pension"] and top["site_hierarchy"] == ["h.org", "pay", "age"]
    assert alone["component_type"] == "alert" and alone["page_url"] is None and alone["hierarchy_lvl0"] == "Pay" and alone["content_text"] == "Closing soon"
    assert all(r["popularity_sort"] == 100 - (r["popularity_score"] or 0) for r in rows.values()) and len({r["id"] for r in rows.values()}) == 5


def test_wrapped_headings_sections_and_breadcrumbs():
    page = """<body><ol class="my-breadcrumb-x"><li>A</li><li>/</li><li>B</li></ol><a class="breadcrumb">no item</a><article>
    <h1>Top</h1><div><h2>Wrapped</h2><span>In a span</span></div><section><h3>Deep</h3><div>beside</div></section><h4>Last</h4><p>end</p>
    <div class="info-panel" aria-label="Know"><ol class="steps"><li>1</li></ol></div><div class="alert" role="alert"><h3>Danger</h3>now</div><iframe src="https://x.org/v"></iframe></article><div class="alert">outside</div></body>"""
    rows = {r["title"]: r for r in (dict(zip([c.split()[0] for c in html.SCHEMA.split(", ")], r)) for r in html.page_rows("u/", page))}
    assert set(rows) == {"Top", "Wrapped", "Deep", "Last", "Know", "Danger"}
    assert rows["Top"]["content_text"] == "end" and rows["Wrapped"]["content_text"] == "In a span" and rows["Deep"]["content_text"] == "beside" and rows["Last"]["content_text"] == "end"
    assert rows["Know"]["is_checklist"] and rows["Know"]["is_info"] and rows["Danger"]["is_alert"] and rows["Danger"]["page_hierarchy"] == ["A", "B"]
    assert rows["Deep"]["hierarchy_lvl1"] == "Section" and rows["Last"]["hierarchy_lvl2"] == "Subsection" and rows["Last"]["hierarchy_lvl3"] == "Last" and not rows["Top"]["has_video"]
    node = next(n for n in html.parse('<div id="1a"><p class="b:c d"><b>x</b></p></div>').walk() if n.tag == "b")
    assert html.selector_path(node) == "div#\\31 a > p.b\\:c > b"


def test_page_roll_up(spark, fragments):
    tagged = fragments.withColumn("categories", F.array(F.lit("Pay"))).withColumn("content_html", F.lit('<a href="/x/y"><a href="https://o.net/z"><a href="/x/y">'))
    row = pages.roll_up(tagged).collect()
    assert len(row) == 1
    page = row[0]
    assert page["fragment_count"] == 5 and page["title"] == "Pay" and page["categories"] == ["Pay"] and len(page["embedding"]) == 256
    assert page["out_links"] == ["https://h.org/x/y", "https://o.net/z"] and page["out_link_tokens"] == ["h.org", "h.org/x", "o.net", "o.net/z"]
    assert sum(x * x for x in page["embedding"]) == pytest.approx(1) and page["content_text"].startswith("Who can get it.")
    long_ = spark.createDataFrame([("p", i, str(i), "x" * 9000) for i in range(20)], "page_url string, pos int, id string, content_text string")
    assert len(pages.page_text(long_).first()["content_text"]) == 10 * 4001 - 1
    titles = spark.createDataFrame([("p", 0, None, "B"), ("p", 1, "A", "x"), ("p", 2, "", "B"), ("p", 3, "A", None)], "page_url string, pos int, hierarchy_lvl0 string, title string")
    assert pages.modal_title(titles).first()["title"] == "B"


TAXONOMY = {"Work": ["job", "wage", "job"], "Family": ["baby", "newborn"], "Home": ["rent", "lease"]}


def tag(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)).select(column.alias("v")).first()["v"]


def test_tagging(spark):
    c = F.col("c")
    assert tag(spark, tagging.categories(c, TAXONOMY), c="A JOB and rent") == ["Work"]
    assert tag(spark, tagging.life_events(c, TAXONOMY), c="newborn care, rent") == ["Family"]
    assert tag(spark, tagging.primary_life_event(c, F.array(F.lit("Work"), F.lit("Family")), TAXONOMY), c="job baby newborn") == "Family"
    assert tag(spark, tagging.primary_life_event(c, F.array(F.lit("Home")), TAXONOMY), c="rental") is None
    assert tag(spark, tagging.stage_variant(c, F.lit("Work"), {"Work": {"Late": ["old"]}}), c="new") == "No"
    assert tag(spark, tagging.stage(c, F.lit("Work"), {"Work": {"Late": ["old"]}}), c="new") is None
    for url, text, want in (
        ("https://www.ATO.gov.au/x", "", ("Federal Government", "Australian Taxation Office")),
        ("https://x.org", "about medicare", ("Federal Government", "Services Australia")),
        ("https://www.service.nsw.gov.au/", "", ("State Government", "NSW Government")),
        ("https://x.org", "none", ("Non-Government", "External Provider")),
    ):
        assert tuple(tag(spark, tagging.provider(F.col("u"), c), u=url, c=text)) == want
    for url, text, want in (("https://a.nsw.gov.au", "in Victoria", ["NSW", "VIC"]), ("https://my.gov.au", "in Victoria", ["National"]), ("https://x.org", "NSW residents", ["NSW"]), ("https://x.org", "-", ["National"])):
        assert tag(spark, tagging.states(F.col("u"), c), u=url, c=text) == want
    assert tag(spark, tagging.task_order(c), c="<li>Step 3</li>") == 3 and tag(spark, tagging.task_order(c), c="<li>a</li><li>b</li>") == 2 and tag(spark, tagging.task_order(c), c="x") is None
    for text, weight in (("Death of a spouse", 100), ("widower", 100), ("newborn", 40), ("moving house", 20), ("", 0), (None, 0), ("study", 26)):
        assert tag(spark, tagging.stress_weight(c), c=text) == weight
    none = F.lit(None).cast("string")
    assert tag(spark, tagging.stress_score(F.array(F.lit("Divorce")), none, none, F.lit("widow"), c), c="x") == 73
    assert tag(spark, tagging.stress_score(F.array().cast("array<string>"), none, none, F.lit("widow"), c), c="x") == 100


@pytest.fixture(scope="module")
def rows(spark):
    data = [
        ("a", "Age pension", "Pension for older people in Sydney.", ["Money"], ["Ageing"], "P1", ["NSW"], "h.org", "u1", 1),
        ("b", "Pensions guide", "How to apply for a pension. Medicare card needed.", ["Money", "Health"], ["Ageing"], "P1", ["National"], "h.org", "u1", 2),
        ("c", "Medicare card", "Enrol in medicare today.", ["Health"], [], "P2", ["VIC"], "h.org", "u2", 3),
        ("d", "Contact", "Call us.", [], ["Ageing"], None, [], "h.org", "u3", 4),
    ]
    return spark.createDataFrame(data, "id string, title string, content_text string, categories array<string>, life_events array<string>, provider string, states array<string>, hierarchy_lvl0 string, page_url string, popularity_sort int").withColumn("url", F.col("page_url"))


def ids(df):
    return [r["id"] for r in df.collect()]


def test_search(spark, rows):
    got = lambda q, **k: ids(search.search(rows, search.Request(q), ["title", "content_text"], **k))
    assert set(got("*")) == set("abcd")
    assert got("pension")[0] == "a" and set(got("pension")) == {"a", "b"}
    assert set(got("medicar")) == {"b", "c"} and set(got("mediacre")) == {"b", "c"} and got("zzzzz") == []
    assert set(got("*", facets={"category": "Health", "state": "National"})) == {"b", "c"}
    assert ids(search.search(rows, search.Request("*", page=2, per_page=3), ["title"])) == ["d"] and search.total_pages(4, 3) == 2
    for bad in ({"query": ""}, {"per_page": 0}, {"page": 0}, {"typos": 5}):
        with pytest.raises(ValueError):
            search.Request(**bad)
    with pytest.raises(ValueError):
        search.facet_filter({"category": ""}, required=True)
    facets = {(r["field"], r["value"]): r["count"] for r in search.facet_counts(rows, ["categories", "provider"]).collect()}
    assert facets == {("categories", "Money"): 2, ("categories", "Health"): 2, ("provider", "P1"): 2, ("provider", "P2"): 1}
    combos = search.filter_combinations(rows, {"category": "Money"}).collect()
    assert [(r["dimension"], r["value"], r["count"]) for r in combos] == [("life_event", "Ageing", 2)]
    assert ids(search.batch(rows, ["c", "zz", "a", "c"])) == ["c", "a", "c"] and ids(search.point(rows, "b")) == ["b"]
    assert ids(search.by_hierarchy(rows, 2).orderBy("id")) == ["a", "b"]
    assert ids(rows.orderBy(*search.sort_columns("popularity_sort:desc,id:asc"))) == list("dcba")
    view = {r["id"]: r for r in search.search_view(rows).collect()}
    assert view["d"]["category"] == "General" and view["d"]["state"] == "National" and view["d"]["provider"] == "Unknown"
    pages_ = spark.createDataFrame([("u1", ["X"]), ("u2", ["Y"])], "url string, life_events array<string>")
    assert set(ids(search.by_life_event(rows, pages_, "X"))) == {"a", "b"}
    assert {r["id"]: r["life_events"] for r in search.with_life_events(rows, pages_).collect()} == {"a": ["X"], "b": ["X"], "c": ["Y"], "d": []}
    assert ids(search.context_siblings(rows, "a")) == ["b"]
    related = search.related_pages(rows, "a").collect()
    assert [(r["page_url"], r["shared_facets"], r["score"]) for r in related] == [("u3", ["Ageing"], 0.5)]
    ranged = spark.createDataFrame([(1, 5), (None, 9)], "lo int, hi int")
    assert ranged.where(search.in_range("lo", "hi", 3)).count() == 1
    site = spark.createDataFrame([("x.a.org",), ("b.org",), ("c.net",)], "h string").select(search.site_of(F.col("h"), "a.org", "b.org").alias("s"))
    assert [r["s"] for r in site.collect()] == ["A", "B", None]


def test_grounding(spark, rows):
    verdict, evidence = grounding.ground_claim(rows, "apply for a pension with medicare card")
    got = verdict.first()
    assert got["verdict"] == "supported" and 0 < got["confidence"] <= 0.95 and evidence.first()["id"] == "b"
    assert grounding.ground_claim(rows, "unrelated nonsense xyzzy")[0].first()["verdict"] == "not_found"
    assert grounding.ground_claim(rows, "a an of")[0].first()["confidence"] == 0
    with pytest.raises(ValueError):
        grounding.ground_claim(rows, "")
    hits = {r["id"]: r["match_type"] for r in grounding.verify_entity(rows, "Medicare Card").collect()}
    assert hits == {"c": "exact", "b": "partial"} and grounding.verify_entity(rows, "Xyzzyqq").count() == 0
    ranked = grounding.ranked_content(spark.createDataFrame([("1", "Apply for payment", "Money", None, "P"), ("2", "About", "Money", None, "Q")], "id string, title string, category string, life_event string, provider string"), "Money", None, "P").collect()
    assert [(r["id"], r["score"]) for r in ranked] == [("1", 2 * 75 + 30), ("2", 2 * 55 + 5)]
    context = grounding.rag_context(spark.createDataFrame([("g", 2, "T2", "c2", "u2"), ("g", 1, "T1", "c1", "u1"), ("g", 6, "T6", "c6", "u6")], "group string, rank int, title string, content_text string, url string")).first()["context"]
    assert context == "[1] T1\nc1\nSource: u1\n\n[2] T2\nc2\nSource: u2"
    answers = spark.createDataFrame([("the Red cat", ["red", "dog"], None, "factual_accuracy"), ("red dog", ["red", "dog"], None, "completeness"), ("red", ["red", "dog"], None, "completeness"), ("red", ["red"], ["x"], "entity_verification")], "output string, ideal array<string>, ideal_entities array<string>, eval_type string")
    assert [(r["correct"], r["partial"], r["missing"]) for r in grounding.answer_scores(answers).collect()] == [(True, False, ["dog"]), (True, False, []), (False, True, ["dog"]), (False, True, [])]
    log = grounding.answer_scores(answers).withColumns({"mode": F.lit("m"), "iterations": F.lit(2), "status": F.lit("ACCEPT")})
    assert tuple(grounding.evaluation_metrics(log).first()) == ("m", 4, 50.0, 50.0, 2.0, 100.0)


def test_similarity(spark):
    data = [
        ("A", "1", "https://a.org/p?x", "Age pension rates", "older people receive pension rates every fortnight", ["E"], ["M"]),
        ("A", "2", "https://a.org/p", "Overview", "older people receive pension rates every fortnight", ["E"], ["M"]),
        ("B", "3", "https://b.org/q#z", "Age pension rates", "older people receive pension rates every month", ["E"], ["N"]),
        ("B", "4", "https://b.org/r", "Something else", "entirely different words", [], []),
        (None, "5", "https://c.org/", "Age pension rates", "older people", [], []),
    ]
    df = spark.createDataFrame(data, "site string, id string, url string, title string, content_text string, life_events array<string>, categories array<string>").withColumn("content_html", F.lit(None).cast("string"))
    pair = similarity.fragment_pairs(df).collect()
    assert [(r["a_id"], r["b_id"], r["title_sim"], r["content_sim"], r["link_sim"], r["score"], r["shared_events"], r["shared_categories"]) for r in pair] == [("1", "3", 1.0, 0.75, 1.0, 0.875, ["E"], [])]
    pairs = similarity.fragment_pairs(df, ignore_generic=False, threshold=0.1)
    overlap = similarity.page_overlap(pairs, df).collect()
    assert [(r["a_page"], r["b_page"], r["match_count"], r["coverage"]) for r in overlap][0] == ("https://a.org/p", "https://b.org/q", 2, 1.0)
    assert [(r["tag"], r["count"]) for r in similarity.shared_tag_counts(pairs, "shared_events").collect()] == [("E", 2)]
    assert tuple(similarity.site_counts(df, pairs).first()) == (2, 2, 2) and similarity.top_pairs(pairs, 1).count() == 1
    page = [("A", "u1", ["X"], ["m"], ["Tax"], ["h.org"], [1.0, 0.0]), ("B", "u2", ["x"], ["m"], ["tax"], ["h.org"], [1.0, 1.0])]
    pages_ = spark.createDataFrame(page, "site string, url string, life_events array<string>, categories array<string>, keywords array<string>, out_link_tokens array<string>, embedding array<double>")
    r = similarity.page_pairs(pages_, 0.1).first()
    assert (r["tag_sim"], r["emb_sim"], r["link_sim"], r["score"]) == (0.333, 0.707, 1.0, 0.579)


def test_classes_meet_once_in_blocks_and_no_pair_is_lost(spark, monkeypatch):
    """Sets of all sizes, some alike, some copies, some empty, against all pairs compared one by one; a pair leaves one block only."""
    monkeypatch.setattr(similarity, "SET_BLOCK", 9)
    monkeypatch.setattr(similarity, "STEP", 4)
    monkeypatch.setattr(similarity, "PAIRS", 7)
    rng, rows = random.Random(5), []
    for k in range(90):
        if k % 3 and rows:
            title, content = (list(x) for x in rows[rng.randrange(len(rows))][1:])
            title, content = ([w for w in x if rng.random() > 0.2] + [f"n{rng.randrange(9)}" for _ in range(rng.randrange(3))] for x in (title, content))
        else:
            title, content = ([f"w{min(rng.randrange(60), rng.randrange(60))}" for _ in range(rng.randrange(m))] for m in (7, 60))
        rows.append((k, title, content))
    df = spark.createDataFrame(
        [("AB"[rng.randrange(2)], str(k), f"https://h/{k}", " ".join(t), " ".join(c), None, [], []) for k, t, c in rows],
        "site string, id string, url string, title string, content_text string, content_html string, life_events array<string>, categories array<string>",
    ).cache()
    sims = lambda x, y: len(x & y) / len(x | y) if x | y else 1.0
    side = {r["id"]: r["site"] for r in df.select("id", "site").collect()}
    metrics = {"combined": lambda t, c: 0.4 * t + 0.5 * c + 0.1 * 1.0, "title": lambda t, c: t, "content": lambda t, c: c}
    for metric, threshold in (("combined", 0.55), ("title", 0.5), ("content", 0.6)):
        found = [(r["a_id"], r["b_id"]) for r in similarity.fragment_pairs(df, threshold, metric, ignore_generic=False).collect()]
        wanted = [(str(i), str(j)) for i, t, c in rows for j, u, d in rows if side[str(i)] == "A" and side[str(j)] == "B" and metrics[metric](sims(set(t), set(u)), sims(set(c), set(d))) >= threshold]
        assert wanted and sorted(found) == sorted(wanted)


def test_pairs_of_pages_are_counted_where_classes_meet(spark, monkeypatch):
    """The same rows as from all pairs, with copies on several pages, an id that stands twice, and tokens beyond the frequent ones."""
    for name, value in (("SET_BLOCK", 9), ("STEP", 4), ("PAIRS", 7), ("FREQUENT", 15)):
        monkeypatch.setattr(similarity, name, value)
    rng, rows = random.Random(8), []
    for k in range(80):
        words = [f"w{rng.randrange(40)}" for _ in range(rng.randrange(1, 25))] if k % 4 == 0 else [w for w in rows[-1][4].split() if rng.random() > 0.1]
        rows.append(("AB"[rng.randrange(2)], str(k if k % 9 else 0), f"https://h/{rng.randrange(4)}", " ".join(words[:5]), " ".join(words)))
    df = spark.createDataFrame(rows, "site string, id string, url string, title string, content_text string").cache()
    df = df.withColumns({"content_html": F.lit(None).cast("string"), "life_events": F.array().cast("array<string>"), "categories": F.array().cast("array<string>")})
    wanted = similarity.page_overlap(similarity.fragment_pairs(df, ignore_generic=False), df).collect()
    assert len(wanted) > 9 and sum(r["match_count"] for r in wanted) > 50
    found = similarity.fragment_page_overlap(df, ignore_generic=False)
    assert found.collect() == wanted


def test_claims_are_counted_in_parts_of_documents(spark, monkeypatch):
    """The hits are those of a plain count, and there are as many parts as the documents ask for."""
    monkeypatch.setattr(grounding, "PART", 3)
    rng = random.Random(4)
    text = lambda n: " ".join(f"w{rng.randrange(30)}" for _ in range(n))
    docs, claims = [(k, text(12)) for k in range(60)], [(k, text(6)) for k in range(7)]
    hits = grounding.best_hits(spark.createDataFrame(claims, "claim_id int, claim string"), spark.createDataFrame(docs, "id int, content_text string"), 4)
    shared = {c: sorted((-len(set(x.split()) & set(y.split())), k) for k, y in docs if set(x.split()) & set(y.split()))[:4] for c, x in claims}
    assert sorted((r["claim_id"], -r["n"], r["id"]) for r in hits.collect()) == sorted((c, n, k) for c, found in shared.items() for n, k in found)
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert "20), REPARTITION_BY_NUM" in plan


def test_coded_sets_keep_all_tokens():
    """Frequent tokens take 16 bits, others keep their hashes; what is shared stays so."""
    pa = similarity.pa
    known = similarity.np.sort(similarity.np.array([-(1 << 62), -5, 3, 9, 1 << 62]))
    sets = pa.array([[-(1 << 62), -7, 3, 11], [], [-8, 9, 1 << 62], [-7, 3, 4, 11]], pa.list_(pa.int64()))
    codes, others = similarity._coded(sets, known)
    assert codes.type == pa.list_(pa.int16()) and codes.to_pylist() == [[1, 3], [], [4, 5], [3]]
    rank = similarity.np.array([0, 5, 4, 3, 2, 1])
    both = similarity._Sets(codes, others, similarity.np.unique(others.flatten().to_numpy()), rank)
    assert both.n.tolist() == [4, 0, 3, 4]
    i, j = similarity.np.divmod(similarity.np.arange(16), 4)
    want = [len(set(x) & set(y)) for x in sets.to_pylist() for y in sets.to_pylist()]
    assert similarity._shared(both, both, i, j).tolist() == want


def test_similar_contents_without_a_title_token(spark):
    """Candidates by content do not depend on the order or number of tokens; whole texts can be compared."""
    words = [f"word{i:03d}" for i in range(200)]
    data = [
        ("A", "1", "Alpha report", " ".join(words)),
        ("B", "2", "Different heading", " ".join(reversed(words))),
        ("A", "3", "Gamma summary", "shared " * 600 + " ".join(w.replace("word", "left") for w in words)),
        ("B", "4", "Unlike naming", "shared " * 600 + " ".join(w.replace("word", "right") for w in words)),
        ("A", "5", "Short terms", "to be or not to be"),
        ("B", "6", "Brief lines", "be to not or be to"),
    ]
    df = spark.createDataFrame([(s, i, f"https://{i}.org/", t, c) for s, i, t, c in data], "site string, id string, url string, title string, content_text string")
    df = df.withColumns({"content_html": F.lit(None).cast("string"), "life_events": F.array().cast("array<string>"), "categories": F.array().cast("array<string>")})
    pairs = lambda **k: sorted((r["a_id"], r["b_id"]) for r in similarity.fragment_pairs(df, **k).collect())
    assert pairs(content_chars=None) == pairs(content_chars=None, metric="content", threshold=0.9) == [("1", "2"), ("5", "6")]
    assert {("1", "2"), ("5", "6")} <= set(pairs())


def _long_texts(spark):
    """Fragments 1 and 2 are alike in their first 4,000 characters only, 3 and 4 as a whole but not there."""
    ends, starts = [" ".join(f"{k}{i:03d}" for i in range(300)) for k in "ab"], ["shared " * 600, *(" ".join(f"{k}{i}" for i in range(70)) + " pad" * 1100 for k in "cd")]
    data = [("A", "1", "Alpha", starts[0] + ends[0]), ("B", "2", "Beta", starts[0] + ends[1]), ("A", "3", "Gamma", f"{starts[1]} {' '.join(ends)}"), ("B", "4", "Delta", f"{starts[2]} {' '.join(ends)}")]
    df = spark.createDataFrame([(s, i, f"https://{i}.org/", t, c) for s, i, t, c in data], "site string, id string, url string, title string, content_text string")
    return df.withColumns({"content_html": F.lit(None).cast("string"), "life_events": F.array().cast("array<string>"), "categories": F.array().cast("array<string>")})


def test_pairs_come_from_whole_texts(spark):
    found = similarity.fragment_pairs(_long_texts(spark)).collect() + similarity.fragment_pairs(_long_texts(spark), metric="content").collect()
    assert [(r["a_id"], r["b_id"], r["content_sim"]) for r in found if r["content_sim"] > 0.5] == [("3", "4", 0.811)]


def test_page_overlap_comes_from_whole_texts(spark):
    found = similarity.fragment_page_overlap(_long_texts(spark), metric="content").collect()
    assert [(r["a_page"], r["b_page"], r["max_score"]) for r in found] == [("https://3.org/", "https://4.org/", 0.811)]


def test_no_class_is_copied_and_no_pair_shuffled(spark, monkeypatch):
    """Blocks meet in a cartesian product without a shuffle after it; the rows of a class with many stand in several entries, repeated and null ids with them."""
    monkeypatch.setattr(similarity, "SET_BLOCK", 3)
    monkeypatch.setattr(similarity, "MEMBERS", 4)
    rng = random.Random(5)
    data = [("AB"[i % 2], None if i == 9 else i // 3, f"https://{i % 5}.org/", f"Report {i % 4}", " ".join(f"w{rng.randrange(12)}" for _ in range(9)) if i % 3 else "same words here") for i in range(60)]
    df = spark.createDataFrame(data, "site string, id int, url string, title string, content_text string")
    df = df.withColumns({"content_html": F.lit(None).cast("string"), "life_events": F.array().cast("array<string>"), "categories": F.array().cast("array<string>")})
    sets = [(s, i, set(t.lower().split()), set(c.split())) for s, i, _, t, c in data]
    alike = lambda x, y: len(x & y) / len(x | y)
    key = lambda x, y: (-1 if x is None else x, -1 if y is None else y)
    wanted = sorted(key(a[1], b[1]) for a in sets for b in sets if a[0] == "A" and b[0] == "B" and 0.4 * alike(a[2], b[2]) + 0.5 * alike(a[3], b[3]) + 0.1 >= 0.55)
    found = similarity.fragment_id_pairs(df)
    assert sorted(key(r["a_id"], r["b_id"]) for r in found.collect()) == wanted == sorted(key(r["a_id"], r["b_id"]) for r in similarity.fragment_pairs(df).collect())
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "Exchange" not in plan


@pytest.fixture(scope="module")
def life(spark):
    data = [("birth", "Birth", [], ["school"], [], [0, 1], "Family", 1.0), ("school", "School", ["birth", "gone"], ["work"], ["house"], [5, 18], "Education", 2.0), ("work", "Work", ["school", "birth"], ["house"], [], [16, 70], None, 3.0), ("house", "House", ["work"], ["gone"], ["work"], [20, 60], "Family", 4.0)]
    ddl = "id string, event_name string, prerequisites array<string>, next_states array<string>, frequent_concurrents array<string>, typical_age_range array<int>, cluster string, position_x double"
    df = spark.createDataFrame(data, ddl)
    return df.withColumns({"concurrent_disallowed": F.array().cast("array<string>"), "position_y": F.lit(0.0), "position_z": F.col("position_x"), "eligibility_status": F.lit("s"), "typical_duration_days": F.lit(5)})


def test_graph(spark, life):
    near = {r["event_name"]: r for r in graph.neighbourhood(life, spark.createDataFrame([("School",), ("Nope",)], "event_name string")).collect()}
    assert list(near) == ["School"] and near["School"]["prerequisites"] == ["Birth"] and near["School"]["next_states"] == ["Work"]
    chain = [(r["id"], r["depth"]) for r in graph.prerequisite_chain(life, "House").collect()]
    assert chain == [("work", 1), ("school", 2), ("birth", 3)]
    weights = {r["event_name"]: r["weight"] for r in graph.relation_weights(life, "School").collect()}
    assert weights == {"School": 10, "Birth": 3, "Work": 2, "House": 1}
    pages_ = spark.createDataFrame([("u1", ["School", "Birth"]), ("u2", ["Other"])], "url string, life_events array<string>")
    frags = spark.createDataFrame([("f1", "u1", 2), ("f2", "u2", 1)], "id string, page_url string, popularity_sort int")
    assert [(r["id"], r["relationship_score"]) for r in graph.related_fragments(frags, pages_, life, "School").collect()] == [("f1", 13)]
    assert {(r["source"], r["target"]) for r in graph.dangling(life, "prerequisites").collect()} == {("school", "gone")}
    assert {(r["source"], r["target"], r["kind"]) for r in graph.life_edges(life, spark.createDataFrame([("Birth", 1), ("School", 2)], "event_name string, n int")).collect()} == {("birth", "school", "next_states"), ("school", "birth", "prerequisites")}
    links = spark.createDataFrame([("a", "A", ["b", "a", "x", "b"]), ("b", "B", ["c"]), ("c", None, ["b"])], "url string, site string, out_links array<string>")
    edge = lambda mode: {tuple(r) for r in graph.link_edges(links, F.col("site"), mode).collect()}
    assert edge("all") == {("a", "b"), ("a", "a"), ("b", "c"), ("c", "b")} and edge("both") == {("a", "b")} and edge("a") == {("a", "b")} and edge("b") == {("a", "b"), ("b", "c"), ("c", "b")}
    nodes = graph.edge_nodes(links, graph.link_edges(links, F.col("site"), "both"))
    assert {r["url"] for r in nodes.collect()} == {"a", "b"} and graph.edges_between(graph.link_edges(links), nodes).count() == 2
    assert {r["cluster"]: (r["x"], r["n"]) for r in graph.clusters(life).collect()} == {"Family": (2.5, 2), "Education": (2.0, 1), "Other": (3.0, 1)}
    assert tuple(graph.focus_point(life, []).first()) == (0.0, 10.0, 0.0) and tuple(graph.focus_point(life, ["Birth", "House"]).first()) == (2.5, 10.0, 2.5)
    assert {r["event_name"]: r["names"] for r in graph.event_card(life, "prerequisites").collect()}["School"] == ["Birth", "gone"]
    spans = graph.intervals(spark.createDataFrame([("l", "x", 10, 12), ("l", "y", -5, 200)], "lane string, id string, s int, e int"), "lane", "s", "e").collect()
    assert {r["id"]: (r["x0"], r["x1"], r["row"]) for r in spans} == {"x": (10.0, 16.0, 1), "y": (0.0, 100.0, 0)}
    facts = pages.graph_facts(pages_, life).orderBy("url").collect()
    assert facts[0]["typical_age_range"] == [0, 18] and facts[0]["eligibility_statuses"] == ["s"] and facts[1]["typical_age_range"] is None and facts[1]["eligibility_statuses"] == []


def test_profiles(spark, life):
    docs = spark.createDataFrame([("d1", 60, 99, 0, 5000, ["c"], ["E", "G"], ["D"], 80), ("d2", 1, 99, 1, 5000, [], [], [], 0), ("d3", None, 99, 1, 5000, [], ["E"], [], 50)], "id string, min_age int, max_age int, min_income int, max_income int, required_citizenship array<string>, life_events array<string>, prerequisite_states array<string>, urgency_score int")
    people = spark.createDataFrame([("p", 66, 1000, None, ["c"], "NSW", ["x"], "student", None, True, [(6, False)], ["E"], ["D"])], profile.PROFILE_DDL)
    got = {r["id"]: r for r in profile.eligible_services(docs, people).collect()}
    assert set(got) == {"d1", "d2"}
    assert got["d1"]["eligibility_score"] == pytest.approx(2.5 / 3) and got["d1"]["relevance_score"] == pytest.approx(2.5 / 6 + 0.16 + 0.225) and got["d2"]["relevance_score"] == pytest.approx(0.6)
    poor = docs.select(*docs.columns, *(F.lit(v).alias(f"p_{k}") for k, v in (("age", 20), ("income", 9000))), F.array(F.lit("z")).alias("p_citizenship"))
    assert {r["id"]: r["v"] for r in poor.select("id", profile.reasons().alias("v")).collect()}["d1"] == ["Must be at least 60 years old", "Income must be below $5,000", "Requires c citizenship"]
    built = profile.built(people).first()
    missing = profile.built(people.withColumns({"citizenship": F.lit(None).cast("array<string>"), "residency_state": F.lit(None).cast("string")})).first()
    assert (missing["citizenship"], missing["residency_state"]) == (["Australian"], "National")
    assert built["current_life_events"] == ["E", "Raising Kids", "Ageing", "Education", "Caring for someone", "Health and Disability"]
    assert people.select(profile.completeness(people).alias("v")).first()["v"] == pytest.approx(6 / 7)
    stages = spark.range(1).select(*(profile.life_stage(F.lit(a)).alias(str(a)) for a in (17, 18, 30, 50, 65))).first()
    assert list(stages) == ["Youth", "Young Adult", "Adult", "Mature Adult", "Senior"]
    young = people.withColumns({"age": F.lit(17), "completed_life_events": F.array(F.lit("birth")), "current_life_events": F.array(F.lit("gone"))})
    assert {r["id"]: round(r["likelihood"], 3) for r in profile.next_events(life, young).collect()} == {"school": 0.8}
    assert {r["id"]: (r["x"], r["z"]) for r in profile.positions(life).collect()}["birth"] == (-59.0, -30.0)
    assert profile.profile_facets({"residency_state": "NSW", "current_life_events": ["E"]}, {"state": "VIC"}) == {"state": "VIC", "life_event": "E"}


def test_all_services_that_fit_are_scored(spark):
    """A profile that fits more than 250 documents has all of them, and its most relevant may have any id."""
    docs = spark.range(600).select(
        "id", F.lit(1).alias("min_age"), F.lit(99).alias("max_age"), F.lit(0).alias("min_income"), F.lit(5000).alias("max_income"), F.array().cast("array<string>").alias("required_citizenship"),
        F.array(F.lit("E")).alias("life_events"), F.array().cast("array<string>").alias("prerequisite_states"), F.when(F.col("id") == 599, 90).otherwise(10).alias("urgency_score"),
    )
    people = spark.createDataFrame([(p, 30, 1000, None, [], "NSW", [], "student", None, True, [], ["E"], []) for p in "pq"], profile.PROFILE_DDL)
    got = profile.eligible_services(docs, people).select("p_id", "id", "rank").collect()
    assert sorted((r["p_id"], r["id"]) for r in got) == [(p, k) for p in "pq" for k in range(600)]
    assert [r["id"] for r in got if r["rank"] == 1] == [599, 599]


def test_services(spark):
    c = F.col("c")
    for url, key in (("/services/payments/Age-Pension/x", "payments-age-pension"), ("/benefits/carer", "carer"), ("/x", None)):
        assert tag(spark, services.service_key(c), c=url) == key
    assert tag(spark, services.service_name(F.lit("Age Pension"), c), c="who can get it") == "Age Pension"
    assert tag(spark, services.service_code(c), c="Age Pension for Widows") == "AGE_P_FOR_WID" and tag(spark, services.service_id(c), c="Age  Pension!").startswith("svc_age-pension-_")
    assert tag(spark, services.fragment_role(c, F.lit("u")), c="How to claim it") == "how_to_apply" and tag(spark, services.fragment_role(c, F.lit("/who-can-get")), c="x") == "eligibility"
    assert tag(spark, services.fragment_role(c, F.lit("u")), c="Medical evidence") == "required_documents" and tag(spark, services.fragment_role(c, F.lit("u")), c="Report income") == "manage_service"
    assert tag(spark, services.payment_amounts(c), c="$1,000.50 per week or $20 then $30 per week") == {"week": "30", "fortnight": "20"} and tag(spark, services.payment_amounts(c), c="none") is None
    assert tag(spark, services.income_limit(c), c="income under $1,200. income over $9") == 1200 and tag(spark, services.ages(c), c="aged 67 or over, age 20") == [67, 20]
    rows = spark.createDataFrame(
        [("f1", "https://h/benefits/age/eligibility", "Eligibility", "You may be eligible if aged 67. income less than $500. A permanent resident.", "Centrelink", ["retiring_from_workforce"], ["M"], ["k"], 5, 1),
         ("f2", "https://h/benefits/age", "Age Pension overview", "A fortnightly payment of $20, also known as the old pension. Claim online.", "Centrelink", [], ["M", "N"], ["j"], 9, 0)],
        "id string, url string, title string, content_text string, provider string, life_events array<string>, categories array<string>, search_keywords array<string>, popularity_score int, pos int",
    )
    row = services.roll_up(rows).collect()
    assert len(row) == 1
    s = row[0]
    assert (s["department"], s["min_age"], s["max_income"], s["service_type"], s["payment_frequency"], s["popularity_score"]) == ("Services Australia", 67, 500, "payment", "fortnightly", 9)
    assert s["eligibility_statuses"] == ["senior"] and s["residency_requirements"] == ["permanent resident"] and s["categories"] == ["M", "N"] and s["primary_url"] == "https://h/benefits/age" and "the old pension" in s["common_names"]


def test_quality(spark):
    verbs = spark.createDataFrame([("run", ["dash", "go"]), ("go", ["move", "dash"])], "id string, synonyms array<string>")
    each = verbs.select("id", F.explode("synonyms").alias("s"))
    assert [(r["s"], r["owners"]) for r in quality.duplicates(each, "s", "id").collect()] == [("dash", ["go", "run"])]
    assert [r["synonym"] for r in quality.synonym_is_verb(verbs).collect()] == ["go"]
    refs = spark.createDataFrame([("a", "go"), ("b", "nope"), ("c", None)], "id string, lex_ref string")
    assert [r["id"] for r in quality.missing_references(refs, "lex_ref", verbs, "id").collect()] == ["b"]
    diff = quality.schema_diff(spark.createDataFrame([("id", "string"), ("x", "int")], "name string, type string"), quality.schema_frame(refs)).collect()
    assert {(r["name"], r["status"]) for r in diff} == {("x", "missing"), ("lex_ref", "extra")}
    assert quality.repeated(spark.createDataFrame([("a",), ("a",), ("b",)], "k string"), "k").first()["n"] == 2


def test_taxonomy_text():
    assert list(tagging.load_taxonomy(json.dumps({"b": ["x"], "a": []}))) == ["b", "a"]


def test_page_pairs_in_blocks_equal_those_row_by_row(spark, monkeypatch):
    """Vectors null, empty, zero, of other lengths, with nulls or not finite, and copies: products of matrices give what single pairs do."""
    odd = [None, [], [0.0, 0.0], [1.0, 2.0, 3.0], [None, 1.0], [float("nan"), 1.0], [float("inf"), 1.0], [0.3, 0.4], [0.3, 0.4], [-1.0, 2.0], [0.1, 0.9]]
    data = [("AB"[i % 2], f"u{i}", ["x"] if i % 3 else ["y"], odd[i % 11]) for i in range(88)]
    df = spark.createDataFrame(data, "site string, url string, life_events array<string>, embedding array<double>")
    df = df.withColumns({"categories": F.array().cast("array<string>"), "keywords": F.array().cast("array<string>"), "out_link_tokens": F.array(F.lit("h.org"))})
    pairs = lambda t, m: sorted(str(tuple(r)) for r in similarity.page_pairs(df, t, m, ["life_events"]).collect())
    for threshold, metric in ((0.5, "combined"), (1.0, "embedding")):
        monkeypatch.setattr(similarity, "FEW", 1 << 60)
        single = pairs(threshold, metric)
        monkeypatch.setattr(similarity, "FEW", 0)
        monkeypatch.setattr(similarity, "BLOCK", 5)
        assert single == pairs(threshold, metric) and len(single) > 100


def test_page_pairs_of_large_classes_are_not_joined_row_by_row(spark):
    df = spark.range(400).select(F.when(F.col("id") % 2 == 0, "A").otherwise("B").alias("site"), F.col("id").cast("string").alias("url"), F.array(F.lit("x")).alias("life_events"), *(F.array().cast("array<string>").alias(c) for c in ("categories", "keywords", "out_link_tokens")), F.array(F.col("id").cast("double"), F.lit(9.0)).alias("embedding"))
    pairs = similarity.page_pairs(df, 0.9)
    assert "FlatMapCoGroupsInArrow" in pairs._jdf.queryExecution().toString() and pairs.count() == sum((a * b + 81) / ((a * a + 81) * (b * b + 81)) ** 0.5 >= 2 / 3 for a in range(0, 400, 2) for b in range(1, 400, 2))


def test_fragments_come_in_slices_of_bounded_text(monkeypatch):
    import pandas as pd

    pages = pd.DataFrame({"page": [f"u{i}" for i in range(50)], "html": [f"<main><h1>t{i}</h1><p>{'x ' * 500}</p></main>" for i in range(50)]})
    same = ["page", "pos", "title", "content_text", "content_html"]
    whole = pd.concat(html._run(iter([pages])))
    monkeypatch.setattr(html, "SLICE", 5000)
    parts = list(html._run(iter([pages])))
    assert len(parts) > 9 and max(map(len, parts)) <= 5 and pd.concat(parts)[same].values.tolist() == whole[same].values.tolist()


def test_rules_over_texts_read_the_lower_case_text_once(spark):
    """Phrases say what the rules' patterns say, and a rule does not compute the lower-case text again."""
    rng, words = random.Random(3), " ".join(p for p, _ in tagging.STRESS_RULES).translate(str.maketrans("()|?", "    ")).split()
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(9))).upper() for _ in range(300)] + [x for p, _ in tagging.STRESS_RULES for x in tagging.phrases(p)] + [None, ""]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    wanted = [next((w for p, w in tagging.STRESS_RULES if re.search(p, (t or "").lower())), 0) for t in texts]
    assert [r[0] for r in df.select(tagging.stress_weight(F.col("text"))).collect()] == wanted and len(set(wanted)) > 9
    c = F.col("text")
    for column in (tagging.stress_weight(c), tagging.provider(c, c), tagging.states(c, c), tagging.life_events(c, {"a": ("x", "y"), "b": ("z",)})):
        assert df.select(column.alias("x"))._jdf.queryExecution().optimizedPlan().toString().count("lower(") <= 2
