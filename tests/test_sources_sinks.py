"""Sources, sinks, the stream and the entry points."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from quarryline.operators import similarity
from quarryline.plans import catalog
from quarryline.sources import readers, sinks
from quarryline.streaming import upserts


def test_json_sources(spark, tmp_path):
    (tmp_path / "s.jsonl").write_text("\n".join(json.dumps(x) for x in [{"ideal": "a", "eval_type": "e"}, {"ideal": ["b", "c"], "ideal_entities": ["d"]}]))
    assert [r["ideal"] for r in readers.samples(spark, f"{tmp_path}/s.jsonl").collect()] == [["a"], ["b", "c"]]
    (tmp_path / "g.json").write_text(json.dumps([{"id": "x", "event_name": "X", "prerequisites": ["y"], "typical_age_range": [1, 2]}]))
    row = readers.life_graph(spark, f"{tmp_path}/g.json").first()
    assert row["prerequisites"] == ["y"] and row["typical_age_range"] == [1, 2] and row["cluster"] is None
    (tmp_path / "t.json").write_text(json.dumps({"category": {"B": ["x", "y"], "A": ["z"]}}))
    got = readers.taxonomy_rows(spark, f"{tmp_path}/t.json").orderBy("label_ord", "keyword_ord").collect()
    assert [(r["label"], r["keyword"]) for r in got] == [("B", "x"), ("B", "y"), ("A", "z")]
    assert readers.fixtures(spark, f"{tmp_path}/g.json").count() == 1


def test_sitemaps_and_robots(spark):
    index = "<sitemapindex><sitemap><loc>https://h/a.xml</loc></sitemap><sitemap><loc>https://h/sub</loc></sitemap></sitemapindex>"
    url = lambda *u: "<urlset>" + "".join(f"<url><loc>{x}</loc></url>" for x in u) + "</urlset>"
    docs = spark.createDataFrame([("https://h/sitemap.xml", index), ("https://h/a.xml", url("https://h/1", "https://h/2")), ("https://h/sub/sitemap.xml", url("https://h/2", "https://h/3")), ("https://h/other.xml", url("https://h/9"))], "url string, xml string")
    assert sorted(r["url"] for r in readers.sitemap_urls(docs, "https://h/").collect()) == ["https://h/1", "https://h/2", "https://h/3"]
    links = spark.createDataFrame([("https://h/private/x",), ("https://h/y",), ("https://o/private",)], "url string")
    robots = spark.createDataFrame([("h", "User-agent: *\nDisallow: /private")], "host string, robots string")
    assert sorted(r["url"] for r in readers.allowed(links, robots).collect()) == ["https://h/y", "https://o/private"]


def test_frontier(spark):
    html = '<a href="/a">nothing</a><a href="/b">apply for support</a><a href="/c.pdf">help</a><a href="https://o.org/">apply</a><a href="/login">apply</a><a href="#x">apply</a><a class="k" href="/d">help</a><a href="/b">apply</a>'
    df = spark.createDataFrame([("https://h.org/p", html)], "url string, html string")
    assert [(r["link"], r["score"]) for r in readers.frontier(df, 2).orderBy(F.desc("score")).collect()] == [("https://h.org/b", 2), ("https://h.org/d", 1)]


def test_upsert_and_prune(spark):
    old = spark.createDataFrame([("a", 1, "x"), ("b", 1, "y")], "id string, crawl_version int, v string")
    new = spark.createDataFrame([("b", 2, "n", 1), ("b", 3, "m", 2), ("c", 2, "c", 3)], "id string, crawl_version int, v string, extra int")
    merged = sinks.upsert(old, new)
    assert sorted(tuple(r) for r in merged.collect()) == [("a", 1, "x", None), ("b", 3, "m", 2), ("c", 2, "c", 3)] or {r["id"]: r["v"] for r in merged.collect()} == {"a": "x", "b": "m", "c": "c"}
    pruned = sinks.prune(merged, 2)
    assert {r["id"] for r in pruned.collect()} == {"b", "c"} and sinks.prune(pruned, 2).count() == 2
    assert sinks.migrated(old, new).columns == ["id", "crawl_version", "v", "extra"]


def test_exports(spark, tmp_path):
    df = spark.createDataFrame([("a,1", ["x", "y"], {"k": "v"}), ('q"', [], None)], "id string, tags array<string>, m map<string,string>").coalesce(1)
    sinks.export_csv(df, f"{tmp_path}/csv", quote_all=True)
    assert [r["tags"] or "" for r in spark.read.csv(f"{tmp_path}/csv", header=True, escape='"').orderBy("id").collect()] == ["x|y", ""]
    sinks.export_json(df, f"{tmp_path}/json", 1)
    assert spark.read.json(f"{tmp_path}/json").count() == 1
    assert len(json.loads("".join(sinks.stream_json(df)))) == 2 and "".join(sinks.stream_json(df.limit(0))) == "[]"
    sinks.link_graph_json(spark.createDataFrame([("u",)], "url string"), spark.createDataFrame([("u", "v")], "source string, target string"), f"{tmp_path}/graph")
    assert spark.read.text(f"{tmp_path}/graph").count() == 2
    sinks.write_versions(spark.createDataFrame([("a", 1), ("b", 2)], "id string, crawl_version int"), f"{tmp_path}/versions")
    assert sinks.prune(spark.read.parquet(f"{tmp_path}/versions"), 2).count() == 1
    stats = readers.statistics(df)
    assert stats["num_documents"] == 2 and stats["fields"][0] == ("id", "string")
    assert readers.union_of([df.select("id"), df]).count() == 4


def test_stream_merges_batches(spark, tmp_path):
    ddl = "id string, crawl_version int, v string"
    for rows in ([("a", 1, "x"), ("b", 1, "y")], [("b", 2, "z"), ("c", 2, "w")]):
        spark.createDataFrame(rows, ddl).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        upserts.merge_batches(upserts.watch(spark, f"{tmp_path}/in", ddl), f"{tmp_path}/table", f"{tmp_path}/check").awaitTermination(60)
    assert {r["id"]: r["v"] for r in upserts.current(spark, f"{tmp_path}/table").collect()} == {"a": "x", "b": "z", "c": "w"}
    assert upserts.current(spark, f"{tmp_path}/none") is None


def test_entry_points(spark):
    assert __spark_entry__.entry(spark).count() > 0
    found = __spark_entry__.queries()
    assert set(__spark_entry__.oracle_sql()) <= set(found) and len(found) > 30


@pytest.mark.parametrize("name", ["page_hosts", "doc_keywords", "doc_facets", "prerequisite_chain", "claim_grounding", "schema_diff", "upsert_latest", "hashed_embedding_buckets"])
def test_queries_equal_their_oracles(spark, name):
    import duckdb

    d = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("pages", "documents", "benchmark", "events", "labels", "conversations", "part", "lineitem"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet'")
    want = con.execute(__spark_entry__.oracle_sql()[name]).df()
    got = __spark_entry__.queries()[name](spark, d).toPandas()
    key = lambda df: sorted(map(repr, df[sorted(df.columns)].astype(object).where(df.notna(), None).values.tolist()))
    assert sorted(got.columns) == sorted(want.columns) and key(got) == key(want)


def test_prune_stale_takes_the_day_of_the_nearest_second(spark, tmp_path):
    """As its SQL, where epoch(ts)::BIGINT rounds: the last half second of a day is of the next."""
    kinds = (("2024-01-01 23:59:59.6", "kept"), ("2024-01-01 23:59:59.4", "dropped"), ("2024-01-08 12:00:00", "other"), ("2024-01-08 23:59:59.5", "last"))
    for zone in ("timestamp_ntz", "timestamp"):
        spark.createDataFrame(kinds, "t string, event_type string").select(F.col("t").cast(zone).alias("ts"), "event_type").write.parquet(f"{tmp_path}/{zone}/events.parquet")
        assert {r.event_type for r in catalog.prune_stale(spark, f"{tmp_path}/{zone}").collect()} == {"kept", "other", "last"}


def test_frontier_of_pages_with_one_url_does_not_depend_on_their_order(spark):
    pages = [("https://h.org/p", f'<a href="/{k}">x</a>') for k in "cabd"]
    for rows in (pages, pages[::-1]):
        df = spark.createDataFrame(rows, "url string, html string").coalesce(1)
        assert [r["link"][-1] for r in readers.frontier(df, 2).orderBy("link").collect()] == ["a", "b"]


def test_html_fragments_leaves_cut_off_references(spark, tmp_path):
    """As its SQL: a reference without its semicolon is text."""
    html = "<html><body><article><h1>a&amp;&amp</h1><p>b &lt &lt;c&amp;lt &quot</p></article></body></html>"
    spark.createDataFrame([(0, "https://h.org/p", html)], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    row = catalog.html_fragments(spark, str(tmp_path)).first()
    assert row.title == "a&&amp" and row.id == hashlib.md5(b"https://h.org/pa&&ampb &lt <c&lt &quot").hexdigest()


def test_pairs_that_carry_their_pages_export_as_joined_ones(spark):
    data = [("AB"[i % 2], f"u{i}", ["x"], ["m", "n"][: i % 3], [1.0, float(i)], f"t{i}", None if i == 3 else i) for i in range(8)]
    df = spark.createDataFrame(data, "site string, url string, life_events array<string>, categories array<string>, embedding array<double>, title string, fragment_count int")
    df = df.withColumns({"keywords": F.array().cast("array<string>"), "out_link_tokens": F.array(F.lit("h.org"))})
    carried = sinks.similarity_export(similarity.page_pairs(df, carried=sinks.EXPORTED))
    joined = sinks.similarity_export(similarity.page_pairs(df), df)
    assert sorted(map(tuple, carried.collect())) == sorted(map(tuple, joined.collect())) and carried.count() > 3 and carried.columns == joined.columns
