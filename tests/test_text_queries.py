from pyspark.sql import functions as F

from quarryline.operators import profile as Q
from quarryline.operators import services as V
from quarryline.plans import text_queries as T


def test_filters_of_rows_equal_those_of_one_profile(spark):
    rows = [("NSW", ["a", "b"], None, None), ("National", [], "VIC", None), (None, None, None, "c"), ("", ["a"], "", "d"), ("VIC", None, "NSW", "")]
    df = spark.createDataFrame(rows, "state string, events array<string>, s string, e string")
    found = df.select(Q.filters_of(F.col("state"), F.col("events"), F.col("s"), F.col("e")).alias("f")).select("f.*").collect()
    for (state, events, s, e), r in zip(rows, found, strict=True):
        one = Q.profile_facets({"residency_state": state, "current_life_events": events}, {"state": s, "life_event": e})
        assert (r.state, r.life_event) == (one["state"] or None, one["life_event"] or None)


def test_names_have_no_white_space_at_their_ends(spark):
    df = spark.createDataFrame([("t", "\n\t Age Pension \n."), ("", "no such thing"), (None, None)], "title string, text string")
    assert [r.n for r in df.select(V.service_name(F.col("title"), F.col("text")).alias("n")).collect()] == ["t \n\t Age Pension", None, None]
    one = spark.createDataFrame([("\n x Payment", ["formerly the old\n one \n. more"])], "name string, texts array<string>")
    assert one.select(V.common_names(F.col("name"), F.col("texts")).alias("n")).first().n == ["\n x Payment", "the old\n one"]


def test_pages_and_stories_of_empty_and_null_documents(spark, tmp_path):
    docs = spark.createDataFrame([(0, None, None, None, None), (1, "", "en", "s", 0), (2, "a erst b erth c", "en", "s", 15)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    assert {r.id: r.weight for r in T.stress_of_texts(spark, str(tmp_path)).collect()} == {"0": 0, "1": 0, "2": 100}
    found = T.structured_fragments(spark, str(tmp_path)).groupBy("page_url").count().where("page_url is not null").collect()
    assert sorted((r.page_url, r["count"]) for r in found) == [("https://www.x.org/none/0", 4), ("https://www.x.org/s/1", 4), ("https://www.x.org/s/2", 4)]
