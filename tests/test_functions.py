"""Truth tables of the text, URL, set and hashing columns."""

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quarryline.functions import hashing, sets, text, urls


def one(spark, column, **values):
    rows = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'array<string>' if isinstance(v, list) else 'string'}" for k, v in values.items())) if values else spark.range(1)
    return rows.select(column.alias("v")).first()["v"]


def test_text(spark):
    assert one(spark, text.normalize(F.col("t")), t="  Age-Pension, 2024!\n") == "age pension 2024"
    assert one(spark, text.normalize(F.col("t")), t=None) == ""
    assert one(spark, text.tokens(F.col("t")), t="The age of the Age") == ["age", "age"]
    assert one(spark, text.token_set(F.col("t"), False), t="b a b") == ["b", "a"]
    assert one(spark, text.title_key(F.col("t")), t="Zebra yak the apple mule bee yak cat") == "apple_bee_cat_mule_yak"
    for title, generic in (("", True), (None, True), ("Overview", True), ("the of", True), ("help links", True), ("Age pension", False), ("Contact us", True), ("help links about pensions", False)):
        assert one(spark, text.is_generic_title(F.col("t")), t=title) is generic, title
    assert one(spark, text.keywords(F.col("t")), t="zeta 2020 alpha zeta beta with 1999 alpha of beta") == ["zeta", "alpha", "beta", "1999", "2020"]
    assert one(spark, text.keywords(F.col("t")), t="") == []
    assert one(spark, text.reading_level(F.col("t")), t="") == 12
    assert one(spark, text.reading_level(F.col("t")), t="The cat sat. The dog ran.") == 1
    assert one(spark, text.link_relevance(F.col("t")), t="Apply for support services") == 3
    flags = [F.lit(True)] * 4
    assert one(spark, text.popularity(F.lit(1), *flags, F.lit("a"))) == 100
    assert one(spark, text.popularity(F.lit(4), *[F.lit(False)] * 4, F.lit("w " * 60))) == 80


def test_urls(spark):
    for url, host, base in (
        ("https://Example.com:443/A/b?x=1#y", "example.com", "https://example.com/A/b"),
        ("http://u:p@h.org:8080", "h.org", "http://h.org:8080/"),
        ("no url#frag", "", "no url"),
    ):
        assert one(spark, urls.host(F.col("u")), u=url) == host
        assert one(spark, urls.base_url(F.col("u")), u=url) == base
    page = "https://h.org/a/b/c.html?q#f"
    for href, want in (("/x", "https://h.org/x"), ("d", "https://h.org/a/b/d"), ("//o.net/z", "https://o.net/z"), ("mailto:x@y", None), ("#t", "https://h.org/a/b/c.html?q#t"), ("?r", "https://h.org/a/b/c.html?r"), ("http://k/", "http://k/")):
        assert one(spark, urls.resolve(F.col("h"), F.lit(page)), h=href) == want, href
    assert one(spark, urls.hrefs(F.col("h")), h="<a HREF = \"/x\"><a href='/y'><a href=\"z\">") == ["/x", "z"]
    assert one(spark, urls.link_tokens(F.col("l")), l=["https://a.org/Seg/x", "https://a.org/seg", "bad"]) == ["a.org", "a.org/seg"]
    assert one(spark, urls.html_link_tokens(F.col("h")), h='<a href="/s/t"><a href="https://B.net">') == ["example.org", "example.org/s", "b.net"]
    assert one(spark, urls.site_hierarchy(F.col("u")), u="https://h.org/a//b/?x") == ["h.org", "a", "b"]


def test_sets(spark):
    jac = lambda a, b: one(spark, sets.jaccard(F.col("a"), F.col("b")), a=a, b=b)
    assert jac([], []) == 1 and jac(["x"], []) == 0 and jac(["x", "y"], ["y", "z"]) == pytest.approx(1 / 3)
    vec = lambda a, b: spark.createDataFrame([(a, b)], "a array<double>, b array<double>").select(sets.cosine(F.col("a"), F.col("b")).alias("v")).first()["v"]
    assert vec([1.0, 0.0], [1.0, 1.0]) == pytest.approx(0.5**0.5)
    assert vec([0.0], [1.0]) == vec([], []) == vec([1.0], [1.0, 2.0]) == vec(None, [1.0]) == 0


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.sampled_from("abcdef"), max_size=6, unique=True), st.lists(st.sampled_from("abcdef"), max_size=6, unique=True))
def test_jaccard_is_symmetric(spark, a, b):
    df = spark.createDataFrame([(a, b)], "a array<string>, b array<string>")
    x, y = df.select(sets.jaccard(F.col("a"), F.col("b")), sets.jaccard(F.col("b"), F.col("a"))).first()
    assert x == y and 0 <= x <= 1


def test_hashing(spark):
    for token, bucket in (("medicare", 8), ("pregnancy", 52), ("carer", 84), ("18", 172)):
        assert one(spark, hashing.token_bucket(F.col("t")), t=token) == bucket
    v = one(spark, hashing.embedding(F.col("t")), t=["carer", "carer", "18"])
    assert v[84] == pytest.approx(2 / 5**0.5) and v[172] == pytest.approx(1 / 5**0.5) and sum(x * x for x in v) == pytest.approx(1)
    assert set(one(spark, hashing.embedding(F.col("t")), t=[])) == {0.0}
    rows = spark.createDataFrame([("k", ["carer", "carer", "18"])], "k string, toks array<string>")
    assert hashing.embeddings(rows, "k", "toks").first()["embedding"] == pytest.approx(v)
    import hashlib

    assert one(spark, hashing.fragment_id(F.lit("u"), F.lit("h"), F.lit(None))) == hashlib.md5(b"uh").hexdigest()
