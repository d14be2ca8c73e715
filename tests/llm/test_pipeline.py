"""The pipeline's stages against brute force."""

from collections import defaultdict

from tokenizers import Tokenizer

import corpus_pipeline as P
from quarryline.llm import language_id, packing, secret_scan, substring_dedup
from test_dedup import brute_classes, brute_removal

SMALL = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    assert [name for name, _ in P.STAGES] == ["language", "near_duplicates", "repeated_passages", "secrets", "sequences"]
    first = P.language(spark, docs, SMALL)
    assert first.dtypes == docs.dtypes
    one = {r["doc_id"]: r["text"] for r in first.collect()}
    judged = {r["doc_id"]: r for r in language_id.predict(docs, language_id.train(docs)).collect()}
    every = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert one == {k: t for k, t in every.items() if judged[k]["lang_pred"] != "und" and judged[k]["score"] >= P.LEAST_COSINE}

    second = P.near_duplicates(spark, spark.createDataFrame(first.toPandas(), docs.schema), SMALL)
    assert second.dtypes == docs.dtypes
    two = {r["doc_id"]: r["text"] for r in second.collect()}
    assert set(two) == {int(c) for _, c, _ in brute_classes(list(one.items()))} and all(one[k] == t for k, t in two.items())

    third = P.repeated_passages(spark, spark.createDataFrame(second.toPandas(), docs.schema), SMALL)
    assert third.dtypes == docs.dtypes
    three = {r["doc_id"]: r["text"] for r in third.collect()}
    want = {int(d): kept for d, n, gone, kept in brute_removal(list(two.items()), 50) if gone < n}
    assert {k: " ".join(substring_dedup.words_of(t)) for k, t in three.items()} == want

    fourth = P.secrets(spark, spark.createDataFrame(third.toPandas(), docs.schema), SMALL)
    assert fourth.dtypes == docs.dtypes
    rows = fourth.collect()
    four = {r["doc_id"]: r["text"] for r in rows}
    assert four == {k: secret_scan.redacted(t) for k, t in three.items()} and all(r["n_chars"] == len(r["text"]) for r in rows)

    library = Tokenizer.from_file(packing.default_tokenizer())
    lengths = defaultdict(int)
    for r in P.sequences(spark, fourth, SMALL).collect():
        lengths[r["doc_id"]] += r["length"]
    assert lengths == {k: len(library.encode(t, add_special_tokens=False).ids) + 1 for k, t in four.items()}


def test_run_gives_the_last_stage(spark):
    rows = P.run(spark, SMALL).collect()
    assert rows and set(rows[0].asDict()) == {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"}
    assert P.ORACLE_SQL is None


def test_edge_documents(spark):
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (3, "12 34", "en", "s", 5), (4, "the cat and the dog", "en", "s", 19), (None, "the bird and the fish", "en", None, 21), (4, "the cat and the dog", "en", "s", 19)]
    docs = spark.createDataFrame([(*r, "extra") for r in rows], "doc_id long, text string, lang string, source string, n_chars long, score string")
    for _, stage in P.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, SMALL).collect(), "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted((str(r["doc_id"]), r["text"]) for r in docs.collect()) == [("4", "the cat and the dog"), ("None", "the bird and the fish")]
    assert P.sequences(spark, docs, SMALL).count() == 2
    unknown = spark.createDataFrame([(1, "the cat", None, "s", 7), (2, "12 !", None, "s", 4)], docs.schema)
    assert [r["doc_id"] for r in P.language(spark, unknown, SMALL).collect()] == [1]
    empty = docs.limit(0)
    for _, stage in P.STAGES:
        assert stage(spark, empty, SMALL).count() == 0
