"""The persistent index against searches that scan."""

import random
import re

import pytest
from pyspark.sql import functions as F

from quarryline.operators import search as S
from quarryline.operators.index import Index, variants
from quarryline.sources.shared import shared_path

DDL = "id long, title string, body string, token string, bucket int, field int, segment int, positions string"
WORDS = ["apply", "applied", "apples", "payment", "payments", "pay", "carer", "carers", "a", "ab", "housing", "hosing", "medicare", "medicate", "x" * 40, "x" * 39 + "y", "12", "123456789"]


def rows_of(n, seed=1, words=WORDS):
    rng = random.Random(seed)
    text = lambda k: None if rng.random() < 0.05 else " ".join(rng.choice(words) for _ in range(rng.randint(0, k))) + rng.choice(["", ".", " É!"])
    return {i: (text(4), text(30)) for i in range(n)}


def frame(spark, rows):
    return spark.createDataFrame([(k, *v, "clash", 1, 1, 1, "clash") for k, v in rows.items()], DDL)


def index_of(spark, rows, **kw):
    index = Index(spark, shared_path(spark, "index"), "id", ("title", "body"), **kw)
    index.add(frame(spark, rows))
    return index


def scores(df):
    return {r.id: round(r.text_match, 9) for r in df.collect()}


@pytest.fixture(scope="module")
def built(spark):
    rows = rows_of(200)
    return rows, index_of(spark, rows, buckets=8)


@pytest.mark.parametrize(
    "query,typos,prefix",
    [("apply", 2, True), ("aplly payments", 2, True), ("medicare car", 1, False), ("x" * 40, 2, True), ("housing, 12 a", 0, True), ("no-such-word apply", 2, True), ("pay", 1, False)],
)
def test_matches_as_a_scan_does(spark, built, query, typos, prefix):
    rows, index = built
    want = scores(S.matches(frame(spark, rows), "id", query, ("title", "body"), typos, prefix))
    assert scores(index.matches(query, typos, prefix)) == want
    best = sorted(want.items(), key=lambda x: (-x[1], x[0]))[:7]
    got = [(r.id, round(r.text_match, 9)) for r in index.top(query, 7, typos, prefix).orderBy(F.desc("text_match"), "id").collect()]
    assert got == best


def test_phrases_by_position(spark, built):
    rows, index = built
    for phrase in ("apply payment", "pay pay", "a ab housing", "carer", "none such"):
        words = phrase.split()
        tokens = lambda t: re.findall("[a-z0-9]+", (t or "").lower())
        places = lambda t: sum(tokens(t)[i : i + len(words)] == words for i in range(len(tokens(t))))  # noqa: B023, E731
        want = {i: n for i, v in rows.items() if (n := sum(map(places, v)))}
        assert {r.id: r.places for r in index.phrase(phrase).collect()} == want


def test_updates_removals_and_compaction(spark):
    rows = rows_of(60)
    index = index_of(spark, rows, buckets=4)
    state = dict(rows)
    for step, change in enumerate((rows_of(20, 2), {100 + i: v for i, v in rows_of(10, 3).items()})):
        index.add(frame(spark, change))
        state |= change
        gone = [k for k in state if k % 9 == step]
        index.drop(frame(spark, {k: state.pop(k) for k in gone}))
        want = scores(S.matches(frame(spark, state), "id", "apply pay", ("title", "body")))
        assert scores(index.matches("apply pay")) == want
    index.compact()
    assert len(index._segments()) == 1
    assert scores(index.matches("apply pay")) == want
    again = {5: ("apply pay", "")}
    index.add(frame(spark, again), segment=20)
    index.add(frame(spark, again), segment=20)  # a batch that runs again
    assert scores(index.matches("apply pay")) == scores(S.matches(frame(spark, state | again), "id", "apply pay", ("title", "body")))


def test_what_is_not_committed_is_not_read(spark, built):
    rows, _ = built
    index = index_of(spark, {1: ("apply", "")}, buckets=4)
    index._write_keys(frame(spark, {1: ("", "")}).select("id"), 1)
    assert scores(index.matches("apply")) == {1: 1.0}


def test_reads_only_the_buckets_of_the_words(spark):
    index = index_of(spark, rows_of(50, words=[f"word{i}" for i in range(100)]), buckets=16)
    found = index.tokens_of(["word7"], 0, False)
    files = index.postings_of(found.cache()).inputFiles()
    assert len({re.search(r"postings/.*bucket=(\d+)", f)[1] for f in files if "postings" in f}) == 1


def test_an_empty_table_and_no_words(spark):
    index = index_of(spark, {})
    assert index.matches("apply").count() == index.phrase("apply").count() == index.top("apply", 3).count() == 0
    with pytest.raises(ValueError):
        Index(spark, shared_path(spark, "index"), "id", ("title",)).matches("apply")
    with pytest.raises(ValueError):
        index.matches("*")
    assert index_of(spark, {1: (None, None), 2: ("a", None)}).matches("b").count() == 0


def test_words_within_two_typos_share_a_variant():
    rng = random.Random(4)
    for _ in range(3000):
        a = "".join(rng.choice("abc") for _ in range(rng.randint(4, 14)))
        b = list(a)
        for _ in range(2):
            at = rng.randrange(len(b) + 1)
            b[at : at + rng.randint(0, 1)] = rng.choice(["", rng.choice("abcd")])
        assert variants(a) & variants("".join(b))


def test_variants_are_kept_once_for_tokens_that_begin_alike(spark):
    """Long words with few beginnings: the table of variants grows with the beginnings, and all words are found within their typos."""
    rows = {i: (None, f"medicare{i:03d}x carers{i % 2}") for i in range(300)}
    index = index_of(spark, rows, buckets=4)
    assert spark.read.parquet(f"{index.path}/heads").count() <= 3 * 37
    for query in ("medicare007x", "medicaer107x", "edicare20x"):
        want = scores(S.matches(frame(spark, rows), "id", query, ("title", "body"), 2, False))
        assert want and scores(index.matches(query, 2, False)) == want
