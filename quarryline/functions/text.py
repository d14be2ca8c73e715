"""Text columns: normalisation, tokens, titles, keywords, reading level."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words and titles that the results depend on.
STOPWORDS = (
    "the", "is", "at", "which", "on", "a", "an", "and", "or", "but", "in", "with", "to", "for", "of", "as", "by", "that", "this", "it", "from", "are", "be", "was", "were",
    "been", "being", "have", "has", "had", "do", "does", "did", "will", "would", "should", "could", "may", "might", "can", "cannot", "not", "your", "you", "we", "our", "us",
    "their", "they", "them", "about", "more", "info", "information",
)
KEYWORD_STOPWORDS = (
    "the", "is", "at", "which", "on", "a", "an", "and", "or", "but", "in", "with", "to", "for", "of", "as", "by", "that", "this", "it", "from", "be", "are", "been", "being",
    "have", "has", "had", "do", "does", "did", "will", "would", "should", "could", "may", "might",
)
GENERIC_TITLES = (
    "on this page", "overview", "introduction", "contents", "related information", "see also", "further information", "more information", "contact us", "help", "footer",
    "navigation", "quick links", "table of contents", "summary", "related links", "useful links", "about", "about us", "site map", "sitemap",
)
GENERIC_WORDS = ("overview", "introduction", "contents", "summary", "information", "help", "contact", "contacts", "links", "related", "about")
LINK_WORDS = ("service", "eligibility", "apply", "benefit", "support", "help", "information")


def words(values: tuple[str, ...]) -> Column:
    return F.array(*map(F.lit, values))


def normalize(text: Column) -> Column:
    """Lower case, everything but a-z, 0-9 and space as one space, trimmed; null is empty."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+", " "))


def tokens(text: Column, drop_stopwords: bool = True) -> Column:
    split = F.filter(F.split(normalize(text), " "), lambda t: t != "")
    return F.filter(split, lambda t: ~t.isin(*STOPWORDS)) if drop_stopwords else split


def token_set(text: Column, drop_stopwords: bool = True) -> Column:
    """Distinct tokens in order of first occurrence."""
    return F.array_distinct(tokens(text, drop_stopwords))


def title_key(title: Column) -> Column:
    """The first five, in order, of the distinct words among the first twelve tokens."""
    return F.array_join(F.slice(F.sort_array(F.array_distinct(F.slice(tokens(title), 1, 12))), 1, 5), "_")


def is_generic_title(title: Column) -> Column:
    t = F.trim(F.lower(F.coalesce(title, F.lit(""))))
    toks = tokens(t)
    return (t == "") | t.isin(*GENERIC_TITLES) | ((F.size(toks) <= 2) & F.forall(toks, lambda x: x.isin(*GENERIC_WORDS)))


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w != ""))


def round_half_up(x: Column) -> Column:
    return F.floor(x + 0.5)


def reading_level(text: Column) -> Column:
    """Grade of Flesch-Kincaid, 1 to 12; 12 without words or sentences. Syllables are approximated by runs of vowels."""
    text = F.coalesce(text, F.lit(""))
    n_words = word_count(text)
    sentences = F.size(F.filter(F.split(text, "[.!?]+"), lambda s: F.trim(s) != ""))
    syllables = F.regexp_count(F.lower(text), F.lit("[aeiouy]+"))
    grade = 0.39 * n_words / F.greatest(sentences, F.lit(1)) + 11.8 * syllables / F.greatest(n_words, F.lit(1)) - 15.59
    return F.when((n_words == 0) | (sentences == 0), 12).otherwise(F.least(F.greatest(round_half_up(grade), F.lit(1)), F.lit(12))).cast("int")


def keyword_tokens(text: Column) -> Column:
    """Words longer than three characters that are no stop words."""
    clean = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^a-z0-9_\s]", " ")
    return F.filter(F.split(clean, r"\s+"), lambda w: (F.length(w) > 3) & ~w.isin(*KEYWORD_STOPWORDS))


def keywords(text: Column, top: int = 10) -> Column:
    """The most frequent keyword tokens: by count, then integers by value, then first occurrence.

    Sorted with their places, equal tokens stand together; a possessive pattern
    takes each run, so the work is that of a sort.
    """
    placed = F.sort_array(F.transform(keyword_tokens(text), lambda w, i: F.concat(w, F.lit(":"), F.lpad(i.cast("string"), 9, "0"))))
    runs = F.regexp_extract_all(F.array_join(placed, " "), F.lit(r"([^ :]+):[0-9]{9}(?: \1:[0-9]{9})*+"), 0)
    word = lambda r: F.substring_index(r, ":", 1)
    integer = lambda r: word(r).rlike("^(0|[1-9][0-9]{0,8})$")
    ranked = F.transform(
        runs,
        lambda r: F.struct(
            (-F.floor((F.length(r) + 1) / (F.length(word(r)) + 11))).alias("n"),
            F.when(integer(r), 0).otherwise(1).alias("kind"),
            F.when(integer(r), word(r).try_cast("long")).otherwise(F.substring(r, F.length(word(r)) + 2, F.lit(9)).cast("long")).alias("place"),
            word(r).alias("word"),
        ),
    )
    return F.transform(F.slice(F.sort_array(ranked), 1, top), lambda r: r["word"])


def link_relevance(text: Column) -> Column:
    """How many of the link words a text has."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return sum((F.when(F.contains(low, F.lit(k)), 1).otherwise(0) for k in LINK_WORDS), F.lit(0))


def popularity(level: Column, form: Column, alert: Column, lists: Column, tables: Column, text: Column) -> Column:
    n = word_count(text)
    flag = lambda c, v: F.when(c, v).otherwise(0)
    score = 100 - (level - 1) * 10 + flag(form, 20) + flag(alert, 15) + flag(lists, 10) + flag(tables, 10) + flag((n > 50) & (n < 500), 10)
    return F.least(F.greatest(score, F.lit(0)), F.lit(100)).cast("int")
