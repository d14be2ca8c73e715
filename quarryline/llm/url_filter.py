"""URL filters by a bit-parallel wildcard automaton.

All glob rules are packed into one row of 64-bit words, a bit for each literal
character. One step of Shift-And moves every rule over a character of a
canonical url at once; a literal followed by ``*`` keeps its bit. A block of
urls advances together, so a step costs a few operations on an array of urls
by words, however many rules there are.

The canonical url is ``.host``, a separator and the path. A host rule fits the
host and its subdomains: ``*.host``, the separator, the path's start, ``*``.
Among the rules that fit the longest (host and path) decides, of equally long
ones the first listed. Where none fits, a glob of the blocked words does.

A null url, or one without ``://``, has empty host and path and is allowed.
Rows are independent: repeated rows repeat, an empty table gives an empty
result, other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.llm.common import table

SEPARATOR = "\x01"


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str

    @property
    def glob(self) -> str:
        return f"*.{self.host}{SEPARATOR}{self.path}*"


#: Fixed by the contract of the query.
HOST_RULES = (Rule("block", "net", "/"), Rule("allow", "example.net", "/en/"), Rule("block", "example.com", "/de/"), Rule("allow", "org", "/fr/"))
#: The method's own: hosts with one of these words are blocked where no host rule fits.
BLOCKED_HOSTS = ("*adult*", "*casino*", "*pills*", "*porn*", "*xxx*")


class Automaton:
    """Whole-string matching of globs (``*`` any run, ``?`` any character) over many strings at once."""

    def __init__(self, globs: Sequence[str]):
        bits = sum(len(g.replace("*", "")) for g in globs)
        self.globs, self.words = tuple(globs), max(1, -(-bits // 64))
        literals = sorted({c for g in globs for c in g} - {"*", "?"})
        self.classes = {c: k + 1 for k, c in enumerate(literals)}
        blank = lambda: np.zeros(self.words, np.uint64)
        self.first, self.begin, self.always, self.stay = blank(), blank(), blank(), blank()
        self.takes = np.zeros((len(literals) + 1, self.words), np.uint64)
        self.last: list[tuple[int, np.uint64] | None] = []
        at = 0
        for g in self.globs:
            n, start = 0, at
            for k, c in enumerate(g):
                if c == "*":
                    if at > start:
                        self._set(self.stay, at - 1)
                    continue
                if c == "?":
                    for row in self.takes:
                        self._set(row, at)
                else:
                    self._set(self.takes[self.classes[c]], at)
                if at == start:
                    self._set(self.first, at)
                    self._set(self.always if k else self.begin, at)
                at, n = at + 1, n + 1
            self.last.append((at // 64 if n == 0 else (at - 1) // 64, np.uint64(1 << ((at - 1) % 64))) if n else None)
        self.points = np.array([ord(c) for c in literals], np.uint32)

    @staticmethod
    def _set(row: np.ndarray, bit: int) -> None:
        row[bit // 64] |= np.uint64(1 << (bit % 64))

    def match(self, texts: Sequence[str], area: int = 4_000_000) -> np.ndarray:
        """A row for each text and a column for each glob: whether it matches the whole text."""
        out = np.zeros((len(texts), len(self.globs)), bool)
        lengths = np.array([len(t) for t in texts], np.int64)
        order = np.argsort(-lengths, kind="stable")
        at = 0
        while at < len(order):
            rows = order[at : at + max(1, area // max(1, int(lengths[order[at]])))]
            out[rows] = self._block([texts[i] for i in rows], lengths[rows])
            at += len(rows)
        return out

    def _block(self, texts: list[str], lengths: np.ndarray) -> np.ndarray:
        """Of texts in falling order of length."""
        longest = int(lengths[0])
        kinds = np.zeros((len(texts), longest), np.uint16)
        if longest:
            points = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
            found = np.searchsorted(self.points, points).clip(max=max(0, len(self.points) - 1))
            kinds[np.arange(longest) < lengths[:, None]] = np.where(self.points[found] == points, found + 1, 0) if len(self.points) else 0
        state = np.zeros((len(texts), self.words), np.uint64)
        live = np.searchsorted(-lengths, -np.arange(longest), side="left")  # texts longer than t
        one, top = np.uint64(1), np.uint64(63)
        for t in range(longest):
            now = state[: live[t]]
            moved = now << one
            moved[:, 1:] |= now[:, :-1] >> top
            moved &= ~self.first
            moved |= self.always | self.begin if t == 0 else self.always
            moved &= self.takes[kinds[: live[t], t]]
            state[: live[t]] = moved | (now & self.stay)
        out = np.empty((len(texts), len(self.globs)), bool)
        for k, (glob, last) in enumerate(zip(self.globs, self.last, strict=True)):
            out[:, k] = (state[:, last[0]] & last[1]) != 0 if last else (lengths == 0) | ("*" in glob)
        return out


@lru_cache(maxsize=8)
def _automaton(globs: tuple[str, ...]) -> Automaton:
    return Automaton(globs)


def host_of(url: str | Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    host = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit(""))
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: str | Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def matching(host: Column, path: Column, rules: Sequence[Rule] = HOST_RULES, blocked: Sequence[str] = BLOCKED_HOSTS) -> Column:
    """struct(rule, verdict) for each host and path."""
    rules = sorted(rules, key=lambda r: -len(r.host + r.path))
    globs = (*(r.glob for r in rules), *(b + SEPARATOR + "*" for b in blocked))
    names = np.array([r.host + r.path for r in rules] + [None], object)
    verdicts = np.array([r.verdict for r in rules] + [None], object)

    @F.pandas_udf("rule string, verdict string")
    def judged(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for hosts, paths in parts:
            clean = (f".{h.replace(SEPARATOR, ' ')}{SEPARATOR}{p.replace(SEPARATOR, ' ')}" for h, p in zip(hosts, paths, strict=True))
            fits = _automaton(globs).match(list(clean))
            n = len(rules)
            first = np.where(fits[:, :n].any(axis=1), fits[:, :n].argmax(axis=1), n) if n else np.zeros(len(fits), int)
            own = np.where(fits[:, n:].any(axis=1), "block", "allow").astype(object)
            yield pd.DataFrame({"rule": names[first], "verdict": np.where(first < n, verdicts[first], own)})

    return judged(host, path)


def filter_urls(df: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: Sequence[Rule] = HOST_RULES, blocked: Sequence[str] = BLOCKED_HOSTS) -> DataFrame:
    """The id, host, path, the deciding rule (or null) and the verdict of each row."""
    parts = df.select(F.col(id_col).alias("page_id"), host_of(df[url_col]).alias("host"), path_of(df[url_col]).alias("path"))
    found = parts.withColumn("found", matching(F.col("host"), F.col("path"), rules, blocked))
    return found.select("page_id", "host", "path", "found.rule", "found.verdict")


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A verdict on the url of each page."""
    return filter_urls(table(spark, sf_dir, "pages"))


OP6_SQL = r"""
WITH parts AS (
  SELECT page_id,
    translate(coalesce(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages
), ruled AS (
  SELECT *, CASE
    WHEN ends_with('.' || host, '.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN ends_with('.' || host, '.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN ends_with('.' || host, '.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN ends_with('.' || host, '.net') AND starts_with(path, '/') THEN 'net/' END AS rule
  FROM parts
)
SELECT page_id, host, path, rule, CASE
  WHEN rule IN ('example.net/en/', 'org/fr/') THEN 'allow'
  WHEN rule IS NOT NULL THEN 'block'
  WHEN regexp_matches(host, 'adult|casino|pills|porn|xxx') THEN 'block' ELSE 'allow' END AS verdict
FROM ruled
"""
