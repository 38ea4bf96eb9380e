"""URL filter: rules first, then naive Bayes over words cut from host and path."""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: (host, path, verdict): a rule fits its host and all subdomains if the path starts with the rule's.
RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)
#: Labelled examples that the classifier is fitted on: hosts and paths in plain words.
EXAMPLES = {
    "block": ("casino win", "cheap pills", "adult x", "free bets", "spam farm", "ads track", "online casino bonus",
              "poker bets win", "cheap viagra pills", "adult xxx video", "free porn sex", "spam links farm",
              "ads click track", "banner ads", "win free prize", "casino slots jackpot", "payday loans cheap",
              "replica watches cheap", "escort adult", "betting odds win", "crack warez free", "pills pharmacy cheap"),
    "allow": ("news world", "blog articles", "wiki encyclopedia", "university library", "science journal", "health research",
              "museum history", "city council", "support forum", "docs reference", "music concert", "school learning",
              "travel guide", "weather report", "recipes kitchen", "book reviews", "garden plants", "open source project",
              "local sports club", "film festival", "art gallery", "public transport"),
}
ALLOW_PRIOR = 0.75
#: Words of the unigram model, at most: the most frequent of all pages.
VOCABULARY = 50_000
LONGEST = 24
_WORD = re.compile(r"[a-z]+")


def parts(url: F.Column) -> tuple[F.Column, F.Column]:
    """Host (A-Z lower-cased) and path; both empty for null or without ``://``."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    host = F.translate(F.regexp_extract(url, pattern, 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(url, pattern, 2), F.lit(""))


def longest_rule(rules=RULES) -> tuple[F.Column, F.Column]:
    """The longest fitting rule's text and verdict, null if none fits; of equal lengths the first given."""
    rule = verdict = F.lit(None).cast("string")
    for host, path, what in sorted(rules, key=lambda r: len(r[0]) + len(r[1])):
        fits = ((F.col("host") == host) | F.col("host").endswith(f".{host}")) & F.col("path").startswith(path)
        rule = F.when(fits, host + path).otherwise(rule)
        verdict = F.when(fits, what).otherwise(verdict)
    return rule, verdict


def word_counts(pages: DataFrame, limit: int = VOCABULARY) -> dict[str, int]:
    """Counts of the words of all pages, tags left out; the ``limit`` most frequent ones."""
    plain = F.lower(F.regexp_replace(F.col("html"), r"(?s)<[^>]*>", " "))
    words = pages.select(F.explode(F.split(plain, r"[^a-z]+")).alias("word")).where(F.length("word").between(2, LONGEST))
    top = words.groupBy("word").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "word").limit(limit)
    return {r["word"]: r["n"] for r in top.collect()}


class Segmenter:
    """Cuts joined names into words: the most likely sequence under unigram counts (Viterbi).

    A run of letters outside the vocabulary costs as much as a rare word, and more
    for every letter, so that it stays whole rather than fall into letters.
    """

    def __init__(self, counts: dict[str, int]):
        total = sum(counts.values()) + 1
        self.cost = {w: -math.log(n / total) for w, n in counts.items()}
        self.unknown = math.log(total) + 2.0
        self.longest = max(map(len, counts), default=1)
        self.cut = lru_cache(maxsize=50_000)(self._cut)

    def _cut(self, name: str) -> tuple[str, ...]:
        size = len(name)
        best = [0.0] + [math.inf] * size
        start = [0] * (size + 1)
        for j in range(1, size + 1):
            for i in range(max(0, j - self.longest), j):
                cost = best[i] + self.cost.get(name[i:j], math.inf)
                if cost < best[j]:
                    best[j], start[j] = cost, i
            # any run of letters is a possible unknown word; from i on, each letter costs the same
            for i in range(max(0, j - LONGEST), j):
                cost = best[i] + self.unknown + 1.5 * (j - i)
                if cost < best[j]:
                    best[j], start[j] = cost, i
        out, j = [], size
        while j:
            out.append(name[start[j] : j])
            j = start[j]
        return tuple(reversed(out))

    def words(self, text: str) -> list[str]:
        return [w for name in _WORD.findall(text.lower()) for w in self.cut(name)]


class NaiveBayes:
    """Multinomial naive Bayes with add-one counts; words never seen in an example say nothing."""

    def __init__(self, examples: dict[str, tuple[str, ...]], prior: float = ALLOW_PRIOR):
        counts = {k: {} for k in ("allow", "block")}
        for kind in counts:
            for text in examples.get(kind, ()):
                for w in text.split():
                    counts[kind][w] = counts[kind].get(w, 0) + 1
        known = set(counts["allow"]) | set(counts["block"])
        size = {k: sum(c.values()) + len(known) for k, c in counts.items()}
        self.bias = math.log((1 - prior) / prior)
        self.weight = {w: math.log((counts["block"].get(w, 0) + 1) / size["block"])
                       - math.log((counts["allow"].get(w, 0) + 1) / size["allow"]) for w in known}

    def block_odds(self, words: list[str]) -> float:
        return self.bias + sum(self.weight.get(w, 0.0) for w in words)


def judge(pages: DataFrame, counts: dict[str, int], rules=RULES, examples=None, prior: float = ALLOW_PRIOR) -> DataFrame:
    """``pages`` with host, path, rule, verdict, words and block_odds.

    A fitting rule decides; else naive Bayes over the words of host and path, with
    block at odds above zero. The words of the top two host labels and of leading
    www, m and blog labels are words like any other. Null urls, and those without
    ``://``, have empty parts, no words, and the prior's verdict. Very long urls are
    cut label by label, whole. Input columns of the added names are replaced.
    """
    examples = examples or EXAMPLES
    boost = max(counts.values(), default=1)
    # example words are words of the vocabulary even where no page has them
    vocabulary = dict(counts)
    for text in (t for texts in examples.values() for t in texts):
        for w in text.split():
            vocabulary[w] = max(vocabulary.get(w, 0), boost)
    sent = pages.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segmenter, bayes = Segmenter(sent.value), NaiveBayes(examples, prior)
        for batch in batches:
            words = [
                segmenter.words(h) + segmenter.words(p)
                for h, p in zip(batch.column("host").to_pylist(), batch.column("path").to_pylist(), strict=True)
            ]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(words, pa.list_(pa.string())), pa.array([bayes.block_odds(w) for w in words], pa.float64())],
                names=[*batch.schema.names, "words", "block_odds"])

    pages = pages.drop("host", "path", "rule", "verdict", "words", "block_odds")
    host, path = parts(F.col("url"))
    cut = pages.withColumn("host", host).withColumn("path", path)
    judged = cut.mapInArrow(run, T.StructType([
        *cut.schema.fields, T.StructField("words", T.ArrayType(T.StringType())), T.StructField("block_odds", T.DoubleType())]))
    rule, verdict = longest_rule(rules)
    own = F.when(F.col("block_odds") > 0, "block").otherwise("allow")
    return judged.withColumn("rule", rule).withColumn("verdict", F.coalesce(verdict, own))
