"""Toxicity by a weighted lexicon, matched by Aho-Corasick on folded text."""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import text_slices

#: Labelled documents that the lexicon is learned from, at most (those of the smallest digests).
TRAIN_ROWS = 20_000
#: Entries of a lexicon, at most: the most significant ones.
LEXICON = 5_000
#: Log-likelihood ratio and log odds that an entry needs.
LEAST_RATIO, LEAST_ODDS = 22.0, 3.0
STEM = range(3, 11)

# Letters that look like Latin ones, and signs written for letters inside a word.
HOMOGLYPHS = str.maketrans(
    "аеорсухіјѕԁкмтвн"
    "αεορυκιντı",
    "aeopcyxijsdkmtbhaeopukivti",
)
SUBSTITUTES = str.maketrans("013457@$!|", "oieastasil")
# Harmless phrases around words that may be entries.
EXCEPTIONS = ("trash can", "trash cans", "trash bag", "trash bags", "trash bin", "clown fish", "clown car", "class clown",
              "stupid question", "stupid mistake", "pond scum", "soap scum")

_MIXED = re.compile(r"[^\W\d_][013457@$|]|[013457@$!|][^\W\d_]")
_TOKEN = re.compile(r"[\w@$!|]+")
_LETTER = re.compile(r"[^\W\d_]")
_MARKS = re.compile("[\u0300-\u036f\u00ad\u200b-\u200f\u2060\ufeff]")
_NOT_LETTER = re.compile(r"[\W\d_]+")


def fold(text: str | None) -> str:
    """Letters only, in lower case, one space before and after every word.

    Compatibility forms and look-alikes become Latin letters, digits and signs inside
    words the letters they stand for; combining marks and zero-width signs go, other
    accents stay. Null is empty.
    """
    if not text:
        return " "
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
        text = _MARKS.sub("", text)
        text = text.casefold().translate(HOMOGLYPHS)
    else:
        text = text.lower()
    if _MIXED.search(text):
        text = _TOKEN.sub(_letters, text)
    return f" {_NOT_LETTER.sub(' ', text).strip()} "


def _letters(token: re.Match) -> str:
    word = token.group()
    return word.rstrip("!|").translate(SUBSTITUTES) if _LETTER.search(word) else word


@dataclass
class ToxicityModel:
    """Word stems with weights, harmless phrases, and the coefficients of the score."""

    lexicon: dict[str, float] = field(default_factory=dict)
    exceptions: tuple[str, ...] = EXCEPTIONS
    bias: float = -4.0
    coefficients: tuple[float, float] = (1.0, 1.0)

    def automaton(self):
        found = ahocorasick.Automaton()
        for stem, weight in self.lexicon.items():
            found.add_word(f" {stem}", (len(stem), weight))
        for phrase in self.exceptions:
            # an exception takes back the weight of the entries that it holds
            folded = fold(phrase)
            inside = sum(w for s, w in self.lexicon.items() if f" {s}" in folded)
            if inside:
                found.add_word(folded, (0, -inside))
        found.make_automaton()
        return found


def _measure(automaton, text: str | None) -> tuple[float, float, int]:
    """Summed weight, the same normalised by length, and the number of matches."""
    folded = fold(text)
    total, hits = 0.0, 0
    if len(automaton):
        for _, (size, weight) in automaton.iter(folded):
            total += weight
            hits += 1 if size else -1
    total = max(0.0, total)
    words = folded.count(" ")
    return math.log1p(total), math.log1p(1000 * total / (words + 20)), max(0, hits)


def _words(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, toxic documents, clean documents) of each slice: counted before they are shuffled."""
    for batch in batches:
        for part in text_slices(batch, 8_000_000):
            counts: dict[str, list[int]] = {}
            for text, toxic in zip(part.column("text").to_pylist(), part.column("toxic").to_pylist(), strict=True):
                for word in set(fold(text).split()):
                    counts.setdefault(word, [0, 0])[0 if toxic else 1] += 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(counts), pa.string()), pa.array([c[0] for c in counts.values()], pa.int64()),
                 pa.array([c[1] for c in counts.values()], pa.int64())], names=["word", "t", "c"])


def held_out(doc_id: str = "doc_id") -> F.Column:
    """The fifth of documents that is never learned from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> ToxicityModel:
    """Learn a lexicon and the score from at most ``rows`` labelled documents.

    Documents are those labelled 0 or 1, not held out, of the smallest digests of
    their ids. A word's stem (3 to 10 letters, or the whole word) is an entry if it
    is far more frequent in toxic documents; its weight is its log odds. A stem
    that a kept shorter one covers is left out. A logistic fit on the summed weight
    and the summed weight by length gives the score. With labels of one kind or
    none, the lexicon is empty and every score is low.
    """
    named = (
        labels.where("toxic in (0, 1) and doc_id is not null")
        .where(~held_out())
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("toxic"))
        .orderBy(F.md5(F.col("doc_id").cast("string").cast("binary")), "doc_id")
        .limit(rows)
    )
    sample = docs.select("doc_id", "text").join(F.broadcast(named), "doc_id").select("text", "toxic")
    total = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if not total.get(1) or not total.get(0):
        return ToxicityModel()
    words = sample.mapInArrow(_words, "word string, t long, c long").groupBy("word").agg(F.sum("t").alias("t"), F.sum("c").alias("c"))
    stems = (
        words.select(F.explode(F.expr(
            f"array_distinct(transform(sequence({STEM[0]}, {STEM[-1]}), n -> substring(word, 1, n)))")).alias("stem"), "t", "c")
        .where(F.length("stem") >= STEM[0])
        .groupBy("stem")
        .agg(F.sum("t").alias("t"), F.sum("c").alias("c"))
    )
    n1, n0 = float(total[1]), float(total[0])
    share = n1 / (n1 + n0)
    both = F.col("t") + F.col("c")

    def term(seen: F.Column, expected: F.Column) -> F.Column:
        return F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)

    ratio = 2 * (term(F.col("t"), both * share) + term(F.col("c"), both * (1 - share)))
    odds = F.log((F.col("t") + 0.5) / (n1 + 1)) - F.log((F.col("c") + 0.5) / (n0 + 1))
    entries = (
        stems.withColumn("ratio", ratio).withColumn("odds", odds)
        .where((F.col("ratio") >= LEAST_RATIO) & (F.col("odds") >= LEAST_ODDS))
        .orderBy(F.desc("ratio"), F.desc(F.length("stem")), "stem").limit(LEXICON).collect()
    )
    lexicon: dict[str, float] = {}
    for r in entries:
        stem = r["stem"]
        if not any(stem.startswith(k) or k.startswith(stem) for k in lexicon):
            lexicon[stem] = r["odds"]
    model = ToxicityModel(lexicon)
    got = _scored(sample.withColumn("doc_id", F.lit(0)), model).select("toxic", "__a", "__b").collect()
    x = np.array([[1.0, r["__a"], r["__b"]] for r in got])
    model.bias, *rest = _logistic(x, np.array([float(r["toxic"]) for r in got]))
    model.coefficients = tuple(rest)
    return model


def _logistic(x: np.ndarray, y: np.ndarray) -> list[float]:
    """Ridge logistic regression by Newton steps, on the bounded sample."""
    beta, ridge = np.zeros(x.shape[1]), np.diag([1e-3, 0.1, 0.1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (y - p) - ridge @ beta)
        beta += step
        if np.abs(step).max() < 1e-8:
            break
    return beta.tolist()


def _scored(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = sent.value.automaton()
        for batch in batches:
            for part in text_slices(batch, 8_000_000):
                got = [_measure(automaton, t) for t in part.column("text").to_pylist()]
                a, b, n = zip(*got, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(a, pa.float64()), pa.array(b, pa.float64()), pa.array(n, pa.int32())],
                    names=[*part.schema.names, "__a", "__b", "n_hits"])

    docs = docs.drop("__a", "__b", "n_hits")
    return docs.mapInArrow(run, T.StructType([
        *docs.schema.fields, T.StructField("__a", T.DoubleType()), T.StructField("__b", T.DoubleType()),
        T.StructField("n_hits", T.IntegerType())]))


def score(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """``docs`` with ``score`` (0 to 1), ``predicted`` (1 from 0.5 on) and ``n_hits``.

    The text alone decides. Null and empty texts get the score of a text without
    matches; repeated rows score alike; input columns of the added names are replaced.
    """
    docs = docs.drop("score", "predicted")
    z = F.lit(model.bias) + F.col("__a") * model.coefficients[0] + F.col("__b") * model.coefficients[1]
    return (
        _scored(docs, model)
        .withColumn("score", 1 / (1 + F.exp(-z)))
        .withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
        .drop("__a", "__b")
    )
