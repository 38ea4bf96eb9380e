"""N-gram Jaccard join by prefixes of token combinations."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shingles as S
from .common import kept_in, text_slices, written
from .links import link, size_classes

WORDS = 3
PERCENT = 90
#: A shingle in the plain prefixes of so many documents counts as frequent ...
FREQUENT = 2
#: ... by a map of so many bits (8 MB), which is broadcast. Shingles that share a bit are of
#: one class; any choice of classes gives the same links, a good one keeps candidates few.
MAP_BITS = 26
#: Bytes of texts whose shingles a worker holds at once (or one longer text).
SLICE = 500_000


def slack(n: np.ndarray | int, percent: int = PERCENT):
    """How many shingles a set of n may have that a linked set lacks."""
    return n - -(-n * percent // 100)


def _document_sets(part: pa.RecordBatch, words: int) -> tuple[np.ndarray, np.ndarray]:
    found = S.words(part.column("text"))
    return S.sets(*S.shingles(found.hashes, found.first, words))


def _plain_prefixes(words: int, percent: int):
    """(token, n): how often each shingle stands in the plain prefix of a document, counted a slice at a time."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, SLICE):
                values, begin = _document_sets(part, words)
                n = np.diff(begin)
                own = np.arange(len(values)) - np.repeat(begin[:-1], n)
                token, count = np.unique(values[own <= np.repeat(slack(n, percent), n)], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(token.view(np.int64)), pa.array(count)], names=["token", "n"])

    return run


def frequent_map(words: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """The map of frequent shingles, from its words that are not zero."""
    out = np.zeros(1 << (MAP_BITS - 6), np.uint64)
    out[words] = bits.view(np.uint64)
    return out


def _levels(n: int, percent: int) -> list[int]:
    """The subclass counts at which a set of n shingles must be found by sets no larger and no smaller than may link."""
    own = (slack(n, percent) + 1).bit_length() - 1
    upper = (slack(n * 100 // percent, percent) + 1).bit_length() - 1
    return sorted({own, upper})


def signatures(tokens: np.ndarray, frequent: np.ndarray, percent: int) -> np.ndarray:
    """The bucket names of one set: single rare shingles and pairs of frequent ones.

    Shingles are ordered rare ones first, then frequent ones, each by fingerprint.
    With t + 1 rare ones (t: ``slack``) the prefix is these, and any linked set
    shares one of them if its own prefix reaches as far. With fewer, the prefix is
    extended by frequent ones, which are dealt to 2^level subclasses by their
    fingerprint: a subclass with m of them can lack m - 1 before two are shared, so
    the prefix grows until the rare ones and all m - 1 add up to t + 1. Two linked
    sets then share a rare shingle or two frequent ones of a subclass. The level
    follows the size, so the pairs stay in proportion to the prefix; a set uses its
    own level and the one that a larger linked set may have.
    """
    need = int(slack(len(tokens), percent)) + 1
    bit = tokens & np.uint64((1 << MAP_BITS) - 1)
    common = (frequent[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63)) & np.uint64(1)).astype(bool)
    rare = tokens[~common]
    if len(rare) >= need:
        return rare[:need]
    out, rest = [rare], tokens[common]
    for level in _levels(len(tokens), percent):
        kind = (S.mix(rest) & np.uint64((1 << level) - 1)).astype(np.int64)
        order = np.argsort(kind, kind="stable")
        again = np.ones(len(rest), bool)
        again[order[np.concatenate([[True], kind[order][1:] != kind[order][:-1]])[: len(order)]]] = False
        gain = np.cumsum(again)
        size = int(np.searchsorted(gain, need - len(rare))) + 1
        taken, kind = rest[:size], kind[:size]
        order = np.argsort(kind, kind="stable")
        taken, kind = taken[order], kind[order]
        for gap in range(1, len(taken)):
            same = kind[gap:] == kind[:-gap]
            if not same.any():
                break
            a, b = taken[:-gap][same], taken[gap:][same]
            out.append(S.mix(np.minimum(a, b) * S._STEP[3] + np.maximum(a, b) * S._STEP[4] + np.uint64(level)))
    return np.concatenate(out)


def _signed(words: int, percent: int, frequent):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common = frequent.value
        least = -(-percent // (100 - percent)) if percent < 100 else 1
        for batch in batches:
            for part in text_slices(batch, SLICE):
                values, begin = _document_sets(part, words)
                n = np.diff(begin)
                names = S.set_names(values, begin)
                # a smaller set can link with none but an equal one
                signed = [
                    signatures(values[a:b], common, percent) if b - a >= least else values[:0]
                    for a, b in zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True)
                ]
                ends = np.concatenate([[0], np.cumsum([len(s) for s in signed])])
                flat = np.concatenate(signed) if signed else values[:0]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(n.astype(np.int64)), pa.array(names), S.lists(flat, ends)],
                    names=["doc_id", "n_shingles", "item", "buckets"])

    return run


def _sets(words: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, SLICE):
                values, begin = _document_sets(part, words)
                yield pa.RecordBatch.from_arrays([pa.array(S.set_names(values, begin)), S.lists(values, begin)], names=["item", "tokens"])

    return run


def jaccard_components(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One row a document: doc_id, n_shingles, component_id.

    A document's set holds its distinct shingles of ``words`` words (see ``shingles``);
    documents link if 100 * intersection >= ``percent`` * union, and the component is
    the smallest doc_id reachable by links. Equal sets are one item first, so copies
    cost a row each; items meet by ``signatures`` and are verified on their whole
    sets. Documents without words, or with a null text, have an empty set and link
    with nothing. Rows of a null doc_id are counted, and their component is null
    unless they have copies or links; repeated rows are rows of their own; an empty
    table gives none. Other columns are not read.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    counted = docs.select("text").mapInArrow(_plain_prefixes(words, percent), "token long, n long")
    often = counted.groupBy("token").agg(F.sum("n").alias("n")).where(F.col("n") >= FREQUENT)
    bit = F.col("token").bitwiseAND(F.lit((1 << MAP_BITS) - 1))
    mask = F.call_function("shiftleft", F.lit(1).cast("long"), bit.bitwiseAND(F.lit(63)).cast("int"))
    # a row for each word of the map, at most
    found = often.groupBy(F.shiftright(bit, 6).alias("word")).agg(F.bit_or(mask).alias("bits")).toArrow()
    frequent = frequent_map(found.column("word").to_numpy(), found.column("bits").to_numpy())
    sent = spark.sparkContext.broadcast(frequent)
    signed = written(docs.mapInArrow(_signed(words, percent, sent), "doc_id long, n_shingles long, item long, buckets array<long>"))
    buckets = signed.select(F.explode("buckets").alias("bucket"), "item", F.col("n_shingles").alias("size"))
    items = signed.where("n_shingles > 0").groupBy("item").agg(F.min("doc_id").alias("least"))

    # only buckets with two different items of like size matter; they are few, and kept
    shared = buckets.groupBy("bucket").agg(F.min("item").alias("lo"), F.max("item").alias("hi")).where("lo <> hi").select("bucket")
    met = written(size_classes(written(kept_in(buckets, written(shared), "bucket").distinct()), percent))
    sources = written(met.select("item").distinct().join(items, "item").select("item", F.col("least").alias("doc_id")))
    wanted = written(sources.select("doc_id").distinct())
    repeated = kept_in(docs.select("doc_id"), wanted, "doc_id").count() > wanted.count()  # rows that repeat a doc_id

    def sets(keys: DataFrame) -> DataFrame:
        """Sets are made again from the texts where they are needed; a table of all would outweigh the texts."""
        asked = written(sources.join(keys, "item").select("doc_id").distinct())
        found = kept_in(docs, asked, "doc_id").mapInArrow(_sets(words), "item long, tokens array<long>")
        return kept_in(found, keys, "item").dropDuplicates(["item"]) if repeated else found

    _, reach = link(met, sets, percent)
    named = items.join(reach.withColumnRenamed("id", "item"), "item", "left").select(
        "item", "least", F.coalesce("component_id", "item").alias("group"))
    groups = named.groupBy("group").agg(F.min("least").alias("component_id"))
    labels = named.join(groups, "group").select("item", "component_id")
    full, empty = signed.where("n_shingles > 0"), signed.where("n_shingles = 0")
    return (
        full.select("doc_id", "n_shingles", "item").join(labels, "item").select("doc_id", "n_shingles", "component_id")
        .unionAll(empty.select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))
    )


def one_of_each(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """``docs`` without the documents that are near copies of one with a smaller id.

    Of each component the smallest doc_id stays; rows that repeat a doc_id stay or
    go together, and rows without doc_id stay.
    """
    gone = jaccard_components(docs, words, percent).where("doc_id <> component_id").select("doc_id").distinct()
    return kept_in(docs, written(gone), "doc_id", "left_anti").select(*docs.columns)
