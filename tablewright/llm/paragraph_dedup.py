"""Repeated passages: paragraph MinHash banding, exact verification, clusters of removals."""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import shingles as S
from .common import components, kept_in, text_slices, written
from .links import link, size_classes

WORDS = 5
PERCENT = 80
#: Words of the shortest paragraph or passage that counts as repeated text.
LEAST_WORDS = 24
#: Words of the shortest sentence that may be part of a repeated passage.
LEAST_SENTENCE = 4
#: Share of pairs at the threshold that may agree in no band.
MISSED = 5e-4
MOST_BANDS = 8
_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def tune_bands(similarity: float, missed: float = MISSED, most: int = MOST_BANDS) -> tuple[int, int]:
    """(bands, rows): the most selective bands, at most ``most`` of them, that miss at most ``missed``."""
    rows = 1
    while True:
        bands = math.ceil(math.log(missed) / math.log(1 - similarity ** (rows + 1)))
        if bands > most:
            return math.ceil(math.log(missed) / math.log(1 - similarity**rows)), rows
        rows += 1


def _band_names(values: np.ndarray, begin: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """The name of each band of each unit's MinHash signature: units by bands."""
    factors = np.random.default_rng(5).integers(1, 2**63, bands * rows, dtype=np.uint64) | np.uint64(1)
    out = np.zeros((len(begin) - 1, bands), np.uint64)
    for j, factor in enumerate(factors):
        least = np.minimum.reduceat(values * factor, begin[:-1]) if len(values) else out[:0, 0]
        out[:, j // rows] = S.mix(out[:, j // rows] ^ least) + np.uint64(j)
    return out


def _units(percent: int, least: int):
    """Each document's paragraphs (lines of at least ``least`` words) and its sentences, with their names."""
    bands, rows = tune_bands(percent / 100)

    def nested(owner: np.ndarray, count: int, fields: dict[str, pa.Array]) -> pa.ListArray:
        ends = np.searchsorted(owner, np.arange(count + 1))
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(list(fields.values()), list(fields)))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch):
                w = S.words(part.column("text"), places=True)
                total, texts = len(w.hashes), len(part)
                new_line = np.ones(total, bool)
                new_line[1:] = w.line[1:] != w.line[:-1]
                new_line[w.first[:-1][w.first[:-1] < total]] = True
                new_sentence = new_line.copy()
                new_sentence[1:] |= w.ends[:-1]
                line, sentence = np.flatnonzero(new_line), np.flatnonzero(new_sentence)
                size = np.diff(np.append(line, total))
                owner = np.searchsorted(w.first, line, "right") - 1
                long = size >= least
                # runs of words of long lines only: their shingles, sets, names and bands
                keep = np.repeat(long, size)
                begin = np.concatenate([[0], np.cumsum(size[long])])
                values, at = S.sets(*S.shingles(w.hashes[keep], begin, WORDS))
                paragraphs = nested(owner[long], texts, {
                    "first": pa.array((line[long] - w.first[owner[long]]).astype(np.int32)),
                    "n": pa.array(size[long].astype(np.int32)),
                    "item": pa.array(S.set_names(values, at)),
                    "size": pa.array(np.diff(at)),
                    "bands": pa.ListArray.from_arrays(
                        pa.array(np.arange(len(at), dtype=np.int32) * bands),
                        pa.array(_band_names(values, at, bands, rows).view(np.int64).ravel())),
                })
                size = np.diff(np.append(sentence, total))
                place = np.arange(total) - np.repeat(sentence, size)
                power = np.multiply.accumulate(np.full(int(size.max()) if total else 1, S._STEP[6]))
                name = S.mix(np.add.reduceat(w.hashes * power[place], sentence) + size.astype(np.uint64)) if total else w.hashes
                owner = np.searchsorted(w.first, sentence, "right") - 1
                of_line = line[np.searchsorted(line, sentence, "right") - 1] if total else sentence
                some = size >= LEAST_SENTENCE
                start = w.first[owner[some]]
                sentences = nested(owner[some], texts, {
                    "first": pa.array((sentence[some] - start).astype(np.int32)),
                    "n": pa.array(size[some].astype(np.int32)),
                    "line": pa.array((of_line[some] - start).astype(np.int32)),
                    "name": pa.array(name[some].view(np.int64)),
                })
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), paragraphs, sentences], names=["doc_id", "paragraphs", "sentences"])

    return run


def _paragraph_sets(least: int):
    """(item, tokens) of the paragraphs of the documents given."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch):
                w = S.words(part.column("text"), places=True)
                total = len(w.hashes)
                new = np.ones(total, bool)
                new[1:] = w.line[1:] != w.line[:-1]
                new[w.first[:-1][w.first[:-1] < total]] = True
                size = np.diff(np.append(np.flatnonzero(new), total))
                long = size >= least
                values, at = S.sets(*S.shingles(w.hashes[np.repeat(long, size)], np.concatenate([[0], np.cumsum(size[long])]), WORDS))
                yield pa.RecordBatch.from_arrays([pa.array(S.set_names(values, at)), S.lists(values, at)], names=["item", "tokens"])

    return run


_SCHEMA = (
    "doc_id long, paragraphs array<struct<first: int, n: int, item: long, size: long, bands: array<long>>>,"
    " sentences array<struct<first: int, n: int, line: int, name: long>>"
)


def _parts(placed: DataFrame, least: int) -> DataFrame:
    """Passages cut where removed sentences meet kept ones; fewer than ``least`` words that are found elsewhere stay."""
    run = ["doc_id", "from", "component_id"]
    in_order = Window.partitionBy(*run).orderBy("first")

    def numbered(rows: DataFrame) -> DataFrame:
        changed = F.coalesce(F.col("gone") != F.lag("gone").over(in_order), F.lit(False))
        return rows.withColumn("part", F.sum(changed.cast("int")).over(in_order))

    words = F.sum("n").over(Window.partitionBy(*run, "part"))
    parts = numbered(numbered(placed).withColumn("gone", F.col("gone") & (words >= least)))
    return parts.groupBy(*run, "part").agg(
        F.min("first").alias("first_word"), F.max(F.col("first") + F.col("n")).alias("to"), F.first("gone").alias("removed")
    ).select("doc_id", F.lit("passage").alias("kind"), "first_word", (F.col("to") - F.col("first_word")).alias("n_words"), "component_id", "removed")


def repeated_passages(docs: DataFrame, percent: int = PERCENT, least: int = LEAST_WORDS) -> DataFrame:
    """doc_id, kind, first_word, n_words, component_id, removed: text that documents share.

    A paragraph is a line of at least ``least`` words. Paragraphs that agree in a band
    of their MinHash signature (bands tuned so that at most MISSED of the pairs at the
    threshold are lost) are verified: their sets of five-word shingles need a Jaccard
    similarity of ``percent`` / 100. Equal sets are one item first. The components of
    the links are the clusters; a cluster in two documents or more is repeated text.

    A passage copied into the middle of a line shares no line with its source. So,
    in the lines that are not repeated as a whole, sentences found word for word in
    another document are put together, and a run of at least ``least`` words is a
    passage. Passages that share a sentence are one cluster, and one with the
    repeated paragraphs that hold it.

    Among linked paragraphs the place of the smallest (doc_id, first_word) stays, the
    others have ``removed``. In passages this is decided sentence by sentence, so that
    a copy of each one stays: in a paragraph that stays, else at its smallest place;
    at least ``least`` words in a row that stay elsewhere are removed. A passage of
    which a part is removed is reported in parts. component_id is the smallest doc_id
    of the cluster.
    Word numbers count from 0, n_words covers the whole run. Repetition inside one
    document alone does not count, nor do rows that repeat a doc_id. Null and empty
    texts have no paragraphs; rows without doc_id are left out; an empty table gives
    none. Other columns are not read.
    """
    docs = docs.select("doc_id", "text").where("doc_id is not null")
    units = written(docs.mapInArrow(_units(percent, least), _SCHEMA))
    lines = units.select("doc_id", F.explode("paragraphs").alias("p")).select("doc_id", "p.first", "p.n", "p.item", "p.size")
    buckets = units.select(F.explode("paragraphs").alias("p")).select(F.explode("p.bands").alias("bucket"), "p.item")
    shared = written(buckets.groupBy("bucket").agg(F.min("item").alias("lo"), F.max("item").alias("hi")).where("lo <> hi").select("bucket"))
    met = kept_in(units.select(F.explode("paragraphs").alias("p")).select(
        F.explode("p.bands").alias("bucket"), "p.item", "p.size"), shared, "bucket").distinct()
    met = written(size_classes(written(met), percent))
    asked = written(met.select("item").distinct())
    sources = kept_in(lines, asked, "item").groupBy("item").agg(F.min("doc_id").alias("doc_id"))
    sets = kept_in(docs, written(sources.select("doc_id").distinct()), "doc_id").mapInArrow(_paragraph_sets(least), "item long, tokens array<long>")
    sets = written(kept_in(sets, asked, "item").dropDuplicates(["item"]))
    _, reach = link(met, lambda keys: kept_in(sets, keys, "item"), percent)

    whole = lines.join(reach.withColumnRenamed("id", "item"), "item", "left").withColumn("group", F.coalesce("component_id", "item"))
    groups = whole.groupBy("group").agg(
        F.min(F.struct("doc_id", "first")).alias("kept"), F.max("doc_id").alias("top")).where("kept.doc_id <> top")
    paragraphs = written(
        whole.select("doc_id", "first", "n", "group").join(groups.select("group", "kept", "top"), "group")
        .select("doc_id", "first", "n", F.xxhash64(F.lit("group"), "group").alias("node"), F.col("kept.doc_id").alias("least"),
                F.col("top").alias("most"), (F.struct("doc_id", "first") != F.col("kept")).alias("removed"))
        .distinct()
    )

    parts = units.select("doc_id", F.explode("sentences").alias("s")).select("doc_id", "s.*")
    twice = written(parts.groupBy("name").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo <> hi").select("name"))
    found = kept_in(parts, twice, "name").distinct().join(
        paragraphs.select("doc_id", F.col("first").alias("line")), ["doc_id", "line"], "left_anti")
    in_order = Window.partitionBy("doc_id").orderBy("first")
    # a sentence too short to be looked up does not break a run
    apart = F.col("first") > F.lag(F.col("first") + F.col("n"), 1, -LEAST_SENTENCE).over(in_order) + LEAST_SENTENCE - 1
    run_of = found.withColumn("run", F.sum(apart.cast("int")).over(in_order))
    spans = Window.partitionBy("doc_id", "run")
    run_of = written(
        run_of.withColumn("from", F.min("first").over(spans)).withColumn("to", F.max(F.col("first") + F.col("n")).over(spans))
        .withColumn("words", F.sum("n").over(spans)).where(F.col("words") >= least)
        .select("doc_id", "from", "first", "n", "name", F.xxhash64("doc_id", "from").alias("node"))
    )
    place = F.struct("doc_id", "first")
    names = written(run_of.groupBy("name").agg(F.min("node").alias("head"), F.min(place).alias("stays"), F.max("doc_id").alias("top")))
    # the same sentences in repeated paragraphs: the whole line that stays holds the copy that stays
    lines_of = paragraphs.select("doc_id", F.col("first").alias("line"), "node", "least", "most", "removed")
    held = written(
        kept_in(parts, written(names.select("name")), "name").join(lines_of, ["doc_id", "line"])
        .groupBy("name", "node", "least", "most").agg((~F.min("removed")).alias("stands")))
    names = written(names.join(held.groupBy("name").agg(F.max("stands").alias("stands")), "name", "left"))
    elsewhere = F.coalesce("stands", F.lit(False)) | (F.col("stays.doc_id") != F.col("top")) & (place != F.col("stays"))
    placed = written(run_of.join(names, "name").select("doc_id", "from", "first", "n", "node", "head", elsewhere.alias("gone")))
    edges = placed.select("node", "head").unionAll(held.join(names, "name").select("node", "head")).where("node <> head")
    clusters = components(edges.select(F.col("node").alias("src"), F.col("head").alias("dst"))).withColumnRenamed("id", "node")
    members = placed.select("node", F.col("doc_id").alias("least"), F.col("doc_id").alias("most")).unionAll(
        held.select("node", "least", "most")).distinct().join(clusters, "node")
    heads = members.groupBy("component_id").agg(F.min("least").alias("least"), F.max("most").alias("most")).where("least <> most")
    nodes = written(members.select("node", "component_id").join(heads, "component_id").select("node", F.col("least").alias("component_id")))
    passages = _parts(placed.join(nodes, "node"), least)
    return kept_in(paragraphs, nodes, "node", "left").select(
        "doc_id", F.lit("paragraph").alias("kind"), F.col("first").alias("first_word"), F.col("n").alias("n_words"),
        F.coalesce("component_id", "least").alias("component_id"), "removed"
    ).unionAll(passages)


def without_words(text: str | None, spans: list[tuple[int, int]]) -> str | None:
    """The text without the words of the spans (first word, number of words); white space between others stays."""
    if text is None or not spans:
        return text
    gone = set()
    for first, n in spans:
        gone.update(range(first, first + n))
    out, at = [], 0
    for i, m in enumerate(_WORD.finditer(text)):
        if i in gone:
            out.append(text[at : m.start()].rstrip(" ") if i - 1 in gone else text[at : m.start()])
            at = m.end()
    return "".join([*out, text[at:]])


def without_repeats(docs: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """``docs`` with the removed paragraphs and passages cut from their texts."""
    found = repeated_passages(docs) if found is None else found
    spans = found.where("removed").groupBy("doc_id").agg(F.sort_array(F.collect_set(F.struct("first_word", "n_words"))).alias("__spans"))
    joined = docs.join(spans, "doc_id", "left").select(*[docs[c] for c in docs.columns], "__spans")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("text")
            texts = [
                without_words(t, [(s["first_word"], s["n_words"]) for s in spans or []])
                for t, spans in zip(batch.column("text").to_pylist(), batch.column("__spans").to_pylist(), strict=True)
            ]
            columns = [pa.array(texts, pa.string()) if i == at else c for i, c in enumerate(batch.columns[:-1])]
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names[:-1])

    return joined.mapInArrow(run, T.StructType(docs.schema.fields))
