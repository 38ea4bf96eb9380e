"""The registered queries of the corpus operators, and their SQL twins."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    ann,
    bpe,
    embedding_dedup,
    fingerprints,
    hard_negatives,
    jaccard_join,
    mixing,
    paragraph_dedup,
    periodic_runs,
    pii,
    sharding,
    toxicity,
    url_filter,
)
from .common import table

VOCABULARY = "byte_bpe_50k.tiktoken"


def op1_pii(spark: SparkSession, folder: str) -> DataFrame:
    found = pii.find_spans(table(spark, folder, "documents").select("doc_id", "text"))

    def count(kind: str):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id",
        *map(count, pii.BASE),
        F.sha2(pii.written_spans(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        pii.written_spans(F.col("spans")).alias("spans"),
    )


def op2_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    model = toxicity.learn(docs, table(spark, folder, "labels"))
    return toxicity.score(docs, model).select("doc_id", toxicity.held_out().alias("held_out"), "score", "predicted")


def op3_ngram_jaccard(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard_join.jaccard_components(table(spark, folder, "documents"))


def op4_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    path = public_tokenizers.path(VOCABULARY)
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return bpe.round_trip(docs, path, public_tokenizers.PATTERN).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op5_embedding_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, folder, "embeddings"))


def op6_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages")
    judged = url_filter.judge(pages.select("page_id", "url"), url_filter.word_counts(pages))
    return judged.select("page_id", "host", "path", "rule", "verdict", F.array_join("words", " ").alias("words"))


def op7_sharding(spark: SparkSession, folder: str) -> DataFrame:
    shards = sharding.shard_documents(table(spark, folder, "documents").select("doc_id", "text"))
    return shards.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def op8_nearest_vectors(spark: SparkSession, folder: str) -> DataFrame:
    return ann.nearest(table(spark, folder, "embeddings"), F.col("vec_id") % 100 == 0)


def op9_source_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix_sources(table(spark, folder, "documents"))


def op10_repeated_passages(spark: SparkSession, folder: str) -> DataFrame:
    return paragraph_dedup.repeated_passages(table(spark, folder, "documents"))


def op11_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    made = fingerprints.edited_fingerprints(table(spark, folder, "documents"))
    own, edited, after = (F.col(c) for c in ("sketch", "edited_sketch", "next_sketch"))
    return made.select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        fingerprints.spelled(own).alias("fingerprint"),
        fingerprints.spelled(edited).alias("edited_fingerprint"),
        fingerprints.resemblance(own, edited).alias("near_edited"),
        fingerprints.resemblance(own, after).alias("near_next"),
        fingerprints.containment(own, edited).alias("contained_in_edited"),
        fingerprints.containment(own, after).alias("contained_in_next"),
    )


def _with_planted_period(docs: DataFrame) -> DataFrame:
    """The contract's texts: in a tenth of the documents (by CRC) the words from ``a`` on repeat with period ``p``."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    rows = docs.select("doc_id", "text", h.alias("h"), F.floor(h / 10).alias("g"))
    words = F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]++"), F.lit(0))

    def repeated(w: F.Column) -> F.Column:
        n, g = F.size(w), F.col("g")
        a = g % n
        p = F.floor((n - a) / (3 + g % 8)) + 1
        place = lambda i: F.when(i < a, i).otherwise(a + (i - a) % p)
        made = F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(w, place(i).cast("int"))), " ")
        return F.when(n > 0, made).otherwise(F.col("text"))

    text = F.when(F.col("h") % 10 == 0, F.transform(F.array(words), repeated)[0]).otherwise(F.col("text"))
    return rows.select("doc_id", text.alias("text"))


def op12_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    found = periodic_runs.periodic_runs(_with_planted_period(table(spark, folder, "documents")))
    top = periodic_runs.longest(F.col("runs"))
    found = found.select("doc_id", "runs", "collapsed", top.alias("top"))
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "top.start",
        "top.length",
        "top.period",
        F.floor(F.col("top.length") * 1000 / F.col("top.period")).alias("exponent_milli"),
        F.sha2(periodic_runs.written_runs(F.col("runs")).cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


def op13_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "embeddings")
    whole = F.transform("embedding", lambda x: F.floor(256 * x.cast("double")))
    odd = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = rows.where(F.coalesce(~odd, F.lit(False))).select("vec_id", label.alias("label"), whole.alias("embedding"))
    return hard_negatives.mine(rows, F.col("vec_id") % 50 == 0)


QUERIES = {
    f.__name__: f
    for f in (op1_pii, op2_toxicity, op3_ngram_jaccard, op4_byte_bpe, op5_embedding_dedup, op6_url_filter, op7_sharding,
              op8_nearest_vectors, op9_source_mixing, op10_repeated_passages, op11_fingerprints, op12_periodic_runs,
              op13_hard_negatives)
}
ORACLES = {
    "op9_source_mixing": mixing.ORACLE_SQL,
    "op11_fingerprints": fingerprints.ORACLE_SQL,
    "op13_hard_negatives": hard_negatives.ORACLE_SQL,
}
