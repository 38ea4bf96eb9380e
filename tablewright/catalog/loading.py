"""Registered queries: tables written as text files by Spark and loaded again."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import shared_scratch
from ..sources.readers import load_table
from .base import Query, table


def _place(spark, ending):
    return f"{shared_scratch(spark)}/load-{uuid.uuid4().hex}.{ending}"


def _documents(spark, folder) -> DataFrame:
    """Texts with quotes, delimiters and line breaks of their own; empty ones left out, as text files do not tell them from missing ones."""
    text = F.concat(F.lit("<"), F.coalesce("text", F.lit("")), F.lit(">"))
    return table(spark, folder, "documents").select("doc_id", text.alias("text"), "lang", "n_chars")


DOCUMENTS_SQL = "SELECT doc_id, '<' || coalesce(text, '') || '>' AS text, lang, n_chars FROM documents"


def _delimited(ending: str, sep: str):
    def run(spark, folder):
        path = _place(spark, ending)
        rows = _documents(spark, folder)
        writer = rows.write.option("header", True).option("sep", sep).option("quote", '"').option("escape", '"')
        writer.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
        found = load_table(spark, path, require_rows=False)
        return found.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col("lang").cast("string"), F.col("n_chars").cast("long"))

    return run


def _as_arrays(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The lines of one file: an array with a record a line."""
    before = "["
    for batch in batches:
        for start in range(0, len(batch), 1000):
            lines = []
            for line in batch.column(0).slice(start, 1000).to_pylist():
                lines.append(before + line)
                before = ","
            yield pa.RecordBatch.from_arrays([pa.array(lines, pa.string())], names=["value"])
    yield pa.RecordBatch.from_arrays([pa.array(["]" if before == "," else "[]"])], names=["value"])


def _json(arrays: bool):
    def run(spark, folder):
        path = _place(spark, "json")
        lines = _documents(spark, folder).select(F.to_json(F.struct("*")).alias("value"))
        (lines.mapInArrow(_as_arrays, "value string") if arrays else lines).write.text(path)
        return load_table(spark, path, require_rows=False).select("doc_id", "text", "lang", "n_chars")

    return run


def _xml(spark, folder):
    path = _place(spark, "xml")
    table(spark, folder, "customer").select("c_custkey", "c_name", "c_acctbal").write.format("xml").option("rowTag", "row").save(path)
    found = load_table(spark, path)
    return found.select(F.col("c_custkey").cast("long"), "c_name", F.col("c_acctbal").cast("double"))


QUERIES = [
    Query("load_csv", _delimited("csv", ","), DOCUMENTS_SQL),
    Query("load_tsv", _delimited("tsv", "\t"), DOCUMENTS_SQL),
    Query("load_json_lines", _json(False), DOCUMENTS_SQL),
    Query("load_json_array", _json(True), DOCUMENTS_SQL),
    Query("load_xml", _xml, "SELECT c_custkey, c_name, c_acctbal FROM customer"),
]
