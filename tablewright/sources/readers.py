"""Load a table by the extension of its path."""

from __future__ import annotations

import os
from collections import Counter

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.numeric import nan_to_null
from ..session import checkpointed
from . import splits

# The extensions a table can be loaded from.
FORMATS = ("csv", "tsv", "json", "parquet", "feather", "xml")


class EmptyTableError(ValueError):
    """The source holds no rows."""


def format_of(path: str) -> str:
    return os.path.splitext(path.rstrip("/"))[1][1:].lower()


def load_table(
    spark: SparkSession,
    path: str,
    fmt: str | None = None,
    require_rows: bool = True,
    row_tag: str = "row",
) -> DataFrame:
    """Read ``path``, tidy the header, and make NaN missing.

    Raises ``FileNotFoundError`` for a missing path, ``ValueError`` for an
    unknown extension and ``EmptyTableError`` when there are no rows.
    """
    kind = (fmt or format_of(path)).lower()
    if kind not in FORMATS:
        raise ValueError(f"Unsupported format: .{kind}")
    try:
        df = nan_to_null(strip_headers(_read(spark, path, kind, row_tag)))
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            raise FileNotFoundError(f"No table at {path}") from error
        raise
    if require_rows and df.isEmpty():
        raise EmptyTableError(f"No rows in {path}")
    return df


def _read(spark: SparkSession, path: str, kind: str, row_tag: str) -> DataFrame:
    if kind == "parquet":
        return spark.read.parquet(path)
    if kind in ("csv", "tsv"):
        return read_delimited(spark, path, "\t" if kind == "tsv" else ",")
    if kind == "json":
        return read_json(spark, path)
    if kind == "xml":
        return spark.read.format("xml").option("rowTag", row_tag).load(path)
    return read_feather(spark, path)


def strip_headers(df: DataFrame) -> DataFrame:
    """White space around column names never helps; the same name twice is told apart."""
    names = [c.strip() for c in df.columns]
    seen: Counter[str] = Counter()
    out = []
    for n in names:
        seen[n.lower()] += 1
        out.append(n if seen[n.lower()] == 1 else f"{n}.{seen[n.lower()] - 1}")
    return df if out == df.columns else df.toDF(*out)


def charset_by_file(spark: SparkSession, path: str) -> DataFrame:
    """``(file, charset, broken)``: UTF-8 where every line is valid, else ISO-8859-1.

    ``broken``: some line has an odd number of quotes, so a quoted cell holds a line
    break.  The check reads raw lines in splits and merges two booleans per file.
    """
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), "value")
    valid = F.bool_and(F.is_valid_utf8("value"))
    quotes = F.size(F.split(F.col("value"), '"', -1)) - 1
    return lines.groupBy("file").agg(
        F.when(F.coalesce(valid, F.lit(True)), "UTF-8").otherwise("ISO-8859-1").alias("charset"),
        F.bool_or(quotes % 2 == 1).alias("broken"),
    )


def read_delimited(
    spark: SparkSession, path: str, sep: str = ",", schema: T.StructType | str | None = None
) -> DataFrame:
    """CSV or TSV with header; each file is read in the charset its bytes are valid in.

    Files are read in splits, also those with line breaks inside quotes and folders of
    several charsets, whose records are cut first (see ``splits``).  Types are inferred
    once for all files, or given as ``schema``.  Columns are named by the header of the
    first file.
    """
    kinds = checkpointed(charset_by_file(spark, path))
    found = kinds.select("charset", "broken").distinct().collect()  # four at most
    if not found:
        raise EmptyTableError(f"No rows in {path}")
    reader = spark.read.option("sep", sep).option("quote", '"').option("escape", '"')
    if len(found) == 1 and not found[0]["broken"]:
        reader = reader.option("header", True).option("encoding", found[0]["charset"])
        return (reader.schema(schema) if schema is not None else reader.option("inferSchema", True)).csv(path)
    form = splits.Quoted(sep)
    raw = splits.pieces(spark, path, form).join(splits.told(kinds.withColumnRenamed("file", "path")), "path")
    latin = F.decode(F.col("value").cast("binary"), "ISO-8859-1")
    raw = raw.withColumn("value", F.when(F.col("charset") == "UTF-8", F.col("value")).otherwise(latin))
    raw = raw.withColumn("value", F.when(F.col("block") == 0, F.regexp_replace("value", "^\\x{feff}", "")).otherwise(F.col("value")))
    cut = splits.records(raw, form)
    heads = cut.filter(F.col("kind") == splits.FIRST)
    names = raw.select("path", "file").groupBy("file").agg(F.min("path").alias("path"))
    head = heads.join(names, "file").orderBy("path").select("value").limit(1)
    rows = cut.filter(F.col("kind") == splits.WHOLE).select("value")
    if schema is None:
        columns = splits.parsed(reader.option("header", True), "csv", head).columns
        plain = spark.read.option("sep", sep).option("quote", '"').option("escape", '"')
        drafted = splits.parsed(plain.option("inferSchema", True), "csv", rows).schema.fields
        types = [f.dataType for f in drafted] + [T.StringType()] * len(columns)
        schema = T.StructType([T.StructField(n, t) for n, t in zip(columns, types, strict=False)])
    plain = spark.read.option("sep", sep).option("quote", '"').option("escape", '"').schema(schema)
    return splits.parsed(plain, "csv", rows)


def _wider(a: T.DataType, b: T.DataType) -> T.DataType:
    """A type that holds the text of both."""
    if a == b or isinstance(b, T.NullType):
        return a
    if isinstance(a, T.NullType):
        return b
    order = (T.IntegerType, T.LongType, T.DoubleType)
    if isinstance(a, order) and isinstance(b, order):
        return max(a, b, key=lambda t: order.index(type(t)))
    return T.StringType()


def _together(readers: list) -> DataFrame:
    """The rows of all readers; each is given the types that fit every one of them."""
    drafts = [read(None) for read in readers]
    types: dict[str, T.DataType] = {}
    for draft in drafts:
        for f in draft.schema.fields:
            types[f.name] = _wider(types[f.name], f.dataType) if f.name in types else f.dataType
    out = None
    for read, draft in zip(readers, drafts, strict=True):
        wanted = T.StructType([T.StructField(f.name, types[f.name]) for f in draft.schema.fields])
        part = draft if wanted == draft.schema else read(wanted)
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines, or files that hold one array of records; decided file by file.

    A file of records has its first bracket at the start of a line; no line of a
    JSON lines file starts so.  Arrays are read in splits too, on one line or on many:
    their records are cut first (see ``splits``).
    """
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), "value")
    # a prefix tells, so that an array on one line is not copied
    start = F.substring("value", 1, 256)
    kinds = lines.groupBy("path").agg(F.bool_or(F.regexp_replace(start, "^[\\s\\x{feff}]+", "").startswith("[")).alias("whole"))
    kinds = checkpointed(kinds)
    found = sorted(r["whole"] for r in kinds.select("whole").distinct().collect())
    if found in ([], [False]):
        return spark.read.json(path)

    def of(df: DataFrame, whole: bool) -> DataFrame:
        return df if len(found) == 1 else df.join(splits.told(kinds.filter(F.col("whole") == whole)), "path", "left_semi")

    def read(types, whole):
        reader = spark.read if types is None else spark.read.schema(types)
        if whole:
            form = splits.Arrays()
            texts = splits.records(of(splits.pieces(spark, path, form), True), form)
        else:
            texts = of(lines, False)
        return splits.parsed(reader, "json", texts.select("value"))

    return _together([lambda types, k=k: read(types, k) for k in found])


def read_feather(spark: SparkSession, path: str) -> DataFrame:
    """Feather files, read file by file on the executors.

    Only the serialized schema of one file travels to the driver.
    """
    import pyarrow as pa
    from pyspark.sql.pandas.types import from_arrow_schema

    files = spark.read.format("binaryFile").load(path).select("content")

    def opened(batches):
        import pyarrow as pa
        import pyarrow.feather as feather

        for batch in batches:
            for blob in batch.column("content"):
                yield feather.read_table(pa.BufferReader(blob.as_buffer()), memory_map=False)

    def schemas(batches):
        import pyarrow as pa

        for found in opened(batches):
            blob = found.schema.serialize().to_pybytes()
            yield pa.record_batch([pa.array([blob], pa.binary())], names=["blob"])

    def decode(batches):
        for found in opened(batches):
            yield from found.to_batches(max_chunksize=10_000)

    first = files.limit(1).mapInArrow(schemas, "blob binary").first()
    if first is None:
        raise EmptyTableError(f"No rows in {path}")
    schema = pa.ipc.read_schema(pa.BufferReader(first["blob"]))
    return files.mapInArrow(decode, from_arrow_schema(schema))
