"""Records that span lines, read in splits: one file is many tasks, wherever its records end.

A file is read in pieces that a separator byte ends (a line feed, or a closing brace), in
Spark's own splits.  Whether a piece stands inside quotes, and how deep, depends on all
pieces before it.  So each split first tells what it does to every state that it may be
entered with; these effects are composed in the order of the splits, one row each; then
every split knows its state at the start and cuts records by itself.  What a split holds
of records that began before it, or that it does not end, are fragments, two a split at
most, which are put together by a shuffle of fragments alone.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import checkpointed

#: Splits (and files) that are told their state by a broadcast, a row each; a shuffle would lose the order of pieces.
FEW_SPLITS = 2_000_000
WHOLE, HEAD, TAIL, MIDDLE, FIRST = range(5)
_STRING = re.compile(r'"(?:[^"\\]|\\.)*+"', re.S)
_REST_OF_STRING = re.compile(r'(?:[^"\\]|\\.)*+"', re.S)


@dataclass(frozen=True)
class Quoted:
    """Delimited text: a cell that begins with a quote ends with one; two of them are one inside."""

    delimiter: str = ","
    piece_end: str = "\n"
    mark: str = '"'

    def scan(self, piece: str, inside: bool, depth: int) -> tuple[bool, int]:
        at = 0
        while True:
            if inside:
                at = piece.find('"', at)
                while at >= 0 and piece[at + 1 : at + 2] == '"':
                    at = piece.find('"', at + 2)
                if at < 0:
                    return True, 0
                inside = False
                at = piece.find(self.delimiter, at + 1)
                if at < 0:
                    return False, 0
            quote = piece.find('"', at)
            if quote < 0:
                return False, 0
            if quote == 0 or piece[quote - 1] == self.delimiter:
                inside, at = True, quote + 1
            else:  # a quote within a plain cell is a character as others are
                at = piece.find(self.delimiter, quote)
                if at < 0:
                    return False, 0

    def ended(self, piece: str, inside: bool, depth: int) -> bool:
        return not inside

    def tidy(self, record: str) -> str:
        record = record.removesuffix("\n")
        return record.removesuffix("\r")


@dataclass(frozen=True)
class Arrays:
    """JSON that holds one array of records: a record ends with the brace that leads back into the array."""

    piece_end: str = "}"
    mark: str = ""

    def scan(self, piece: str, inside: bool, depth: int) -> tuple[bool, int]:
        """The piece and the brace that ends it (after the last one of a file nothing counts)."""
        if inside:
            rest = _REST_OF_STRING.match(piece)
            if rest is None:
                return True, depth
            piece = piece[rest.end() :]
        if '"' in piece:
            piece = _STRING.sub("", piece)
            quote = piece.find('"')
            if quote >= 0:
                piece = piece[:quote]
                return True, depth + piece.count("{") + piece.count("[") - piece.count("]")
        return False, depth + piece.count("{") + piece.count("[") - piece.count("]") - 1

    def ended(self, piece: str, inside: bool, depth: int) -> bool:
        return not inside and depth == 1

    def tidy(self, record: str) -> str:
        return record.lstrip(" \t\r\n,[\ufeff")


def pieces(spark: SparkSession, path: str, form: Quoted | Arrays) -> DataFrame:
    """(path, file, block, value): all pieces; those of a block stand in their order, in one task."""
    text = spark.read.option("lineSep", form.piece_end).text(path)
    where = F.col("_metadata.file_path")
    return text.select(where.alias("path"), F.xxhash64(where).alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")


def _runs(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[int, int, bool, pa.RecordBatch]]:
    """(file, block, whether it begins here, its rows in this batch)."""
    before = None
    for batch in batches:
        if not len(batch):
            continue
        file, block = (batch.column(c).to_numpy() for c in ("file", "block"))
        cuts = [0, *[int(i) + 1 for i in ((file[1:] != file[:-1]) | (block[1:] != block[:-1])).nonzero()[0]], len(batch)]
        for a, b in zip(cuts[:-1], cuts[1:]):
            key = (int(file[a]), int(block[a]))
            yield *key, key != before, batch.slice(a, b - a)
            before = key


def _effects(form: Quoted | Arrays):
    """What each block does to either state it may be entered with."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[list] = []
        for file, block, new, part in _runs(batches):
            if new:
                rows.append([file, block, False, 0, True, 0])
            row = rows[-1]
            values = part.column("value")
            if form.mark:  # pieces without the mark leave the state as it is
                values = values.filter(pc.match_substring(values, form.mark))
            for piece in values.to_pylist():
                row[2:4] = form.scan(piece, row[2], row[3])
                row[4:6] = form.scan(piece, row[4], row[5])
        names = ["file", "block", "out", "deep", "out_inside", "deep_inside"]
        if rows:
            yield pa.RecordBatch.from_pydict(dict(zip(names, map(list, zip(*rows)), strict=True)))

    return run


def _starts(blocks):
    """The state at the start of each block of one file: its effects composed in order, a row a split."""
    blocks = blocks.sort_values("block")
    inside, depth, found = False, 0, []
    for r in blocks.itertuples():
        found.append((r.file, r.block, inside, depth))
        out, deep = (r.out_inside, r.deep_inside) if inside else (r.out, r.deep)
        inside, depth = bool(out), depth + int(deep)
    return pd.DataFrame(found, columns=["file", "block", "inside", "depth"])


def _records(form: Quoted | Arrays, base: int):
    """Cut the pieces of every block into records and fragments."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[str] = []
        state = {"begun": False, "first": False, "inside": False, "depth": 0, "file": 0, "block": 0}
        out: dict[str, list] = {n: [] for n in ("file", "block", "kind", "value")}

        def emit(kind: int, value: str) -> None:
            for name, x in zip(out, (state["file"], state["block"], kind, value), strict=True):
                out[name].append(x)

        def close() -> None:
            """The block is over: what is held goes on in another one."""
            if held:
                emit(TAIL if state["begun"] else MIDDLE, "".join(held))
                held.clear()

        def flush() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays(
                [pa.array(out["file"], pa.int64()), pa.array(out["block"], pa.int64()), pa.array(out["kind"], pa.int32()), pa.array(out["value"], pa.string())],
                names=list(out),
            )
            for column in out.values():
                column.clear()
            return made

        for file, block, new, part in _runs(batches):
            if new:
                close()
                state |= {"file": file, "block": block, "inside": part.column("inside")[0].as_py(), "depth": part.column("depth")[0].as_py()}
                # a record is open where the block begins inside one
                state["begun"] = not (state["inside"] or state["depth"] > base)
                state["first"] = block == 0
            inside, depth, begun = state["inside"], state["depth"], state["begun"]
            values = part.column("value")
            marked = pc.match_substring(values, form.mark).to_pylist() if form.mark else [True] * len(values)
            for piece, scan in zip(values.to_pylist(), marked, strict=True):
                if scan:
                    inside, depth = form.scan(piece, inside, depth)
                held.append(piece + form.piece_end)
                if form.ended(piece, inside, depth):
                    record = "".join(held)
                    held.clear()
                    if begun:
                        emit(FIRST if state["first"] else WHOLE, form.tidy(record))
                    else:
                        emit(HEAD, record)
                    state["first"], begun = False, True
            state["inside"], state["depth"], state["begun"] = inside, depth, begun
            if out["file"]:
                yield flush()
        close()
        if out["file"]:
            yield flush()

    return run


def told(small: DataFrame) -> DataFrame:
    """A row a split or file, to be joined without moving the pieces."""
    if small.count() > FEW_SPLITS:
        raise ValueError(f"More than {FEW_SPLITS} splits or files in one read: use larger splits, or read in parts")
    return F.broadcast(small)


def records(found: DataFrame, form: Quoted | Arrays) -> DataFrame:
    """(file, kind, value): every record as one text; ``kind`` is FIRST for the first of a file that ends in its first split.

    ``found``: as from :func:`pieces`; other columns are left out.  An unfinished last record
    is returned as it is where it is quoted text; what follows a JSON array is not a record.
    """
    base = 1 if isinstance(form, Arrays) else 0
    found = found.select("file", "block", "value")
    effects = found.mapInArrow(_effects(form), "file long, block long, out boolean, deep long, out_inside boolean, deep_inside long")
    starts = effects.groupBy("file").applyInPandas(_starts, "file long, block long, inside boolean, depth long")
    placed = found.join(told(checkpointed(starts)), ["file", "block"])
    cut = placed.select("file", "block", "value", "inside", "depth")
    made = cut.mapInArrow(_records(form, base), "file long, block long, kind int, value string")
    whole = made.filter(F.col("kind").isin(WHOLE, FIRST)).select("file", "kind", "value")
    # two fragments a split at most: a head belongs to the last tail before it
    order = Window.partitionBy("file").orderBy("block", F.when(F.col("kind") == TAIL, 1).otherwise(0))
    parts = made.filter(F.col("kind").isin(HEAD, MIDDLE, TAIL)).withColumn("id", F.sum((F.col("kind") == TAIL).cast("int")).over(order))
    joined = parts.groupBy("file", "id").agg(
        F.array_sort(F.collect_list(F.struct("block", F.when(F.col("kind") == TAIL, 1).otherwise(0).alias("late"), "value"))).alias("parts"),
        F.max(F.col("kind") == HEAD).alias("ended"),
    )
    if isinstance(form, Arrays):
        joined = joined.filter("ended")
    text = F.array_join(F.transform("parts", lambda p: p["value"]), "")
    tidy = F.regexp_replace(text, "\\r?\\n\\z", "") if isinstance(form, Quoted) else F.regexp_replace(text, "^[ \\t\\r\\n,\\[\\x{feff}]+", "")
    return whole.unionByName(joined.select("file", F.lit(WHOLE).alias("kind"), tidy.alias("value")))


def parsed(reader, form: str, texts: DataFrame) -> DataFrame:
    """Records, one text column, through Spark's own parser, which takes a dataset of strings."""
    encoder = texts.sparkSession._jvm.org.apache.spark.sql.Encoders.STRING()
    return reader._df(getattr(reader._jreader, form)(getattr(texts._jdf, "as")(encoder)))
