"""SHA-256 of long files, slice by slice: a task digests one slice and hands the state of the digest on.

A digest needs the bytes in order, so the slices of a file follow each other; but no task
holds more than one of them, and files of any size have a digest.  Bytes are read in
Spark's own splits, as pieces that end with a line feed, and shuffled once, by slice.
"""

from __future__ import annotations

import ctypes
import functools
import hashlib
import re
from collections.abc import Iterable, Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .splits import _runs

#: Bytes of a file that one task digests.
SLICE_BYTES = 128 * 2**20
#: What Spark would unpack on reading; such files are not read in splits.
PACKED = re.compile(r"\.(gz|bz2|deflate|snappy|lz4|zst|zstd)$", re.I)
_MARK = b"\xef\xbb\xbf"  # a byte order mark that the line reader leaves out


@functools.cache
def _library() -> ctypes.CDLL | None:
    """The library behind ``hashlib``, whose digests can be stopped and taken up elsewhere; None without one."""
    try:
        import _hashlib

        library = ctypes.CDLL(_hashlib.__file__)
        if _ended(_fed(library, _begun(library), [b"a", b"bc"]), library) == hashlib.sha256(b"abc").hexdigest():
            return library
    except (ImportError, AttributeError, OSError):
        pass
    return None


def _begun(library: ctypes.CDLL) -> bytes:
    state = ctypes.create_string_buffer(112)
    library.SHA256_Init(state)
    return state.raw


def _fed(library: ctypes.CDLL, state: bytes, parts: Iterable[bytes]) -> bytes:
    held = ctypes.create_string_buffer(state, 112)
    for part in parts:
        library.SHA256_Update(held, bytes(part), ctypes.c_size_t(len(part)))
    return held.raw


def _ended(state: bytes, library: ctypes.CDLL) -> str:
    out = ctypes.create_string_buffer(32)
    library.SHA256_Final(out, ctypes.create_string_buffer(state, 112))
    return out.raw.hex()


def can_split() -> bool:
    return _library() is not None


def plain_path(path: str) -> str:
    """The path of one file, with what a reader would take for a pattern escaped."""
    return re.sub(r"([\\*?\[\]{}])", r"\\\1", path)


def _pieces(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(file, block, place, data): the lines of a batch as one piece, without the line feed after the last."""
    place = 0
    for file, block, begins, rows in _runs(batches):
        place = 0 if begins else place + 1
        lines = rows.column("value").cast(pa.large_binary())
        whole = pa.LargeListArray.from_arrays(pa.array([0, len(lines)], pa.int64()), lines)
        data = pc.binary_join(whole, pa.scalar(b"\n", pa.large_binary()))
        yield pa.RecordBatch.from_arrays(
            [pa.array([file], pa.int64()), pa.array([block], pa.int64()), pa.array([place], pa.int64()), data.cast(pa.binary())],
            names=["file", "block", "place", "data"],
        )


def _pieces_of(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    text = spark.read.option("lineSep", "\n").option("recursiveFileLookup", True).text([plain_path(p) for p in paths])
    lines = text.select(
        F.xxhash64("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.col("value").cast("binary").alias("value"),
    )
    return lines.mapInArrow(_pieces, "file long, block long, place long, data binary")


def _advance(states: dict[int, tuple[bytes, int, bool]]):
    """The digests of the files whose slice a partition holds, carried on over that slice."""

    def run(items: Iterable[tuple]) -> list[tuple]:
        ordered = sorted((x for _, x in items), key=lambda x: x[:3])
        out = []
        for file in sorted({x[0] for x in ordered}):
            state, length, more = states[file]
            parts = []
            for _, _, _, data in (x for x in ordered if x[0] == file):
                parts += [b"\n", data] if more else [data]
                more = True
            out.append((file, (_fed(_library(), state, parts), length + sum(map(len, parts)), more)))
        return out

    return run


def split_digests(
    spark: SparkSession, files: Sequence[tuple[str, int, int]], slice_bytes: int = SLICE_BYTES
) -> list[tuple[str, str]]:
    """``(path, sha256)`` of files given as ``(path, hash of its name as Spark reads it, length)``.

    As many rounds follow each other as the longest file has slices; a round digests one
    slice of every file that still has one, a task each.  The states, 112 bytes a file,
    are with the driver in between.
    """
    library = _library()
    starts, total = {}, 0
    for _, file, length in files:
        starts[file], total = total, total + length // slice_bytes + 1
    most = max(length // slice_bytes + 1 for _, _, length in files)
    rows = _pieces_of(spark, [p for p, _, _ in files]).rdd.map(
        lambda r: (starts[r["file"]] + r["block"] // slice_bytes, (r["file"], r["block"], r["place"], r["data"]))
    )
    slices = rows.partitionBy(total, int)

    def chained(begun: dict[int, bytes]) -> dict[int, tuple[bytes, int, bool]]:
        states = {file: (_fed(library, _begun(library), [head]), len(head), False) for file, head in begun.items()}
        last = {file: starts[file] + length // slice_bytes for _, file, length in files}
        for k in range(most):
            now = [starts[file] + k for file in begun if starts[file] + k <= last[file]]
            if now:
                states |= dict(spark.sparkContext.runJob(slices, _advance(states), now))
        return states

    lengths = {file: length for _, file, length in files}
    states = chained({file: b"" for file in lengths})
    # the reader leaves out a byte order mark: only the length tells of it
    marked = [f for f, (_, n, _) in states.items() if lengths[f] - n in (len(_MARK), len(_MARK) + 1)]
    if marked:
        states |= chained({file: _MARK for file in marked})
    out = []
    for path, file, length in files:
        state, n, _ = states[file]
        if length - n not in (0, 1):
            raise ValueError(f"{path} changed while it was read: {n} of {length} bytes")
        out.append((path, _ended(_fed(library, state, [b"\n"] * (length - n)), library)))
    return out
