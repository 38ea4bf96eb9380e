"""Periodic runs of words: what a stuck generator or a copied line leaves behind.

Words are read in order. A word's earlier occurrences keep diagonals (lags) alive: a lag
that goes on matching grows by one a word, and one that ends long enough emits its run.

A word that a text repeats n times has n^2 / 2 pairs of occurrences, so the diagonals are
kept sparse without losing a run: lags from L/2 + 1 to L are followed on windows of L words
(L = 1, 2, 4, ...) in place of single words, and of a window only the latest earlier
occurrence. This is exact. In a run of smallest period q, the windows of L >= q words that
start at q different places differ, so the latest earlier occurrence of a window lies
exactly q words back; and were it nearer anywhere, two periods would meet on q words or
more and q would not be the smallest. At each length one lag at most is active at a word,
and windows whose halves do not both recur are left out at the next length, so the work is
n log n for any text and about n for prose.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import text_slices

#: A run has so many words at least ...
LEAST = 6
#: ... and so many periods.
TIMES = 4

RUN = T.StructType([T.StructField(n, T.LongType(), False) for n in ("start", "length", "period")])


def _ended(at: np.ndarray, lag: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Diagonals of windows of ``size`` words: start, length and period of what they cover.

    ``at``: places whose window has its latest earlier occurrence ``lag`` words back, in
    order. A diagonal grows while the next place has the same lag.
    """
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1] + 1) | (lag[1:] != lag[:-1])
    begin = np.flatnonzero(new)
    q = lag[begin]
    match = np.diff(np.append(begin, len(at))) + size - 1
    return at[begin] - q, match + q, q


def find_runs(words: np.ndarray, first: np.ndarray, least: int = LEAST, times: int = TIMES) -> np.ndarray:
    """All runs of several texts as rows (text, start, length, period), by text, start and period.

    ``words``: a number for each word, distinct between texts; text t has the words from
    ``first[t]`` to ``first[t + 1]``. ``times`` is at least 3, which the windows need.
    """
    if times < 3:
        raise ValueError("runs of fewer than three periods need longer windows")
    count = np.diff(first)
    text = np.repeat(np.arange(len(count)), count)
    end = np.repeat(first[1:], count)
    found = []
    size, at, name = 1, np.arange(len(words)), words
    while len(at):
        # the order of names, then places: equal windows stand together, the latest earlier one before each
        order = np.argsort(name, kind="stable")
        same = name[order][1:] == name[order][:-1]
        lag = np.zeros(len(at), np.int64)
        lag[order[1:][same]] = (at[order[1:]] - at[order[:-1]])[same]
        hit = (lag > size // 2) & (lag <= size)
        start, length, period = _ended(at[hit], lag[hit], size)
        good = length >= np.maximum(least, times * period)
        found.append(np.stack([text[start[good]], start[good], length[good], period[good]], 1))
        # windows of twice the size: both halves recur in their text, and the text can hold such a run
        again = np.zeros(len(at), bool)
        again[order[1:][same]] = True
        again[order[:-1][same]] = True
        number = np.empty(len(at), np.int64)
        number[order] = np.concatenate([[0], np.cumsum(~same)])
        held = np.full(len(words), -1, np.int64)
        held[at[again]] = number[again]
        at = at[again]
        at = at[(at + 2 * size <= end[at]) & (count[text[at]] >= max(least, times * (size + 1)))]
        other = held[at + size]
        at, other = at[other >= 0], other[other >= 0]
        name = held[at] * (len(number) + 1) + other
        size *= 2
    out = np.concatenate(found) if found else np.zeros((0, 4), np.int64)
    out[:, 1] -= first[out[:, 0]]
    return out[np.lexsort((out[:, 3], out[:, 1], out[:, 0]))]


def _numbered(texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """A number for each word, distinct between texts, and where each text's words begin."""
    numbers, first, base = [], [0], 0
    for words in texts:
        known: dict[bytes, int] = {}
        numbers.append(np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words)) + base)
        base += len(known)
        first.append(first[-1] + len(words))
    return (np.concatenate(numbers) if numbers else np.zeros(0, np.int64)), np.array(first)


def _collapsed(words: list[bytes], runs: np.ndarray) -> bytes:
    """The words joined by one space, without those that a run holds after its first period."""
    if not len(runs):
        return b" ".join(words)
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, runs[:, 1] + runs[:, 3], 1)
    np.add.at(edge, runs[:, 1] + runs[:, 2], -1)
    dropped = np.cumsum(edge[:-1]) > 0
    return b" ".join([w for w, gone in zip(words, dropped.tolist(), strict=True) if not gone])


def periodic_runs(docs: DataFrame, least: int = LEAST, times: int = TIMES) -> DataFrame:
    """All columns of ``docs`` with ``n_words``, ``runs`` and ``collapsed``.

    ``runs``: all stretches of consecutive words with smallest period q and a length of at
    least ``least`` words and ``times`` periods that no neighbouring word extends, as
    (start, length, period) by start, then period; words are numbered from 0. ``collapsed``:
    the text's words joined by one space, without those that any run holds after its first
    period. Words are what space and the characters 9 to 13 separate. Null, empty and blank
    texts have no words: no runs, an empty collapsed text. Rows that repeat, or lack other
    values, are rows of their own. Columns of the input named like the new ones are replaced.
    An empty table gives none.

    Nothing is shuffled; texts of about 2 MB, or one longer text, are in a worker at a time.
    """
    added = T.StructType([
        T.StructField("n_words", T.LongType()), T.StructField("runs", T.ArrayType(RUN, False)), T.StructField("collapsed", T.StringType()),
    ])
    rows = docs.select(*[docs[c] for c in docs.columns if c.lower() not in added.names])

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch):
                texts = [(t or b"").split() for t in part.column("text").cast(pa.large_binary()).to_pylist()]
                numbers, first = _numbered(texts)
                found = find_runs(numbers, first, least, times)
                cuts = np.searchsorted(found[:, 0], np.arange(len(texts) + 1))
                fields = pa.StructArray.from_arrays([pa.array(found[:, i]) for i in (1, 2, 3)], fields=[pa.field(n, pa.int64(), False) for n in RUN.names])
                collapsed = [_collapsed(w, found[a:b]) for w, a, b in zip(texts, cuts[:-1], cuts[1:], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        *part.columns,
                        pa.array(np.diff(first)),
                        pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), fields, type=pa.list_(pa.field("element", fields.type, False))),
                        pa.array(collapsed, pa.large_binary()).cast(pa.large_string()).cast(pa.string()),
                    ],
                    names=[*part.schema.names, *added.names],
                )

    return rows.mapInArrow(work, T.StructType([*rows.schema.fields, *added.fields]))


def longest(runs: F.Column) -> F.Column:
    """The run of the greatest length; of equal ones that of the smallest start, then period; null without runs."""
    top = F.array_max(F.transform(runs, lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("a"), (-r["period"]).alias("b"))))
    return F.when(top.isNotNull(), F.struct((-top["a"]).alias("start"), top["length"].alias("length"), (-top["b"]).alias("period")))


def written_runs(runs: F.Column) -> F.Column:
    """``start,length,period`` and a line feed for every run."""
    parts = ("start", "length", "period")
    return F.array_join(F.transform(runs, lambda r: F.concat(F.concat_ws(",", *[r[p].cast("string") for p in parts]), F.lit("\n"))), "")
