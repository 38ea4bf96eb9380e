"""Byte-level BPE encoding and decoding by corpus-level merge replay."""

from __future__ import annotations

import base64
import re
from collections.abc import Iterable, Iterator
from heapq import heapify, heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import text_slices

#: Words, and their characters in all, whose ids a Python worker keeps from slice to slice; beyond, it starts anew.
KEPT_WORDS, KEPT_CHARACTERS = 400_000, 8_000_000
_NONE = np.iinfo(np.int32).max
#: Code points below this are classed by the table of the standard ``re``.
_LATIN = 0x250


def load_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a public vocabulary file: a base64 token and its rank a line (about 50,000, so fit to broadcast)."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class MergeReplay:
    """Encodes many words at once by replaying the merges over all of them.

    The words' bytes lie in one row of places, word after word. The index holds for
    every place the rank of the pair that starts there (none at a word's end). Words
    do not depend on each other, so in one wave each word looks up the lowest rank
    in its part of the index and applies that merge at all its places; only the
    pairs on either side of a merged place are looked up anew. A word leaves when
    its part of the index is empty, so each word sees its merges in rank order.

    Should a merge bring up a pair of lower rank while others of its own rank
    wait, the word is done again place by place (``_one``).
    """

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.byte_id = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        pairs = {}
        for token, r in ranks.items():
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    pairs[a << 32 | b] = r
        self.keys = np.array(sorted(pairs), np.int64)
        self.values = np.array([pairs[k] for k in self.keys.tolist()] + [_NONE], np.int32)
        self.pairs = pairs
        self.keys = np.append(self.keys, np.iinfo(np.int64).max)

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a.astype(np.int64) << 32 | b
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.values[at], _NONE)

    def _one(self, word: bytes) -> list[int]:
        """One word, the lowest and leftmost pair at a time: a heap of places with links to their neighbours."""
        ids = self.byte_id[np.frombuffer(word, np.uint8)].tolist()
        get, end = self.pairs.get, len(ids)
        after, before = list(range(1, end + 1)), list(range(-1, end - 1))
        heap = [(r, i) for i in range(end - 1) if (r := get(ids[i] << 32 | ids[i + 1])) is not None]
        heapify(heap)
        while heap:
            r, i = heappop(heap)
            j = after[i]
            if ids[i] < 0 or j >= end or get(ids[i] << 32 | ids[j]) != r:
                continue
            ids[i], ids[j] = r, -1
            after[i] = k = after[j]
            if k < end:
                before[k] = i
                if (s := get(r << 32 | ids[k])) is not None:
                    heappush(heap, (s, i))
            if (h := before[i]) >= 0 and (s := get(ids[h] << 32 | r)) is not None:
                heappush(heap, (s, h))
        return [i for i in ids if i >= 0]

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words in a row, and how many each word has."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        ids = self.byte_id[np.frombuffer(b"".join(words), np.uint8)]
        counts = np.zeros(len(words), np.int64)
        found: list[tuple[np.ndarray, np.ndarray]] = []
        again: list[int] = []
        word = np.flatnonzero(sizes)
        sizes = sizes[word]
        index = np.full(len(ids), _NONE, np.int32)
        if len(ids) > 1:
            index[:-1] = self._rank(ids[:-1], ids[1:])
        while len(word):
            ends = np.cumsum(sizes)
            starts = ends - sizes
            index[ends - 1] = _NONE
            lowest = np.minimum.reduceat(index, starts)
            done = lowest == _NONE
            if done.any():
                gone = np.repeat(done, sizes)
                counts[word[done]] = sizes[done]
                found.append((np.repeat(word[done], sizes[done]), ids[gone]))
                ids, index = ids[~gone], index[~gone]
                word, sizes, lowest = word[~done], sizes[~done], lowest[~done]
                if not len(word):
                    break
                ends = np.cumsum(sizes)
                starts = ends - sizes
            owner = np.repeat(np.arange(len(word)), sizes)
            at = np.flatnonzero(index == lowest[owner])
            # of places in a row, as in aaa, every second one from the left
            step = np.ones(len(at), bool)
            step[1:] = np.diff(at) != 1
            first = at[np.maximum.accumulate(np.where(step, np.arange(len(at)), 0))]
            first = np.where(owner[first] == owner[at], first, starts[owner[at]])
            at = at[(at - first) % 2 == 0]
            rank = index[at]
            own = owner[at]
            many = np.bincount(own, minlength=len(word)) > 1
            # taken one by one, a place meets its right neighbour before that is merged
            before = np.flatnonzero(many[own] & (at + 2 < ends[own]))
            early = self._rank(rank[before], ids[at[before] + 2]) < rank[before]
            again.extend(word[own[before[early]]].tolist())
            ids[at] = rank
            keep = np.ones(len(ids), bool)
            keep[at + 1] = False
            place = np.cumsum(keep)[at] - 1
            ids, index = ids[keep], index[keep]
            np.subtract.at(sizes, owner[at], 1)
            ends = np.cumsum(sizes)
            starts = ends - sizes
            index[ends - 1] = _NONE
            right = place[place < ends[own] - 1]
            index[right] = self._rank(ids[right], ids[right + 1])
            left = place[place > starts[own]] - 1
            index[left] = self._rank(ids[left], ids[left + 1])
            index[ends - 1] = _NONE
            low = np.minimum.reduceat(index, starts)
            again.extend(word[(low < lowest) & many].tolist())
        if again:
            again = sorted(set(again))
            found = [(w[m], i[m]) for w, i in found for m in [~np.isin(w, again)]]
            for k in again:
                one = self._one(words[k])
                counts[k] = len(one)
                found.append((np.full(len(one), k), np.array(one, np.int32)))
        if not found:
            return np.zeros(0, np.int32), counts
        order = np.argsort(np.concatenate([w for w, _ in found]), kind="stable")
        return np.concatenate([i for _, i in found])[order], counts


def word_splitter(pattern: str):
    """findall of ``pattern``; texts of Latin code points alone take an equal pattern for the faster ``re``.

    The equal pattern lists the letters, numbers and spaces below U+0250 in place of
    their classes; it is used only if it differs from ``pattern`` in nothing else.
    """
    general = regex.compile(pattern).findall
    chars = [chr(i) for i in range(_LATIN)]
    classes = {name: "".join(re.escape(x) for x in chars if regex.fullmatch(rule, x))
               for name, rule in (("L", r"\p{L}"), ("N", r"\p{N}"), ("s", r"\s"))}
    own = re.sub(r"\[\^\\s\\p\{L\}\\p\{N\}\]", lambda _: f"[^{classes['s']}{classes['L']}{classes['N']}]", pattern)
    for mark, chosen in ((r"\p{L}", f"[{classes['L']}]"), (r"\p{N}", f"[{classes['N']}]"),
                         (r"\S", f"[^{classes['s']}]"), (r"\s", f"[{classes['s']}]")):
        own = own.replace(mark, chosen)
    if "[[" in own or r"\p" in own:
        return general
    latin, other = re.compile(own).findall, re.compile(f"[^{chars[0]}-{chars[-1]}]").search
    return lambda text: general(text) if other(text) else latin(text)


class _Words:
    """The ids of the words met so far, in one row; lives as long as the Python worker."""

    def __init__(self, replay: MergeReplay):
        self.replay = replay
        self.clear()

    def clear(self) -> None:
        self.number: dict[str, int] = {}
        self.characters = 0
        self.starts = np.zeros(0, np.int64)
        self.counts = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.int32)

    def encode(self, docs: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all documents in a row, and how many each has."""
        if len(self.number) > KEPT_WORDS or self.characters > KEPT_CHARACTERS:
            self.clear()
        new = list({w for d in docs for w in d}.difference(self.number))
        self.characters += sum(map(len, new))
        ids, counts = self.replay.encode([w.encode() for w in new])
        self.starts = np.concatenate([self.starts, len(self.ids) + np.cumsum(counts) - counts])
        self.counts = np.concatenate([self.counts, counts])
        self.ids = np.concatenate([self.ids, ids])
        self.number.update(zip(new, range(len(self.number), len(self.number) + len(new)), strict=True))
        lengths = np.fromiter(map(len, docs), np.int64, len(docs))
        word = np.fromiter(map(self.number.__getitem__, chain.from_iterable(docs)), np.int64, int(lengths.sum()))
        size = self.counts[word]
        ends = np.cumsum(size)
        flat = self.ids[np.repeat(self.starts[word] - (ends - size), size) + np.arange(size.sum())]
        ends = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(lengths)])]
        return flat, ends


_KEPT: dict[tuple[int, int], _Words] = {}


def _worker_words(ranks: dict[bytes, int]) -> _Words:
    key = (len(ranks), hash(frozenset(ranks.items())))
    if key not in _KEPT:
        _KEPT.clear()
        _KEPT[key] = _Words(MergeReplay(ranks))
    return _KEPT[key]


def _encoder(ranks: dict[bytes, int], pattern: str):
    """The ids of an array of texts, a list a text."""
    words, split = _worker_words(ranks), word_splitter(pattern)

    def ids(texts: pa.Array) -> pa.ListArray:
        flat, ends = words.encode([split(t) if t else [] for t in texts.to_pylist()])
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()))

    return ids


def _decoder(ranks: dict[bytes, int]):
    """The bytes of an array of lists of ids."""
    vocabulary = [b""] * (max(ranks.values()) + 1)
    for token, r in ranks.items():
        vocabulary[r] = token

    def decoded(lists: pa.ListArray) -> pa.Array:
        out = [b"".join(map(vocabulary.__getitem__, x.values.to_numpy().tolist())) if x.is_valid else None for x in lists]
        return pa.array(out, pa.binary())

    return decoded


def _encode_batches(ranks, pattern: str, back: bool = False):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, decoded = _encoder(ranks.value, pattern), _decoder(ranks.value) if back else None
        for batch in batches:
            for part in text_slices(batch):
                made = [ids(part.column("text"))]
                if back:
                    made.append(decoded(made[0]))
                yield pa.RecordBatch.from_arrays([*part.columns, *made], names=[*part.schema.names, *["ids", "decoded"][: len(made)]])

    return run


def _decode_batches(ranks):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoded = _decoder(ranks.value)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, decoded(batch.column("ids"))], names=[*batch.schema.names, "decoded"])

    return run


_IDS = T.StructField("ids", T.ArrayType(T.IntegerType(), False))
_DECODED = T.StructField("decoded", T.BinaryType())


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """``docs`` with ``ids`` (array of int): its text by the ranks in the file at ``path``.

    Each match of ``pattern`` is encoded by itself, without special tokens. The
    driver reads the file and broadcasts it (a vocabulary, bounded). A slice of
    texts makes one corpus of its new words; each distinct word is encoded once.
    Null and empty texts have no ids; repeated rows give the same ids; an input
    column named ``ids`` is replaced. Memory: a slice of 2 MB of text, or one text,
    and KEPT_WORDS words or KEPT_CHARACTERS characters of them, with those of a slice.
    """
    ranks = docs.sparkSession.sparkContext.broadcast(load_ranks(path))
    docs = docs.drop("ids")
    return docs.mapInArrow(_encode_batches(ranks, pattern), T.StructType([*docs.schema.fields, _IDS]))


def decode(tokens: DataFrame, path: str) -> DataFrame:
    """``tokens`` with ``decoded`` (binary): the bytes of its ``ids``; null ids give null.

    An id that the file lacks is an error. An input column named ``decoded`` is replaced.
    """
    ranks = tokens.sparkSession.sparkContext.broadcast(load_ranks(path))
    tokens = tokens.drop("decoded")
    return tokens.mapInArrow(_decode_batches(ranks), T.StructType([*tokens.schema.fields, _DECODED]))


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """``docs`` with ``ids`` and ``decoded``, as ``decode`` of ``encode`` gives them, by one worker a task in place of two.

    Rows, nulls and columns that are replaced are as in these two; ``decoded`` of a null text is empty.
    """
    ranks = docs.sparkSession.sparkContext.broadcast(load_ranks(path))
    docs = docs.drop("ids", "decoded")
    return docs.mapInArrow(_encode_batches(ranks, pattern, back=True), T.StructType([*docs.schema.fields, _IDS, _DECODED]))
