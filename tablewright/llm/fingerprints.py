"""Document fingerprints: threshold-scaled sketches of word shingles, in Spark expressions alone.

A sketch keeps every shingle hash below a fixed fraction of the range of hashes. What it
keeps depends on the shingle alone, not on the rest of its text, so the sketch of several
texts is the union of theirs, and the part of a short text inside a long one is estimated
without bias: sketches grow with their texts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

WORDS = 5
#: One of so many shingle hashes is kept.
SCALE = 8
#: Shingles hashed before the kept ones are picked out: bounds the memory of a very long text.
CHUNK = 8_192
#: Texts are cut at runs of these characters.
_WORD = r"[^\x20\x09-\x0D]++"


def _bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f(value)`` with ``value`` worked out once, however often ``f`` names it."""
    return F.transform(F.array(value), f)[0]


def _digest(text: Column) -> Column:
    """64 bits of MD5 as 16 hexadecimal digits."""
    return F.substring(F.md5(text), 1, 16)


def sketch(text: Column, words: int = WORDS, scale: int = SCALE) -> Column:
    """struct(name string, kept array<long>) of a text.

    ``kept``: the distinct hashes below 2^64 / ``scale`` of all runs of ``words`` words,
    ascending; a text of fewer words has one shingle, the whole sequence. ``name``: the
    digest of the whole sequence of words, which tells texts apart that keep nothing.
    Words are what space and the characters 9 to 13 separate, in lower case. Null and
    empty texts have no words: nothing is kept, and their names are equal. ``scale`` is
    a power of two from 2 to 2^32.
    """
    if scale < 2 or scale > 2**32 or scale & (scale - 1):
        raise ValueError("scale must be a power of two from 2 to 2^32")
    limit = f"{2**64 // scale:016x}"

    def kept(w: Column) -> Column:
        last = F.greatest(F.size(w) - words, F.lit(0))

        def hashed(i: Column) -> Column:
            # places beyond the end are null, which concat_ws leaves out
            return _digest(F.concat_ws(" ", *[F.get(w, i + j) for j in range(words)]))

        def chunk(start: Column) -> Column:
            places = F.sequence(start, F.least(start + (CHUNK - 1), last))
            return F.filter(F.transform(places, hashed), lambda h: h < limit)

        found = F.flatten(F.transform(F.sequence(F.lit(0), last, F.lit(CHUNK)), chunk))
        # below 2^63, as scale is 2 at least
        numbers = F.transform(found, lambda h: F.conv(h, 16, 10).cast("long"))
        none = F.array().cast("array<bigint>")
        return F.struct(
            _digest(F.array_join(w, " ")).alias("name"),
            F.when(F.size(w) == 0, none).otherwise(F.array_sort(F.array_distinct(numbers))).alias("kept"),
        )

    return _bound(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(_WORD), F.lit(0)), kept)


def spelled(s: Column) -> Column:
    """A sketch as a string: its name, a colon, and the kept hashes of 16 hexadecimal digits each, comma-joined."""
    digits = F.transform(s["kept"], lambda h: F.lower(F.lpad(F.hex(h), 16, "0")))
    return F.concat(s["name"], F.lit(":"), F.array_join(digits, ","))


def _common(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a["kept"], b["kept"]))


def resemblance(a: Column, b: Column) -> Column:
    """The estimated Jaccard similarity of two sketches; of two that keep nothing: 1 if their names are equal, else 0."""
    both = _common(a, b)
    either = F.size(a["kept"]) + F.size(b["kept"]) - both
    return F.when(either > 0, both / either).otherwise((a["name"] == b["name"]).cast("double"))


def containment(a: Column, b: Column) -> Column:
    """The estimated share of ``a``'s shingles that ``b`` has; if ``a`` keeps nothing: 1 if the names are equal, else 0."""
    return F.when(F.size(a["kept"]) > 0, _common(a, b) / F.size(a["kept"])).otherwise((a["name"] == b["name"]).cast("double"))


def merged(rows: DataFrame, key: str, kept: Column) -> DataFrame:
    """(key, hash): the sketch of all texts of a key, as rows, one a kept hash.

    The union of sketches is the sketch of the union. A hash is met once a task before
    it is shuffled, so neither a key nor a hash of very many rows is one task's work.
    """
    return rows.select(key, F.explode(kept).alias("hash")).distinct()


def next_ids(ids: DataFrame) -> DataFrame:
    """(doc_id, next_id) for distinct ids: the next smaller one; after the least comes the greatest.

    Ids are dealt by range and written, so that a range and its number stay together;
    windows look inside a range, and each range's last id is given the first one of the
    next range, of which there are as many as partitions.
    """
    dealt = written(ids.repartitionByRange(F.desc("doc_id")).withColumn("__range", F.spark_partition_id()))
    tops = dealt.groupBy("__range").agg(F.max("doc_id").alias("__top"))
    down = Window.orderBy(F.desc("__top"))
    whole = down.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    after = tops.select("__range", F.coalesce(F.lead("__top").over(down), F.max("__top").over(whole)).alias("__after"))
    inside = F.lead("doc_id").over(Window.partitionBy("__range").orderBy(F.desc("doc_id")))
    return dealt.withColumn("__next", inside).join(F.broadcast(after), "__range").select(
        *ids.columns, F.coalesce("__next", "__after").alias("next_id")
    )


def edited_fingerprints(docs: DataFrame, words: int = WORDS, scale: int = SCALE) -> DataFrame:
    """doc_id, n_chars, edited, sketch, edited_sketch, next_sketch: each text, and what becomes of it by an edit.

    The edit replaces the last floor(n_chars / 3) code points by as many of the first of
    the next document's text (or all). Documents stand in descending order of doc_id; after
    the last comes the first. Rows that share a doc_id have the same next document; as a
    next document, the one of them with the least hash of its text counts. Rows without
    doc_id have no place in the order: their next text is empty. Null texts count as
    empty. A single document is its own next. Columns other than doc_id and text are
    not used. An empty table gives none.

    What is shuffled: each text with its sketch once, by doc_id, for both joins, and a
    third of it with its neighbour's sketch. A doc_id that very many rows share is split
    between tasks by adaptive execution, as only the rows' side of a join is large.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", text.alias("text"))
    made = rows.select("doc_id", "text", sketch(F.col("text"), words, scale).alias("sketch"))
    known, without = made.where("doc_id is not null"), made.where("doc_id is null")
    ids = rows.where("doc_id is not null").groupBy("doc_id").agg(
        F.count("*").alias("rows"),
        F.floor(F.max(F.char_length("text")) / 3).cast("int").alias("wanted"),
        F.min(F.xxhash64("text")).alias("first"),
    )
    order = written(next_ids(ids))
    repeated = (order.agg(F.max("rows")).first()[0] or 0) > 1
    firsts = order.select(F.col("doc_id").alias("__id"), F.col("first").alias("__first"))
    asks = order.select(F.col("doc_id").alias("__asker"), F.col("next_id").alias("doc_id"), "wanted")
    given = known.join(asks, "doc_id")
    if repeated:
        given = given.join(firsts, F.col("doc_id") == F.col("__id")).where(F.xxhash64("text") == F.col("__first"))
    given = given.select(
        F.col("__asker").alias("doc_id"),
        F.substring("text", F.lit(1), F.col("wanted")).alias("__next"),
        F.col("sketch").alias("next_sketch"),
    )
    if repeated:
        given = given.dropDuplicates(["doc_id"])
    nothing = sketch(F.lit(""), words, scale)
    both = known.join(given, "doc_id").unionByName(
        without.select("*", F.lit("").alias("__next"), nothing.alias("next_sketch"))
    )
    n = F.char_length("text")
    cut = F.floor(n / 3).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - cut), F.substring("__next", F.lit(1), cut))
    return both.select("doc_id", n.cast("long").alias("n_chars"), edited.alias("edited"), "sketch", "next_sketch").select(
        "doc_id", "n_chars", "edited", "sketch", sketch(F.col("edited"), words, scale).alias("edited_sketch"), "next_sketch"
    )


ORACLE_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
o AS (SELECT doc_id, t, length(t) AS n, coalesce(lead(t) OVER (ORDER BY doc_id DESC), first_value(t) OVER (ORDER BY doc_id DESC)) AS nt FROM d),
e AS (SELECT doc_id, n, t, nt, substring(t, 1, n - n // 3) || substring(nt, 1, n // 3) AS ed FROM o),
w AS (SELECT doc_id, n, ed, regexp_extract_all(lower(t), '[^\\x20\\x09-\\x0D]+') AS a,
  regexp_extract_all(lower(ed), '[^\\x20\\x09-\\x0D]+') AS b, regexp_extract_all(lower(nt), '[^\\x20\\x09-\\x0D]+') AS c FROM e),
s AS (SELECT *, list_sort(list_distinct(list_filter(list_transform(range(1, greatest(len(a) - 3, least(len(a), 1) + 1)), lambda i: md5(array_to_string(a[i:i + 4], ' '))[1:16]), lambda h: h < '2'))) AS ka,
  list_sort(list_distinct(list_filter(list_transform(range(1, greatest(len(b) - 3, least(len(b), 1) + 1)), lambda i: md5(array_to_string(b[i:i + 4], ' '))[1:16]), lambda h: h < '2'))) AS kb,
  list_sort(list_distinct(list_filter(list_transform(range(1, greatest(len(c) - 3, least(len(c), 1) + 1)), lambda i: md5(array_to_string(c[i:i + 4], ' '))[1:16]), lambda h: h < '2'))) AS kc,
  md5(array_to_string(a, ' '))[1:16] AS na, md5(array_to_string(b, ' '))[1:16] AS nb, md5(array_to_string(c, ' '))[1:16] AS nc FROM w),
j AS (SELECT *, len(list_intersect(ka, kb)) AS ab, len(list_intersect(ka, kc)) AS ac FROM s)
SELECT doc_id, n AS n_chars, sha256(ed) AS edited_sha256, na || ':' || array_to_string(ka, ',') AS fingerprint,
  nb || ':' || array_to_string(kb, ',') AS edited_fingerprint,
  CASE WHEN len(ka) + len(kb) > 0 THEN ab / (len(ka) + len(kb) - ab) ELSE (na = nb)::INT::DOUBLE END AS near_edited,
  CASE WHEN len(ka) + len(kc) > 0 THEN ac / (len(ka) + len(kc) - ac) ELSE (na = nc)::INT::DOUBLE END AS near_next,
  CASE WHEN len(ka) > 0 THEN ab / len(ka) ELSE (na = nb)::INT::DOUBLE END AS contained_in_edited,
  CASE WHEN len(ka) > 0 THEN ac / len(ka) ELSE (na = nc)::INT::DOUBLE END AS contained_in_next
FROM j"""
