"""Mixing sources to target weights by Poisson replication."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

SEED = "mix-1"
TEMPERATURE = 0.5
#: Sources whose rates are broadcast, at most; beyond, salted rows are joined by a shuffle.
BROADCAST_SOURCES = 100_000
SALTS = 64
#: Largest rate that one inversion draws; beyond, a count is the sum of parts of at most PART, each by a digest of its own.
LARGEST, PART = 600, 500
#: A 52-bit fraction of a digest is exact in a double.
_DIGITS, _RANGE = 13, float(2**52)


def _uniform(seed: str, *parts) -> F.Column:
    digest = F.md5(F.concat_ws(":", F.lit(seed), *parts).cast("binary"))
    return F.conv(F.substring(digest, 1, _DIGITS), 16, 10).cast("long") / F.lit(_RANGE)


def _key() -> F.Column:
    return F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))


def mixing_rates(docs: DataFrame, weights: dict[str | None, float] | None = None, epochs: float = 1.0,
                 temperature: float = TEMPERATURE) -> DataFrame:
    """(source, rate): the mean number of copies of a document of each source.

    A source's size is its bytes of text plus one a document, summed over the whole
    table. Its target share is ``weights[source]`` over the sum of all weights (a
    source without a weight is left out), by default its share to the power of
    ``temperature``. The mix holds ``epochs`` times the bytes of the sources in it.
    A null source is a source.
    """
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1
    sizes = docs.groupBy("source").agg(F.sum(size).alias("size"))
    if weights is not None:
        listed = [F.when(F.col("source").eqNullSafe(F.lit(s)), F.lit(float(w))) for s, w in weights.items()]
        sizes = sizes.withColumn("weight", F.coalesce(*listed, F.lit(0.0))).where("weight > 0")
    else:
        # a constant factor of all weights does not matter, so sizes stand for shares
        sizes = sizes.withColumn("weight", F.pow(F.col("size").cast("double"), F.lit(float(temperature))))
    sizes = written(sizes)
    total = sizes.agg(F.sum("size").alias("size"), F.sum("weight").alias("weight")).first()
    if total["size"] is None:
        return sizes.select("source", F.lit(0.0).alias("rate"))
    return sizes.select(
        "source",
        (F.lit(float(epochs)) * F.lit(total["size"]) * (F.col("weight") / F.lit(total["weight"])) / F.col("size")).alias("rate"),
    )


def poisson_count(u: F.Column, rate: F.Column) -> F.Column:
    """The least k whose Poisson distribution function exceeds ``u``: a native inversion.

    The sum stops where the remaining terms are below the resolution of ``u``, and
    by the term ``rate + 12 * sqrt(rate) + 30`` at the latest. Rates above LARGEST
    raise here; ``drawn_count`` splits them.
    """
    steps = F.sequence(F.lit(1), F.ceil(rate + 12 * F.sqrt(rate) + 30).cast("int"))
    start = F.struct(F.exp(-rate).alias("p"), F.exp(-rate).alias("cdf"), F.lit(0).alias("k"))

    def step(acc, k):
        p = acc["p"] * rate / k
        go = u >= acc["cdf"]
        return F.struct(
            p.alias("p"),
            F.when(go, acc["cdf"] + p).otherwise(acc["cdf"]).alias("cdf"),
            F.when(go, k).otherwise(acc["k"]).alias("k"),
        )

    checked = F.when(rate <= LARGEST, steps).otherwise(F.raise_error(F.lit(f"a rate is above {LARGEST}")))
    return F.aggregate(checked, start, step, lambda acc: acc["k"])


def drawn_count(seed: str, rate: F.Column) -> F.Column:
    """A document's Poisson count of any rate: a large one is the sum of independent parts of equal rates."""
    parts = F.when(rate <= LARGEST, F.lit(1)).otherwise(F.ceil(rate / PART).cast("int"))
    draws = F.transform(
        F.sequence(F.lit(0), parts - 1),
        lambda i: F.when(i == 0, _uniform(seed, _key())).otherwise(_uniform(seed + "-part", _key(), i)),
    )
    return F.aggregate(draws, F.lit(0), lambda total, u: total + poisson_count(u, rate / parts))


def mix_sources(docs: DataFrame, weights: dict[str | None, float] | None = None, epochs: float = 1.0,
                temperature: float = TEMPERATURE, seed: str = SEED, shuffled: bool = True) -> DataFrame:
    """The rows of ``docs``, each repeated by its count, in a global random order.

    A document's count is its digest of (seed, doc_id), as a fraction, put through
    the inverse Poisson distribution whose mean is its source's rate (rates above
    LARGEST in parts, which add up). The choice
    depends on nothing else, so that a repeated task chooses alike. Adds
    ``mix_copy`` (from 0) and ``mix_key``, the place in the order: a digest of
    (seed, doc_id, copy). The order is made by a range shuffle on that key, which
    spreads a hot source over all tasks.

    Null texts count as empty and are kept; a null doc_id draws as the text "null";
    repeated rows draw alike; an empty table gives an empty one; other columns pass.
    """
    rates = mixing_rates(docs, weights, epochs, temperature)
    rates = rates.select(F.col("source").alias("__mix_source"), F.col("rate").alias("__mix_rate"))
    same = docs["source"].eqNullSafe(F.col("__mix_source"))
    if rates.count() <= BROADCAST_SOURCES:
        counted = docs.join(F.broadcast(rates), same)
    else:
        salted = rates.withColumn("__mix_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        counted = docs.join(salted, same & (F.pmod(F.xxhash64(docs["doc_id"]), F.lit(SALTS)) == F.col("__mix_salt")))
    count = drawn_count(seed, F.col("__mix_rate"))
    copies = counted.withColumn("__mix_n", count).where("__mix_n > 0").withColumn(
        "mix_copy", F.explode(F.sequence(F.lit(0), F.col("__mix_n") - 1))
    )
    out = copies.withColumn(
        "mix_key", F.md5(F.concat_ws(":", F.lit(seed + "-order"), _key(), F.col("mix_copy")).cast("binary"))
    ).select(*[c for c in docs.columns if c not in ("mix_copy", "mix_key")], "mix_copy", "mix_key")
    return out.orderBy("mix_key", "mix_copy") if shuffled else out


ORACLE_SQL = f"""
WITH sized AS (
  SELECT source, sum(coalesce(strlen(text), 0) + 1)::BIGINT AS size FROM documents GROUP BY source
), weighted AS (SELECT source, size, pow(size::DOUBLE, {TEMPERATURE}) AS weight FROM sized
), rated AS (
  SELECT source, 1.0::DOUBLE * (SELECT sum(size)::BIGINT FROM weighted) * (weight / (SELECT sum(weight) FROM weighted)) / size AS rate
  FROM weighted
), terms AS (
  SELECT source, k, sum(p) OVER (PARTITION BY source ORDER BY k) AS cdf FROM (
    SELECT source, k, exp(-rate) * CASE WHEN k = 0 THEN 1.0 ELSE pow(rate, k) / gamma(k + 1.0) END AS p
    FROM rated, range(0, 101) t(k)
    WHERE k <= ceil(rate + 12 * sqrt(rate) + 30)) q
), drawn AS (
  SELECT d.*, ('0x' || substr(md5('{SEED}:' || coalesce(doc_id::VARCHAR, 'null')), 1, {_DIGITS}))::BIGINT / {_RANGE} AS u FROM documents d
), counted AS (
  SELECT d.doc_id, any_value(d.source) AS source, any_value(d.text) AS text, any_value(d.lang) AS lang,
    any_value(d.n_chars) AS n_chars, count(*) FILTER (WHERE t.cdf <= d.u) AS n
  FROM drawn d JOIN terms t ON d.source IS NOT DISTINCT FROM t.source GROUP BY d.doc_id
)
SELECT doc_id, text, lang, source, n_chars, c AS mix_copy,
  md5('{SEED}-order:' || coalesce(doc_id::VARCHAR, 'null') || ':' || c::VARCHAR) AS mix_key
FROM (SELECT *, unnest(range(0, n))::INT AS c FROM counted) q
"""
