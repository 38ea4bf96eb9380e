"""Personal data: base rules, plus candidates scored by boosted trees; Spark expressions throughout.

High-recall patterns propose spans that may overlap. The features of a span are its
format and the characters around it. A few gradient-boosted trees, fitted by Spark ML
on the spans of all documents and turned into column expressions, give each span a score; a
threshold for each kind, set on a part of the spans that the trees have not seen,
selects spans. The base rules' spans always stay.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

# The base patterns, in the order that breaks ties of a start. Possessive
# loops and the anchored starts give the same matches as plain ones, in linear time and
# without the stack that Java's loops over groups need on very long runs.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Wider patterns whose matches the trees judge.
WIDE = {
    "secret": r"[A-Za-z0-9_+/=-]{16,}+",
    "number": r"\(?[0-9][0-9().\x20-]{5,22}[0-9]",
    "address": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++\x20?(?:@|\(at\)|\[at\])\x20?[A-Za-z0-9-]++"
    r"(?:\x20?(?:\.|\(dot\)|\[dot\])\x20?[A-Za-z0-9-]++)++",
}
KINDS = [*BASE, *WIDE]
AROUND = 24
_SECRET_WORD = r"(?i)(pass(word|wd|phrase)?|secret|token|api[_-]?key|access[_-]?key|credential|bearer)[\x22']?\s*[:=]?\s*[\x22']?$"
_NUMBER_WORD = r"(?i)(phone|tel|call|mobile|cell|fax|card|account|acct|ssn|iban|no\.?|number)[\x22']?\s*[:=.]?\s*\(?\+?[0-9]{0,3}\s*$"
_CHANGE = "(?<=[0-9])(?=[A-Za-z])|(?<=[A-Za-z])(?=[0-9])"
TREES, DEPTH = 8, 3
#: Share of right spans that a kind's threshold must reach on the part held back.
PRECISION = 0.95

#: The threshold of a kind of which no span was held back.
UNSEEN = 0.9

_SPAN = "struct<kind:string,start:bigint,end:bigint,value:string>"


def _cut(text: Column, kind: str, pattern: str) -> Column:
    """All matches, leftmost and non-overlapping, with their places in code points.

    The pieces between matches and the matches alternate, so their lengths add up to
    the places.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pieces = F.split(text, pattern, -1)

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.char_length(x["piece"])
        end = start + F.char_length(x["value"])
        span = F.struct(F.lit(kind).alias("kind"), start.alias("start"), end.alias("end"), x["value"].alias("value"))
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(span)).alias("out"))

    zipped = F.zip_with(found, F.slice(pieces, 1, F.size(found)), lambda v, p: F.struct(v.alias("value"), p.alias("piece")))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(f"array<{_SPAN}>").alias("out"))
    return F.aggregate(zipped, start, step, lambda acc: acc["out"])


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """True if the digits pass the Luhn check."""
    def weigh(i: Column) -> Column:
        d = F.substring(digits, F.char_length(digits) - i, F.lit(1)).cast("int")
        twice = F.when(i % 2 == 1, d * 2).otherwise(d)
        return F.when(twice > 9, twice - 9).otherwise(twice)

    places = F.sequence(F.lit(0), F.char_length(digits) - 1)
    return F.aggregate(F.transform(places, weigh), F.lit(0), lambda a, b: a + b) % 10 == 0


def _holds(kind: str, value: Column) -> Column:
    """The checks of a base kind on a match."""
    digits = _digits(value)
    size = F.char_length(digits)
    if kind == "ip":
        parts = F.transform(F.split(value, r"\."), lambda p: F.regexp_replace(p, "^0+(?=[0-9])", ""))
        return F.forall(parts, lambda p: F.when(F.char_length(p) <= 3, p.cast("int") <= 255).otherwise(False))
    if kind == "card":
        return F.when(size.between(12, 19), luhn(digits)).otherwise(False)
    if kind == "phone":
        return size.between(9, 15)
    return F.lit(True)


def _needs(kind: str, text: Column) -> Column:
    """A cheap test that every match's text passes."""
    if kind == "email":
        return F.contains(text, F.lit("@"))
    if kind == "address":
        return F.contains(text, F.lit("@")) | F.contains(text, F.lit("(at)")) | F.contains(text, F.lit("[at]"))
    if kind == "phone":
        return F.contains(text, F.lit("+"))
    return text.rlike("[0-9]")


def _found(kind: str, pattern: str) -> Column:
    """The kind's matches in ``__text``; texts that cannot have one are not searched."""
    none = F.array().cast(f"array<{_SPAN}>")
    text = F.col("__text")
    return F.when(_needs(kind, text), _cut(text, kind, pattern)).otherwise(none)


def base_spans() -> Column:
    """The spans of the base rules in ``__text``, by start, then kind as listed."""
    def held(kind: str):
        return lambda s: _holds(kind, s["value"])

    return _sorted(F.concat(*[F.filter(_found(kind, pattern), held(kind)) for kind, pattern in BASE.items()]))


def _sorted(spans: Column) -> Column:
    order = F.create_map(*[F.lit(x) for i, k in enumerate(KINDS) for x in (k, i)])
    keyed = F.transform(spans, lambda s: F.struct(
        s["start"].alias("start"), F.element_at(order, s["kind"]).alias("rank"), s["end"].alias("end"), s["kind"].alias("kind"), s["value"].alias("value")))
    return F.transform(F.array_sort(keyed), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value")))


def _count(value: Column, pattern: str) -> Column:
    return (F.char_length(value) - F.char_length(F.regexp_replace(value, pattern, ""))).cast("double")


FEATURES = ["is_secret", "is_number", "length", "digits", "upper", "lower", "other", "distinct", "equals", "luhn", "near_secret",
            "near_number", "starts_plus", "letter_before", "letter_after", "hex_only", "changes"]


def features(span: Column, before: Column, after: Column) -> dict[str, Column]:
    """Format and context of a span, as doubles; ``before`` and ``after``: up to AROUND code points around it."""
    value = span["value"]
    digits = _digits(value)
    flag = lambda c: F.coalesce(c.cast("double"), F.lit(0.0))
    size = F.char_length(digits)
    return {
        "is_secret": flag(span["kind"] == "secret"),
        "is_number": flag(span["kind"] == "number"),
        "length": F.char_length(value).cast("double"),
        "digits": size.cast("double"),
        "upper": _count(value, "[A-Z]"),
        "lower": _count(value, "[a-z]"),
        "other": _count(value, "[^A-Za-z0-9]"),
        "distinct": F.size(F.array_distinct(F.split(value, ""))).cast("double"),
        "equals": flag(value.rlike("[A-Za-z_]=[^=]")),
        "luhn": flag(F.when(size.between(12, 19), luhn(digits)).otherwise(False)),
        "near_secret": flag(F.concat(before, F.regexp_extract(value, r"^[A-Za-z_-]+[=:]", 0)).rlike(_SECRET_WORD)),
        "near_number": flag(before.rlike(_NUMBER_WORD)),
        "starts_plus": flag(before.rlike(r"\+[0-9\x20(]{0,6}$")),
        "letter_before": flag(before.rlike(r"\p{L}$")),
        "letter_after": flag(after.rlike(r"^\p{L}")),
        "hex_only": flag(value.rlike("^[0-9a-f]{16,}$")),
        "changes": (F.char_length(F.regexp_replace(value, _CHANGE, "_")) - F.char_length(value)).cast("double"),
    }


def _surely(kind: Column, value: Column, before: Column) -> Column:
    """The label of a training span, by strict formats: does it hold personal data or a credential?"""
    digits = _digits(value)
    size = F.char_length(digits)
    named = F.concat(before, F.regexp_extract(value, r"^[A-Za-z_-]+[=:]", 0)).rlike(_SECRET_WORD)
    secret = named | value.rlike(r"^(AKIA|ASIA)[0-9A-Z]{16}$") | value.rlike(r"^(ghp|gho|sk|pk|xox[abp])[_-][A-Za-z0-9_-]{16,}$")
    number = F.when(size.between(13, 19), luhn(digits)).otherwise(False) | (
        size.between(9, 11) & (before.rlike(r"\+[0-9]{0,3}\x20?$") | value.rlike(r"^\([0-9]{3}\)\x20?[0-9]{3}[-.\x20][0-9]{4}$")))
    return F.when(kind == "secret", secret).when(kind == "number", number).otherwise(True)


def _around(text: Column, span: Column) -> tuple[Column, Column]:
    first = F.greatest(span["start"] - AROUND, F.lit(0))
    before = F.substring(text, (first + 1).cast("int"), (span["start"] - first).cast("int"))
    return before, F.substring(text, (span["end"] + 1).cast("int"), F.lit(AROUND))


def described() -> Column:
    """The wide spans of ``__text`` with their features: an array of structs.

    A span that a base span covers whole is no candidate.
    """
    wide = F.filter(F.concat(*[_found(k, p) for k, p in WIDE.items()]), lambda s: (s["kind"] != "secret") | s["value"].rlike("[0-9]"))
    covered = lambda s: F.exists(F.col("__base"), lambda b: (b["start"] <= s["start"]) & (b["end"] >= s["end"]))
    open_spans = F.filter(wide, lambda s: ~covered(s))

    def describe(s: Column) -> Column:
        before, after = _around(F.col("__text"), s)
        values = features(s, before, after)
        return F.struct(s.alias("span"), before.alias("before"), *[values[n].alias(n) for n in FEATURES])

    return F.transform(open_spans, describe)


@dataclass
class SpanModel:
    """Trees as nested (feature, threshold, below, above) or a leaf's value, their weights, and thresholds by kind."""

    trees: list = field(default_factory=list)
    weights: list[float] = field(default_factory=list)
    thresholds: dict[str, float] = field(default_factory=dict)

    def score(self, row: Column) -> Column:
        """The probability of a described span, as an expression."""
        def walk(node) -> Column:
            if isinstance(node, float):
                return F.lit(node)
            name, cut, below, above = node
            return F.when(row[name] <= cut, walk(below)).otherwise(walk(above))

        margin = F.lit(0.0)
        for tree, weight in zip(self.trees, self.weights, strict=True):
            margin = margin + F.lit(weight) * walk(tree)
        return 1 / (1 + F.exp(-2 * margin))


def _tree(node) -> float | tuple:
    """A fitted tree's node as plain values."""
    if node.subtreeDepth() == 0:
        return float(node.prediction())
    split = node.split()
    return FEATURES[split.featureIndex()], float(split.threshold()), _tree(node.leftChild()), _tree(node.rightChild())


def prepared(docs: DataFrame) -> DataFrame:
    """``docs`` with ``__text`` (null: empty) and the base spans."""
    return docs.withColumn("__text", F.coalesce("text", F.lit(""))).withColumn("__base", base_spans())


def fit(docs: DataFrame) -> SpanModel:
    """Fit trees and thresholds on the candidates of all ``docs``.

    Candidates of a digest from "a" on are held back from the trees and set the thresholds.
    Labels come from strict formats and from words that name a credential.
    Without candidates of both labels there are no trees and no added spans.
    """
    spans = prepared(docs.select("doc_id", "text")).select("doc_id", F.explode(described()).alias("c")).select("doc_id", "c.*")
    digest = F.md5(F.concat_ws(":", "doc_id", "span.kind", "span.start").cast("binary"))
    label = _surely(F.col("span.kind"), F.col("span.value"), F.col("before")).cast("double")
    spans = written(spans.select(F.col("span.kind").alias("kind"), label.alias("label"), (digest >= "a").alias("back"), *FEATURES))
    told = {r["label"]: r["n"] for r in spans.where("not back").groupBy("label").agg(F.count("*").alias("n")).collect()}
    if len(told) < 2:
        return SpanModel()
    rows = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(spans.where("not back"))
    fitted = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, maxBins=16, seed=3).fit(rows.select("features", "label"))
    model = SpanModel([_tree(t._java_obj.rootNode()) for t in fitted.trees], [float(w) for w in fitted.treeWeights])
    row = {n: F.col(n) for n in FEATURES}
    # Scores have four decimals, so a kind has 10,001 of them at most.
    score = F.round(model.score(row), 4)
    held = spans.where("back").groupBy("kind", score.alias("score")).agg(F.count("*").alias("n"), F.sum("label").alias("right"))
    by_kind: dict[str, list[tuple[float, int, float]]] = {}
    for r in held.collect():
        by_kind.setdefault(r["kind"], []).append((r["score"], r["n"], r["right"]))
    for kind, scores in by_kind.items():
        right = total = 0.0
        for score, n, held_right in sorted(scores, reverse=True):
            total += n
            right += held_right
            if right / total >= PRECISION:
                model.thresholds[kind] = score
    return model


def find_spans(docs: DataFrame, model: SpanModel | None = None) -> DataFrame:
    """``docs`` with ``base`` and ``spans``: arrays of (kind, start, end, value), by start, then kind.

    Places are code points, the end exclusive. ``base`` holds the spans of the base
    rules, ``spans`` these and the candidates that the model selects; they may
    overlap. A null text is empty and has none. Matches are searched in whole texts;
    repeated rows give the same spans; input columns named base or spans are replaced.
    """
    model = fit(docs) if model is None else model
    kept = prepared(docs.drop("base", "spans"))
    added = F.array().cast(f"array<{_SPAN}>")
    if model.thresholds:
        cut = F.create_map(*[F.lit(x) for pair in sorted(model.thresholds.items()) for x in pair])
        scored = F.transform(described(), lambda c: F.struct(c["span"].alias("span"), F.round(model.score(c), 4).alias("score")))
        chosen = F.filter(scored, lambda c: c["score"] >= F.coalesce(F.element_at(cut, c["span"]["kind"]), F.lit(UNSEEN)))
        added = F.transform(chosen, lambda c: c["span"])
    return kept.withColumn("spans", _sorted(F.concat(F.col("__base"), added))).withColumnRenamed("__base", "base").drop("__text")


def written_spans(spans: Column) -> Column:
    """kind:start:end of all spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, model: SpanModel | None = None) -> DataFrame:
    """``docs`` with every span replaced by its kind in brackets, and ``n_chars`` of the new text.

    Of overlapping spans the first names the replaced stretch, which covers all of
    them. Texts without spans, null ones included, stay as they are.
    """
    found = find_spans(docs, model)

    def step(acc: Column, s: Column) -> Column:
        gap = F.substring("text", (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int"))
        new = s["start"] >= acc["at"]
        return F.struct(
            F.greatest(acc["at"], s["end"]).alias("at"),
            F.when(new, F.concat(acc["out"], gap, F.lit("["), F.upper(s["kind"]), F.lit("]"))).otherwise(acc["out"]).alias("out"))

    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))
    rest = lambda acc: F.concat(acc["out"], F.substring("text", (acc["at"] + 1).cast("int"), F.char_length("text")))
    text = F.when(F.size("spans") > 0, F.aggregate("spans", start, step, rest)).otherwise(F.col("text"))
    out = found.withColumn("__new", text)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.size("spans") > 0, F.char_length("__new").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.withColumn("text", F.col("__new")).select(*docs.columns)
