"""From a clean table to model-ready columns: prune, impute, scale, encode, assemble."""

from __future__ import annotations

import warnings
from collections.abc import Sequence
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.numeric import as_double
from ..functions.quantiles import exact_quantiles
from ..functions.report import local_rows
from ..functions.schema import col
from ..functions.text import boolean_code, unique_feature_names
from ..session import checkpointed
from .cleaning import constant_column_names, drop_empty_columns, missing_counts
from .frequency import at_most_distinct, most_least_frequent, value_frequencies
from .splitting import SEED, TEST_SHARE, stratified_split, train_test_split
from .target import MAX_CLASSES
from .typing import SEMANTIC_TYPES, infer_types, types_by_class

SCALINGS = ("standard", "minmax", "robust", "none", "drop")
ENCODINGS = ("onehot", "ordinal", "none", "drop")
# Up to here a column's categories are written into the plan; longer dictionaries stay
# distributed and reach the rows by a join.  The features are the same either way.
MAX_LITERAL_CATEGORIES = 1000
HOT_VALUES = 500
HOT_SPREAD = 1024
BROADCAST_ROWS = 200_000
AUDIT_SCHEMA = "step int, action string, column string, value double"
PARAMETER_SCHEMA = "column string, stat string, value double, text string"


@dataclass(frozen=True)
class FeatureConfig:
    test_size: float = TEST_SHARE
    random_state: int = SEED
    scaling: str = "standard"
    encoding: str = "onehot"
    rename_features: bool = True
    fit_on: str = "all"  # or "train": fit on the training rows only

    @classmethod
    def merged(cls, given: dict[str, Any] | FeatureConfig | None) -> FeatureConfig:
        if isinstance(given, cls):
            return given
        flat = dict(given or {})
        flat.pop("feature_selection", None)
        return replace(cls(), **flat)


# --- scaling -----------------------------------------------------------------


def scaling_parameters(
    df: DataFrame, columns: Sequence[str], method: str
) -> dict[str, tuple[float, float]]:
    """``{column: (offset, divisor)}``; a divisor of zero is replaced by one."""
    names = list(columns)
    if not names:
        return {}
    if method == "robust":
        found = exact_quantiles(df, names, (0.25, 0.5, 0.75))
        pairs = {c: (q[0.5], q[0.75] - q[0.25]) for c, q in found.items()}
    else:
        a, b = {
            "standard": (F.avg, F.stddev_pop),
            "minmax": (F.min, lambda c: F.max(c) - F.min(c)),
        }[method]
        row = df.agg(
            *[a(as_double(c)).alias(f"a{i}") for i, c in enumerate(names)],
            *[b(as_double(c)).alias(f"b{i}") for i, c in enumerate(names)],
        ).first()
        pairs = {c: (row[f"a{i}"], row[f"b{i}"]) for i, c in enumerate(names)}
    return {c: (a, b if b else 1.0) for c, (a, b) in pairs.items()}


@dataclass(frozen=True)
class Number:
    """A fitted numeric feature: gaps take ``fill``, then offset and divisor apply."""

    fill: float | None = None
    offset: float | None = None
    divisor: float | None = None

    def of(self, column: str) -> Column:
        x = as_double(column)
        if self.fill is not None:
            x = F.coalesce(x, F.lit(self.fill))
        return x if self.divisor is None else (x - F.lit(self.offset)) / F.lit(self.divisor)


def scale(df: DataFrame, columns: Sequence[str], method: str = "standard") -> DataFrame:
    """Replace the columns by their median-filled, scaled values."""
    fitted = fit_numeric(df, columns, method)
    return df.select(*[(fitted[c].of(c).alias(c) if c in fitted else col(c)) for c in df.columns])


def fit_numeric(df: DataFrame, columns: Sequence[str], method: str) -> dict[str, Number]:
    """Per column: fill gaps with the median, then scale what came out."""
    _, gaps = missing_counts(df.select(*[col(c) for c in columns])) if columns else (0, {})
    holes = [c for c in columns if gaps[c]]
    centre = {c: q[0.5] for c, q in exact_quantiles(df, holes, (0.5,)).items()}
    filled = {c: Number(centre.get(c)) for c in columns}
    if method == "none":
        return filled
    full = df.select(*[filled[c].of(c).alias(c) for c in columns])
    parameters = scaling_parameters(full, columns, method)
    return {c: Number(centre.get(c), *parameters[c]) for c in columns}


# --- categories ----------------------------------------------------------------


def categories(df: DataFrame, column: str) -> DataFrame:
    """``(value, n)`` of one column."""
    return value_frequencies(df, [column]).select("value", "n")


def fit_categories(
    df: DataFrame, columns: Sequence[str], limit: int = MAX_LITERAL_CATEGORIES
) -> tuple[dict[str, list[str] | None], dict[str, str]]:
    """Sorted categories and the most frequent one, per column.

    Columns of more than ``limit`` categories get None: their dictionary stays
    distributed, only its size and its mode come back.
    """
    if not columns:
        return {}, {}
    ends = {r["column"]: r for r in most_least_frequent(df, columns).collect()}
    fill = {c: r["most_frequent"] for c, r in ends.items()}
    short = [c for c in columns if c not in ends or ends[c]["unique_values"] <= limit]
    found: dict[str, list[str]] = {c: [] for c in short}
    if short:
        for r in value_frequencies(df, short).select("column", "value").collect():
            found[r["column"]].append(r["value"])
    return {c: sorted(found[c]) if c in found else None for c in columns}, fill


def code_dictionary(df: DataFrame, column: str, per_bucket: int = 100_000) -> DataFrame:
    """``(value, code)`` with codes in value order, for a dictionary of any size.

    A window over the whole dictionary would be one task, so sorted values are
    numbered per bucket: bounds come from a small sample and only decide where a
    value is counted, never whether.
    """
    values = categories(df, column)
    total = values.count()
    wanted = min(1000, max(1, total // per_bucket))
    code = (F.row_number().over(Window.orderBy("value")) - 1).cast("double")
    if wanted == 1:  # a dictionary that one task orders easily
        return values.select("value", "n", code.alias("code"))
    sampled = values.select("value").sample(False, min(1.0, 20_000 / total), seed=SEED)
    bounds = sorted(r["value"] for r in sampled.collect())
    known = F.array(*[F.lit(c) for c in bounds[:: max(1, len(bounds) // wanted)]])
    bucket = F.size(F.filter(known.cast("array<string>"), lambda b: b <= F.col("value")))
    marked = values.select("value", "n", bucket.alias("b"))
    before = Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)  # <= 1000 rows
    offsets = (
        marked.groupBy("b")
        .agg(F.count("*").alias("k"))
        .select("b", F.coalesce(F.sum("k").over(before), F.lit(0)).alias("start"))
    )
    inside = Window.partitionBy("b").orderBy("value")
    return marked.join(F.broadcast(offsets), "b").select(
        "value", "n", (F.col("start") + F.row_number().over(inside) - 1).cast("double").alias("code")
    )


def row_hash(df: DataFrame) -> Column:
    """A hash of all columns that can be hashed; equal rows have equal ones."""
    whole = [f.name for f in df.schema.fields if "map<" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString()]
    return F.xxhash64(*[col(c) for c in whole]) if whole else F.lit(0).cast("long")


def join_codes(
    df: DataFrame,
    column: str,
    dictionary: DataFrame,
    out: str,
    broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """Add the code of each row's value; unknown and missing values get -1.

    A dictionary of at most ``broadcast_rows`` rows is broadcast.  Beyond that
    its most frequent values are, and rows holding one of those are spread over
    dummy keys for the shuffled join, so no value makes a hot partition.
    """
    entries = dictionary.select(F.col("value").alias("__v"), F.col("code").alias("__code"))
    text = col(column).cast("string")
    if dictionary.limit(broadcast_rows + 1).count() <= broadcast_rows:
        joined = df.join(F.broadcast(entries), text == F.col("__v"), "left")
        return joined.withColumn(out, F.coalesce("__code", F.lit(-1.0))).drop("__v", "__code")
    hot = dictionary.orderBy(F.desc("n"), "value").limit(HOT_VALUES)
    hot = hot.select(F.col("value").alias("__hv"), F.col("code").alias("__hot"))
    # a hash of the row, so that a task that runs again deals the same keys
    spread = F.concat(F.lit("\u0000"), F.pmod(row_hash(df), F.lit(HOT_SPREAD)))
    marked = df.join(F.broadcast(hot), text == F.col("__hv"), "left").withColumn(
        "__k", F.when(F.col("__hot").isNull() & text.isNotNull(), text).otherwise(spread)
    )
    joined = marked.join(entries, F.col("__k") == F.col("__v"), "left")
    return joined.withColumn(out, F.coalesce("__hot", "__code", F.lit(-1.0))).drop(
        "__hv", "__hot", "__k", "__v", "__code"
    )


def ordinal_code(values: list[str], text: Column) -> Column:
    """Position in the sorted categories; -1 for anything else."""
    if not values:
        return F.lit(-1.0)
    place = F.array_position(F.array(*[F.lit(v) for v in values]), text).cast("double")
    return F.coalesce(F.when(place > 0, place - 1), F.lit(-1.0))


@dataclass
class Coding:
    """The fitted codes of one column: places of its sorted categories.

    ``known`` lists the categories where they are few; else ``book`` holds them as
    ``(value, code, n)``, and codes reach the rows by a join.  Both give the same codes.
    """

    column: str
    fill: str | None
    size: int
    known: list[str] | None
    book: DataFrame | None

    @property
    def first(self) -> int:
        """The first category with a feature of its own: of two only the second has one."""
        return 1 if self.size == 2 else 0

    @property
    def width(self) -> int:
        return self.size - self.first

    def values(self) -> list[str]:
        """All categories in order: one entry a feature, as many as a model has coefficients."""
        if self.known is not None:
            return self.known
        return [r["value"] for r in self.book.select("value", "code").orderBy("code").collect()]

    def facts(self, df: DataFrame) -> DataFrame:
        """``(column, stat, value, text)``: each category's code; the counts too where the dictionary is long."""
        if self.known is not None:
            rows = [(self.column, "category", float(k), v) for k, v in enumerate(self.known)]
            return local_rows(df, rows, PARAMETER_SCHEMA)
        both = F.array(
            F.struct(F.lit("category").alias("stat"), F.col("code").alias("value"), F.col("value").alias("text")),
            F.struct(F.lit("count").alias("stat"), F.col("n").cast("double").alias("value"), F.col("value").alias("text")),
        )
        return self.book.select(F.lit(self.column).alias("column"), F.inline(both))

    def coded(self, df: DataFrame, out: str) -> DataFrame:
        """``df`` with the code of each row's category, the mode's for gaps, -1 for unknown ones."""
        text = F.coalesce(col(self.column).cast("string"), F.lit(self.fill))
        if self.known is not None:
            return df.withColumn(out, ordinal_code(self.known, text))
        return join_codes(df.withColumn("__text", text), "__text", self.book, out).drop("__text")


def fit_codings(df: DataFrame, columns: Sequence[str]) -> list[Coding]:
    """Categories and modes of the columns; longer dictionaries are fitted once and kept apart from their source."""
    known, fill = fit_categories(df, columns)
    out = []
    for c in columns:
        book = None if known[c] is not None else checkpointed(code_dictionary(df, c))
        out.append(Coding(c, fill.get(c), len(known[c]) if book is None else book.count(), known[c], book))
    return out


def onehot_expressions(code: Column, coding: Coding) -> list[Column]:
    """A 0/1 column for each category that has a feature."""
    return [F.when(code == F.lit(float(k)), 1.0).otherwise(0.0) for k in range(coding.first, coding.size)]


def onehot_vectors(df: DataFrame, codings: Sequence[Coding], codes: Sequence[str]) -> DataFrame:
    """The code columns as 0/1 vectors of each coding's width, in place; sparse, a row stores one entry.

    Unknown values (code -1) become all zeros.  A coding of one feature becomes a number.
    """
    from pyspark.ml.feature import OneHotEncoder

    wide = [(c, k) for c, k in zip(codes, codings, strict=True) if k.width != 1]
    plain = df.withColumns({c: onehot_expressions(F.col(c), k)[0] for c, k in zip(codes, codings, strict=True) if k.width == 1})
    if not wide:
        return plain
    names = [c for c, _ in wide]
    # the encoder learns no more than the sizes: the largest code of each column
    top = local_rows(df, [tuple(float(k.size - 1) for _, k in wide)], ", ".join(f"`{c}` double" for c in names))
    made = [f"{c}__v" for c in names]
    encoder = OneHotEncoder(inputCols=names, outputCols=made, handleInvalid="keep", dropLast=True).fit(top)
    valid = {c: F.when(F.col(c) >= 0, F.col(c)).otherwise(F.lit(float(k.size))) for c, k in wide}
    return encoder.transform(plain.withColumns(valid)).drop(*names).withColumnsRenamed(dict(zip(made, names, strict=True)))


@dataclass
class OneHot:
    """Fitted one-hot features of some columns, alike at every number of categories."""

    codings: list[Coding]

    @property
    def names(self) -> list[str]:
        return [f"{k.column}_{v}" for k in self.codings for v in k.values()[k.first :]]

    @property
    def width(self) -> int:
        return sum(k.width for k in self.codings)

    def _coded(self, df: DataFrame) -> tuple[DataFrame, list[str]]:
        codes = [f"__code{i}" for i in range(len(self.codings))]
        for k, c in zip(self.codings, codes, strict=True):
            df = k.coded(df, c)
        return df, codes

    def columns(self, df: DataFrame) -> DataFrame:
        """A 0/1 column a feature in place of the columns."""
        wide, codes = self._coded(df)
        made = [e for k, c in zip(self.codings, codes, strict=True) for e in onehot_expressions(F.col(c), k)]
        gone = {k.column for k in self.codings}
        return wide.select(*[col(c) for c in df.columns if c not in gone], *[e.alias(n) for e, n in zip(made, self.names, strict=True)])

    def vectors(self, df: DataFrame, out: str = "features") -> DataFrame:
        """One sparse vector of all features in place of the columns."""
        from pyspark.ml.feature import VectorAssembler

        wide, codes = self._coded(df)
        packed = VectorAssembler(inputCols=codes, outputCol="__packed").transform(onehot_vectors(wide, self.codings, codes))
        gone = {k.column for k in self.codings}
        return packed.select(*[col(c) for c in df.columns if c not in gone], F.col("__packed").alias(out))

    def cells(self, df: DataFrame, keys: Sequence[str]) -> DataFrame:
        """(keys, place, feature, value): the entries that are not zero, a row each; places are those of the vector."""
        wide, codes = self._coded(df)
        at, start = [], 0
        for k, c in zip(self.codings, codes, strict=True):
            text = F.coalesce(col(k.column).cast("string"), F.lit(k.fill))
            held = (F.col(c) >= k.first).alias("held")
            at.append(F.struct((F.col(c) - k.first + start).cast("long").alias("place"), F.concat(F.lit(f"{k.column}_"), text).alias("feature"), held))
            start += k.width
        return (
            wide.select(*[col(c) for c in keys], F.inline(F.array(*at))).where("held").drop("held").withColumn("value", F.lit(1.0))
        )


def fit_onehot(df: DataFrame, columns: Sequence[str]) -> OneHot:
    return OneHot(fit_codings(df, columns))


def onehot(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Mode-filled one-hot columns in place of the given ones; :class:`OneHot` also gives vectors and cells."""
    return fit_onehot(df, columns).columns(df)


def ordinal(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Codes in sorted category order in place of the given columns.

    Gaps take the most frequent value first, as in :func:`onehot`.
    """
    out = df
    for k in fit_codings(df, columns):
        out = k.coded(out, "__coded").withColumn(k.column, F.col("__coded")).drop("__coded")
    return out.select(*[col(c) for c in df.columns])


def booleans(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """0/1 in place of boolean spellings; gaps take the more frequent one."""
    fitted = fit_boolean(df, columns)
    made = {c: F.coalesce(boolean_code(col(c)), F.lit(v)) for c, v in fitted.items()}
    return df.select(*[(made[c].alias(c) if c in made else col(c)) for c in df.columns])


def fit_boolean(df: DataFrame, columns: Sequence[str]) -> dict[str, float]:
    """The more frequent code of each column, which its gaps take; 0 of equals."""
    if not columns:
        return {}
    codes = df.select(*[boolean_code(col(c)).alias(c) for c in columns])
    row = codes.agg(
        *[F.coalesce((F.avg(col(c)) > 0.5).cast("double"), F.lit(0.0)).alias(f"m{i}") for i, c in enumerate(columns)]
    ).first()
    return {c: row[f"m{i}"] for i, c in enumerate(columns)}


# --- the fitted preparation -------------------------------------------------------


@dataclass
class Block:
    """One or more features made from one column: a number, a boolean, a code, or the categories of a code."""

    column: str
    raw: list[str]
    number: Number | None = None
    boolean: float | None = None  # what gaps become
    coding: Coding | None = None
    spread: bool = False  # True: a feature a category, else the number or the code itself

    @property
    def value(self) -> Column:
        if self.number is not None:
            return self.number.of(self.column)
        return F.coalesce(boolean_code(col(self.column)), F.lit(self.boolean))

    def facts(self, place: int) -> list[tuple]:
        """``(column, stat, value, text)`` of all but the categories."""
        out: list[tuple] = []
        if self.number is not None:
            out.append((self.column, "number", float(place), None))
            given = {"fill": self.number.fill, "offset": self.number.offset, "divisor": self.number.divisor}
            out += [(self.column, k, float(v), None) for k, v in given.items() if v is not None]
        elif self.coding is None:
            out += [(self.column, "boolean", float(place), None), (self.column, "fill", self.boolean, None)]
        else:
            out.append((self.column, "onehot" if self.spread else "ordinal", float(place), None))
            out += [(self.column, "mode", None, self.coding.fill), (self.column, "size", float(self.coding.size), None)]
        return out


@dataclass
class FeaturePlan:
    """Fitted features.  ``transform`` gives plain columns, ``assemble`` one vector; both are
    projections, plus joins for dictionaries too long to write into the plan."""

    target: str | None
    config: FeatureConfig
    blocks: list[Block]
    by_class: dict[str, list[str]]
    removed: list[str]
    parameters: DataFrame
    audit: DataFrame
    names: list[str] = field(default_factory=list)

    def save(self, path: str) -> None:
        """Write all parameters as one table, dictionaries included; a folder that exists is an error."""
        self.parameters.write.parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> FeaturePlan:
        """The plan that :meth:`save` wrote: the same features for the same rows.

        What comes to the driver has a row a column or feature; dictionaries too long to
        write into a plan stay a table.
        """
        table = spark.read.schema(PARAMETER_SCHEMA).parquet(path)
        rows = table.filter("stat NOT IN ('category', 'count')").collect()
        by_column: dict[str, dict[str, Any]] = {}
        for r in rows:
            if r["column"] is not None and r["stat"] not in ("feature", "removed", "type"):
                by_column.setdefault(r["column"], {})[r["stat"]] = r["text"] if r["stat"] == "mode" else r["value"]
        config = FeatureConfig.merged({k: r["text"] for r in rows for k in ("scaling", "encoding", "fit_on") if r["stat"] == k})
        of_columns = F.col("stat").isin("category", "count")
        short = [c for c, facts in by_column.items() if facts.get("size", MAX_LITERAL_CATEGORIES + 1) <= MAX_LITERAL_CATEGORIES]
        known: dict[str, list[tuple]] = {c: [] for c in short}
        for r in table.filter((F.col("stat") == "category") & F.col("column").isin(short)).collect():
            known[r["column"]].append((r["value"], r["text"]))
        blocks = []
        for c, facts in by_column.items():
            kind = next((k for k in ("number", "boolean", "onehot", "ordinal") if k in facts), None)
            if kind is None:
                continue
            block = Block(c, [])
            if kind == "number":
                block.number = Number(facts.get("fill"), facts.get("offset"), facts.get("divisor"))
            elif kind == "boolean":
                block.boolean = facts["fill"]
            else:
                listed = [v for _, v in sorted(known[c])] if c in known else None
                book = None
                if listed is None:
                    own = table.filter(of_columns & (F.col("column") == c)).groupBy(F.col("text").alias("value"))
                    sums = {"code": "category", "n": "count"}
                    book = own.agg(*[F.max(F.when(F.col("stat") == k, F.col("value"))).alias(a) for a, k in sums.items()])
                    book = book.select("value", F.col("n").cast("long"), "code")
                block.coding = Coding(c, facts["mode"], int(facts["size"]), listed, book)
                block.spread = kind == "onehot"
            blocks.append((facts[kind], block))
        names = [r["column"] for r in sorted((r for r in rows if r["stat"] == "feature"), key=lambda r: r["value"])]
        by_class = {k: [r["column"] for r in rows if r["stat"] == "type" and r["text"] == k] for k in SEMANTIC_TYPES}
        target = next((r["text"] for r in rows if r["stat"] == "target"), None)
        removed = [r["column"] for r in rows if r["stat"] == "removed"]
        audit = local_rows(table, [(1, "load_plan", None, float(len(names)))], AUDIT_SCHEMA)
        return cls(target, config, [b for _, b in sorted(blocks, key=lambda x: x[0])], by_class, removed, table, audit, names)

    def _valued(self, df: DataFrame, keep: Sequence[str]) -> tuple[DataFrame, list[str], list[str]]:
        """One column a block, beside the target and the columns to keep."""
        extra = [c for c in (*keep, *([self.target] if self.target else [])) if c in df.columns]
        made, wide = [f"__b{i}" for i in range(len(self.blocks))], df
        for b, name in zip(self.blocks, made, strict=True):
            if b.coding is not None:
                wide = b.coding.coded(wide, name)
        wide = wide.withColumns({n: b.value for b, n in zip(self.blocks, made, strict=True) if b.coding is None})
        extra = list(dict.fromkeys(extra))
        return wide.select(*[F.col(n) for n in made], *[col(c) for c in extra]), made, extra

    def transform(self, df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
        """Feature columns as doubles, then the target and the columns to keep."""
        wide, made, extra = self._valued(df, keep)
        out: list[Column] = []
        for b, name in zip(self.blocks, made, strict=True):
            out += onehot_expressions(F.col(name), b.coding) if b.spread else [F.col(name)]
        return wide.select(*[e.alias(n) for e, n in zip(out, self.names, strict=True)], *[col(c) for c in extra])

    def assemble(self, df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
        """The same as one ``features`` vector; no plain column a category is made for it."""
        from pyspark.ml.feature import VectorAssembler

        wide, made, extra = self._valued(df, keep)
        hot = [(n, b.coding) for b, n in zip(self.blocks, made, strict=True) if b.spread]
        wide = onehot_vectors(wide, [k for _, k in hot], [n for n, _ in hot])
        packed = VectorAssembler(inputCols=made, outputCol="__packed").transform(wide)
        return packed.select(*[col(c) for c in extra], F.col("__packed").alias("features"))


@dataclass
class Prepared:
    """A fitted plan and the rows it was made for, with their ``split``."""

    plan: FeaturePlan
    rows: DataFrame
    kept: list[str]

    @property
    def feature_names(self) -> list[str]:
        return self.plan.names

    @property
    def data(self) -> DataFrame:
        """Feature columns, the target, the kept columns and ``split``."""
        return self.plan.transform(self.rows, self.kept)

    @property
    def vectors(self) -> DataFrame:
        """The same with one ``features`` vector in place of the feature columns."""
        return self.plan.assemble(self.rows, self.kept)


def fit_features(df: DataFrame, target: str | None = None, config: Any = None) -> FeaturePlan:
    """Prune, classify and fit; raises ``ValueError`` when no feature is left."""
    cfg = FeatureConfig.merged(config)
    if cfg.scaling not in SCALINGS or cfg.encoding not in ENCODINGS:
        raise ValueError(f"Unknown scaling or encoding: {cfg.scaling}, {cfg.encoding}")
    steps: list[tuple] = []

    def note(action, column=None, value=None):
        steps.append((len(steps) + 1, action, column, None if value is None else float(value)))

    x = df
    if target is not None and target in df.columns:
        x = df.drop(target)
        note("separate_target", target)
    elif target is not None:
        note("target_absent", target)
        warnings.warn(f"No column {target}: all columns become features", stacklevel=2)
    present = drop_empty_columns(x)
    empty = [c for c in x.columns if c not in present.columns]
    constants = constant_column_names(present)
    for c in empty:
        note("drop_empty_column", c)
    for c in constants:
        note("drop_constant_column", c)
    x = present.select(*[col(c) for c in present.columns if c not in constants])
    by_class = types_by_class(infer_types(x))
    blocks: list[Block] = []
    books: list[DataFrame] = []
    if cfg.scaling != "drop" and by_class["numeric"]:
        for c, e in fit_numeric(x, by_class["numeric"], cfg.scaling).items():
            blocks.append(Block(c, [f"num__{c}"], number=e))
        note(f"scale_{cfg.scaling}", None, len(by_class["numeric"]))
    if cfg.encoding not in ("none", "drop") and by_class["categorical"]:
        names = by_class["categorical"]
        spread = cfg.encoding == "onehot"
        for k in fit_codings(x, names):
            books.append(k.facts(df))
            raw = [f"cat__{k.column}_{v}" for v in k.values()[k.first :]] if spread else [f"cat__{k.column}"]
            blocks.append(Block(k.column, raw, coding=k, spread=spread))
            if k.known is None:
                note("encode_by_dictionary", k.column)
        note(f"encode_{cfg.encoding}", None, len(names))
    if by_class["boolean"]:
        for c, e in fit_boolean(x, by_class["boolean"]).items():
            blocks.append(Block(c, [f"bool__{c}"], boolean=e))
        note("boolean_to_number", None, len(by_class["boolean"]))
    raw = [n for b in blocks for n in b.raw]
    if not raw:
        raise ValueError("No usable feature columns")
    names = unique_feature_names(raw) if cfg.rename_features else raw
    if names != raw:
        note("rename_features")
    note("features", None, len(names))
    for kind, members in by_class.items():
        note(f"type_{kind}", None, len(members))
    facts = [f for i, b in enumerate(blocks) for f in b.facts(i)]
    facts += [(None, "scaling", None, cfg.scaling), (None, "encoding", None, cfg.encoding), (None, "fit_on", None, cfg.fit_on)]
    facts += [(None, "target", None, target)] if target is not None and target in df.columns else []
    facts += [(c, "removed", None, None) for c in empty + constants]
    facts += [(c, "type", None, kind) for kind, members in by_class.items() for c in members]
    facts += [(n, "feature", float(i), None) for i, n in enumerate(names)]
    parameters = local_rows(df, facts, PARAMETER_SCHEMA)
    for book in books:
        parameters = parameters.unionByName(book)
    return FeaturePlan(
        target if target in df.columns else None,
        cfg,
        blocks,
        by_class,
        empty + constants,
        parameters,
        local_rows(df, steps, AUDIT_SCHEMA),
        names,
    )


def prepare(
    df: DataFrame,
    target: str | None = None,
    config: Any = None,
    key: Sequence[str] | None = None,
) -> Prepared:
    """Fit, transform and split.  Few classes: split exactly per class."""
    cfg = FeatureConfig.merged(config)
    marked = df
    if target is not None and target in df.columns:
        few = at_most_distinct(df, target, MAX_CLASSES)
        marked = (
            stratified_split(df, target, key, cfg.test_size, cfg.random_state)
            if few
            else train_test_split(df, key, cfg.test_size, cfg.random_state)
        )
    source = df
    if cfg.fit_on == "train" and "split" in marked.columns:
        source = marked.filter("split = 'train'").drop("split")
    plan = fit_features(source, target, cfg)
    kept = [*(key or []), *(["split"] if "split" in marked.columns else [])]
    return Prepared(plan, marked, kept)
