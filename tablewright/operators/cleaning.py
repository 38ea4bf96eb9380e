"""Cleaning: duplicates, gaps, untidy categories, dates, constants; with an audit."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import as_double
from ..functions.report import local_rows
from ..functions.schema import col, is_nested, is_numeric, is_text
from ..functions.text import normalize_category, parse_timestamp
from .frequency import constant_columns, distinct_lookup, modes
from .missing import missing_by_column
from .numeric import medians
from .outliers import DEFAULT_THRESHOLD, outlier_report
from .typing import ColumnType, infer_types, types_by_class

DROP_MISSING_SHARE = 0.5
AUDIT_SCHEMA = "step int, action string, column string, before double, after double"


@dataclass(frozen=True)
class CleaningConfig:
    remove_duplicates: bool = True
    handle_missing: str = "auto"  # auto leaves gaps alone; drop; impute
    normalize_categories: bool = True
    normalize_dates: bool = True
    remove_constants: bool = True
    outlier_method: str | None = "iqr"
    outlier_threshold: float = DEFAULT_THRESHOLD
    null_token: str | None = None  # text that stands for a missing category, if any

    @classmethod
    def merged(cls, given: dict[str, Any] | CleaningConfig | None) -> CleaningConfig:
        if isinstance(given, cls):
            return given
        return replace(cls(), **(given or {}))


@dataclass
class Cleaned:
    df: DataFrame
    audit: DataFrame
    removed_columns: list[str] = field(default_factory=list)
    steps: list[tuple] = field(default_factory=list)
    held: list[DataFrame] = field(default_factory=list)

    def release(self) -> None:
        """Free what the steps persisted, once the cleaned table is no longer read."""
        for part in self.held:
            part.unpersist()


def drop_duplicates(df: DataFrame) -> DataFrame:
    """One copy of every distinct row; NULLs compare equal."""
    return df.dropDuplicates()


def missing_counts(df: DataFrame) -> tuple[int, dict[str, int]]:
    """Row count and missing cells per column from one aggregate."""
    found = missing_by_column(df).collect()
    rows = found[0]["n_rows"] if found else 0
    return rows, {r["column"]: r["missing_count"] for r in found}


def high_missing_columns(df: DataFrame, share: float = DROP_MISSING_SHARE) -> list[str]:
    rows, counts = missing_counts(df)
    return [c for c in df.columns if rows and counts[c] / rows > share]


def drop_missing_columns(df: DataFrame, share: float = DROP_MISSING_SHARE) -> DataFrame:
    """Remove the columns that are missing in more than ``share`` of the rows."""
    gone = set(high_missing_columns(df, share))
    return df.select(*[col(c) for c in df.columns if c not in gone])


def constant_column_names(df: DataFrame) -> list[str]:
    found = {r["column"] for r in constant_columns(df).collect()}
    return [c for c in df.columns if c in found]


def drop_constant_columns(df: DataFrame) -> DataFrame:
    """Remove the columns with at most one distinct value."""
    gone = set(constant_column_names(df))
    return df.select(*[col(c) for c in df.columns if c not in gone])


def drop_empty_columns(df: DataFrame) -> DataFrame:
    """Remove the columns without any value."""
    rows, counts = missing_counts(df)
    return df.select(*[col(c) for c in df.columns if counts[c] < rows])


def fill_values(df: DataFrame, columns: Sequence[str]) -> dict[str, Any]:
    """Median of number columns, most frequent value (as text) of the others."""
    types = {f.name: f.dataType for f in df.schema.fields}
    numbers = [c for c in columns if is_numeric(types[c])]
    others = [c for c in columns if not is_numeric(types[c]) and not is_nested(types[c])]
    out: dict[str, Any] = dict(medians(df, numbers))
    if others:
        found = {r["column"]: r["mode"] for r in modes(df, others).collect()}
        out.update({c: found.get(c) for c in others})
    return out


def fill_missing(df: DataFrame, values: dict[str, Any]) -> DataFrame:
    """Put the fitted values into the gaps; number columns become double."""
    types = {f.name: f.dataType for f in df.schema.fields}

    def one(c):
        if values.get(c) is None:
            return col(c)
        if is_numeric(types[c]):
            return F.coalesce(as_double(c), F.lit(values[c])).alias(c)
        return F.coalesce(col(c), F.lit(values[c]).cast(types[c])).alias(c)

    return df.select(*[one(c) for c in df.columns])


def impute(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Fill the gaps of the given columns, by default of all that have some."""
    if columns is None:
        _, counts = missing_counts(df)
        columns = [c for c in df.columns if counts[c] > 0]
    return fill_missing(df, fill_values(df, columns))


def normalize_categories(
    df: DataFrame, columns: Sequence[str], null_token: str | None = None
) -> DataFrame:
    """Trimmed, lower-case, single-spaced; NULL stays NULL unless a token is given."""
    chosen = set(columns)

    def one(c):
        if c not in chosen:
            return col(c)
        clean = normalize_category(col(c).cast("string"))
        return (clean if null_token is None else F.coalesce(clean, F.lit(null_token))).alias(c)

    return df.select(*[one(c) for c in df.columns])


def normalize_dates(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Text columns of dates become timestamps; what does not parse becomes NULL."""
    types = {f.name: f.dataType for f in df.schema.fields}
    chosen = {c for c in columns if is_text(types[c])}
    return df.select(
        *[(parse_timestamp(col(c)).alias(c) if c in chosen else col(c)) for c in df.columns]
    )


def date_parse_report(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(column, total, parsed, failed_pct)``; missing cells count as failed."""
    from ..functions.numeric import pct
    from ..functions.report import per_column

    return per_column(
        df,
        list(columns),
        lambda c: {
            "_rows": F.count(F.lit(1)),
            "parsed": F.count(parse_timestamp(col(c).cast("string"))),
        },
        lambda c, m: {
            "total": m["_rows"],
            "parsed": m["parsed"],
            "failed_pct": pct(m["_rows"] - m["parsed"], m["_rows"]),
        },
        "column string, total bigint, parsed bigint, failed_pct double",
    )


def clean(df: DataFrame, config: Any = None, types: list[ColumnType] | None = None) -> Cleaned:
    """Run the cleaning steps in order; every change leaves an audit row.

    The steps need counts (which columns to drop, what to fill in), so this runs
    jobs; callers that go on with the result should persist it.
    """
    cfg = CleaningConfig.merged(config)
    steps: list[tuple] = []
    removed: list[str] = []

    def note(action, column=None, before=None, after=None):
        steps.append(
            (
                len(steps) + 1,
                action,
                column,
                None if before is None else float(before),
                None if after is None else float(after),
            )
        )

    rows_before, columns_before = df.count(), len(df.columns)
    out, rows, held = df, rows_before, []
    if cfg.remove_duplicates:
        out = drop_duplicates(out).persist()
        held.append(out)
        rows = out.count()
        if rows < rows_before:
            note("remove_duplicates", None, rows_before, rows)
    if cfg.handle_missing in ("drop", "impute"):
        _, gaps = missing_counts(out)
        if cfg.handle_missing == "drop":
            for c in [c for c in out.columns if rows and gaps[c] / rows > DROP_MISSING_SHARE]:
                note("drop_missing_column", c, gaps[c], None)
                removed.append(c)
            out = out.select(*[col(c) for c in out.columns if c not in removed])
        else:
            values = fill_values(out, [c for c in out.columns if gaps[c] > 0])
            out = fill_missing(out, values)
            types_now = {f.name: f.dataType for f in df.schema.fields}
            for c, v in values.items():
                if v is not None:
                    kind = "median" if is_numeric(types_now[c]) else "most_frequent"
                    note(f"impute_{kind}", c, gaps[c], 0)
    found = types_by_class(infer_types(out)) if cfg.normalize_categories or cfg.normalize_dates else {}
    if cfg.normalize_categories and found["categorical"]:
        names = found["categorical"]
        tidy = normalize_categories(out, names, cfg.null_token)
        before, after = distinct_lookup(out, names), distinct_lookup(tidy, names)
        out = tidy
        for c in names:
            if before[c] != after[c]:
                note("normalize_category", c, before[c], after[c])
        # Tidy text may turn out to be dates that a stray blank had hidden.
        found["datetime"] += types_by_class(infer_types(out, names))["datetime"]
    if cfg.normalize_dates and found["datetime"]:
        names = found["datetime"]
        out = normalize_dates(out, names)
        present = out.agg(*[F.count(col(c)).alias(f"n{i}") for i, c in enumerate(names)]).first()
        for i, c in enumerate(names):
            if present[f"n{i}"] < rows:
                note("normalize_date", c, rows, present[f"n{i}"])
    if cfg.remove_constants:
        constants = constant_column_names(out)
        for c in constants:
            note("drop_constant_column", c, None, None)
        removed += constants
        out = out.select(*[col(c) for c in out.columns if c not in constants])
    if cfg.outlier_method:
        report = outlier_report(out, cfg.outlier_method, cfg.outlier_threshold).collect()
        total = sum(r["outliers"] for r in report)
        if total:
            note("outliers_found", None, None, total)
            for r in report:
                note("outliers_in_column", r["column"], None, r["outliers"])
    note("rows", None, rows_before, rows)
    note("columns", None, columns_before, len(out.columns))
    return Cleaned(out, local_rows(df, steps, AUDIT_SCHEMA), removed, steps, held)
